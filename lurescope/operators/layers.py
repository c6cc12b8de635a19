"""Scripts that hide in layers: the steps that a decoder's source records are replayed, and keys are searched for among its strings.

What a source says of its steps and strings is read by a small function a file; the steps
themselves, and the search over pairs of strings, are column expressions over rows of
candidates.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How a decoder's source shows its steps, its strings, and what plain scripts hold.
ATOB = re.compile(r"\batob\s*\(")
HEX_XOR = re.compile(r"parseInt\s*\(\s*[^,)]+?\s*,\s*16\s*\)\s*\^\s*(0x[0-9a-fA-F]+|\d+)")
REVERSE = re.compile(r"\.\s*split\s*\(\s*['\"]\s*['\"]\s*\)\s*\.\s*reverse\s*\(\s*\)\s*\.\s*join")
ROT13 = re.compile(r"charCodeAt\s*\(\s*0?\s*\)\s*-\s*\w+\s*\+\s*13\s*\)\s*%\s*26")
JSON_JOIN = re.compile(r"JSON\s*\.\s*parse\s*\([^)]*\)\s*\.\s*join\s*\(\s*['\"]([^'\"]*)['\"]\s*\)")
SEED = r"""['"]([A-Za-z0-9+/=]{20,})['"]"""
KEY_SEED = r"""['"]([A-Za-z0-9+/=]{16,})['"]"""
CYCLE = r"\[\s*\w+\s*\]\s*\^\s*\w+\s*\[\s*\w+\s*%\s*\w+\s*\.\s*length\s*\]"
URL = r"""(?i)https?://[^\s"'<>\]\)\\]+"""
MARKS = ("function", "var ", "const ", "let ", "window.", "document.", "eval(", "=>")
CYCLE_MARKS = ("function", "var ", "const ", "let ", "window.", "document.", "location", "fetch(", "eval(", "=>", "navigator.", "submit")
#: The shortest plain text, and how many of the longest strings are tried as texts and keys.
LEAST, LONGEST = 20, 8
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEPS = "array<struct<name:string,key:int,sep:string>>"


def recorded(source: str) -> list[dict]:
    """The steps of a source in the order of its text; an atob that feeds a hexadecimal XOR is a part of it."""
    calls = [m.start() for m in ATOB.finditer(source)]
    fed: dict[int, int] = {}
    for m in HEX_XOR.finditer(source):
        before = [a for a in calls if a < m.start()]
        if before:
            fed[before[-1]] = int(m[1], 16 if m[1].startswith("0x") else 10)
    found = [(a, "hex_xor" if a in fed else "b64", fed.get(a), None) for a in calls]
    found += [(m.start(), "reverse", None, None) for m in REVERSE.finditer(source)] + [(m.start(), "rot13", None, None) for m in ROT13.finditer(source)]
    found += [(m.start(), "json_parse", None, m[1]) for m in JSON_JOIN.finditer(source)]
    return [{"name": n, "key": k if k is None or k < 256 else -1, "sep": s} for _, n, k, s in sorted(found, key=lambda x: x[0])]


def from_base64(data: Column) -> Column:
    """Bytes of a base64 string, other characters left out; null where its padding is wrong."""
    return F.try_to_binary(F.regexp_replace(data, "[^A-Za-z0-9+/=]", ""), F.lit("base64"))


def applied(data: Column, step: Column) -> Column:
    """``data`` after one step, null if it can't be taken."""
    raw = from_base64(data)
    ascii_ = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"[^\x00-\x7F]", "")
    pairs = F.filter(F.regexp_extract_all(ascii_, F.lit(r"(?s)(..)"), F.lit(1)), lambda p: p.rlike("^[0-9a-fA-F]{2}$"))
    xored = F.array_join(F.transform(pairs, lambda p: F.chr(F.conv(p, 16, 10).cast("int").bitwiseXOR(step["key"]).cast("long"))), "")
    turned = F.translate(data, ALPHABET + ALPHABET.lower(), ALPHABET[13:] + ALPHABET[:13] + (ALPHABET[13:] + ALPHABET[:13]).lower())
    listed = F.from_json(data, "array<string>")
    together = F.aggregate(F.slice(listed, 2, F.greatest(F.size(listed), F.lit(1))), F.get(listed, F.lit(0)), lambda held, x: F.concat(held, step["sep"], x))
    name = step["name"]
    return (
        F.when(name == "b64", F.make_valid_utf8(raw.cast("string"))).when((name == "hex_xor") & raw.isNotNull() & (step["key"] >= 0), xored)
        .when(name == "reverse", F.reverse(data)).when(name == "rot13", turned).when(name == "json_parse", together)
    )


def _plain(text: Column, marks: tuple[str, ...]) -> Column:
    return (F.char_length(text) >= LEAST) & (text.rlike(URL) | reduce(lambda a, b: a | b, [text.contains(m) for m in marks]))


def replay(files: DataFrame, id_col: str, content: str) -> DataFrame:
    """id, plaintext, steps (names in order) of files whose recorded steps turn one of their strings into a script or address.

    Steps must hold a hexadecimal XOR, a JSON list or a reversal. Strings are tried from
    the longest (of equal ones, the first in order), and the first that gives a plain
    text counts. Null files have none.
    """

    @F.arrow_udf(STEPS)
    def read(text: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("name", pa.string()), ("key", pa.int32()), ("sep", pa.string())]))
        return pa.array([recorded(t) if t else [] for t in text.to_pylist()], kind)

    rows = files.filter(F.col(content).rlike(ATOB.pattern) | F.col(content).rlike(REVERSE.pattern) | F.col(content).rlike(JSON_JOIN.pattern)).select(F.col(id_col).alias("id"), F.col(content).cast("string").alias("_t"))
    rows = rows.withColumn("_steps", read("_t")).filter(F.exists("_steps", lambda s: s["name"].isin("hex_xor", "json_parse", "reverse")))
    # From here on texts are made by generators, past which no filter moves, so each is made once.
    seeds = rows.select("id", "_steps", F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(SEED), F.lit(1)))).alias("_seed"))
    got = seeds.withColumn("plaintext", F.explode(F.array(F.aggregate("_steps", F.col("_seed"), applied)))).filter(_plain(F.col("plaintext"), MARKS))
    best = got.groupBy("id").agg(F.min(F.struct((-F.length("_seed")).alias("n"), "_seed", "plaintext", F.transform("_steps", lambda s: s["name"]).alias("steps"))).alias("_b"))
    return best.select("id", "_b.plaintext", "_b.steps")


def cycled(cipher: Column, key: Column) -> Column:
    """Hexadecimal digits of ``cipher`` XOR ``key``, the key's bytes used in turn; both in hexadecimal digits."""
    byte = lambda text, i: F.conv(F.substring(text, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    size = (F.length(key) / 2).cast("int")
    places = F.sequence(F.lit(0), (F.length(cipher) / 2).cast("int") - 1)
    return F.array_join(F.transform(places, lambda i: F.lpad(F.hex(byte(cipher, i).bitwiseXOR(byte(key, i % size)).cast("long")), 2, "0")), "")


def cycled_texts(files: DataFrame, id_col: str, content: str) -> DataFrame:
    """id, plaintext of files with a loop that XORs bytes with a key in turn: the longest script that any two of their strings give.

    The LONGEST longest strings are tried, each as text and as key of each other; texts
    must be UTF-8. Of equally long results the one of the longer text and key counts.
    """
    rows = files.filter(F.col(content).rlike(CYCLE)).select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(KEY_SEED), F.lit(1)))).alias("_s"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.length("_s")), "_s"))
    top = rows.withColumn("_r", rank).filter(F.col("_r") <= LONGEST).select("id", "_r", F.hex(from_base64(F.col("_s"))).alias("_h")).filter("length(_h) > 0")
    pairs = top.join(top.select("id", F.col("_r").alias("_q"), F.col("_h").alias("_k")), "id").filter("_r <> _q")
    got = pairs.withColumn("_b", F.unhex(cycled(F.col("_h"), F.col("_k")))).filter(F.is_valid_utf8(F.col("_b").cast("string"))).withColumn("plaintext", F.col("_b").cast("string"))
    able = got.filter((F.char_length("plaintext") >= LEAST) & (F.col("plaintext").rlike(URL) | reduce(lambda a, b: a | b, [F.lower("plaintext").contains(m) for m in CYCLE_MARKS])))
    best = able.groupBy("id").agg(F.max(F.struct(F.char_length("plaintext").alias("n"), (-F.col("_r")).alias("r"), (-F.col("_q")).alias("q"), "plaintext")).alias("_b"))
    return best.select("id", "_b.plaintext")
