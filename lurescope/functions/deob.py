"""Deobfuscation of PHP, JavaScript and HTML."""

from __future__ import annotations

import base64
import binascii
import codecs
import gzip
import re
import urllib.parse
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_ROUNDS, MOST_BYTES = 100, 10 << 20


def _b64(data: bytes) -> bytes:
    kept = bytes(c for c in data if chr(c).isalnum() or c in b"+/")
    return base64.b64decode(kept + b"=" * (-len(kept) % 4))


def _inflate(data: bytes) -> bytes:
    """Raw deflate, bounded."""
    return zlib.decompressobj(-15).decompress(data, MOST_BYTES)


DECODERS: dict[str, Callable[[bytes], bytes]] = {
    "base64_decode": _b64,
    "gzinflate": _inflate,
    "gzuncompress": lambda d: zlib.decompressobj().decompress(d, MOST_BYTES),
    "gzdecode": lambda d: gzip.decompress(d)[:MOST_BYTES],
    "str_rot13": lambda d: codecs.encode(d.decode("latin-1"), "rot13").encode("latin-1"),
    "rawurldecode": urllib.parse.unquote_to_bytes,
    "urldecode": lambda d: urllib.parse.unquote_to_bytes(d.replace(b"+", b" ")),
    "hex2bin": lambda d: binascii.unhexlify(d.strip()),
    "strrev": lambda d: d[::-1],
}
_NAMES = "|".join(DECODERS)
_EVAL = re.compile(rf"eval\s*\(\s*((?:(?:{_NAMES})\s*\(\s*)+)(['\"])([^'\"]*)\2\s*\)+\s*;?", re.I)
_CHR = re.compile(r"chr\s*\(\s*(\d+)\s*\)")
_CHRS = re.compile(r"(?:chr\s*\(\s*\d+\s*\)\s*\.?\s*){3,}", re.I)


def php(text: str) -> dict:
    """Unwrap nested eval decoders until nothing changes: content, layers, techniques, success, error."""
    techniques: list[str] = []
    error = None
    layers = 0
    chars = _CHRS.sub(lambda m: "'" + "".join(chr(int(n) & 255) for n in _CHR.findall(m[0])) + "'", text)
    if chars != text:
        techniques.append("chr_concat")
        text = chars
    while layers < MOST_ROUNDS and (m := _EVAL.search(text)):
        data = m[3].encode("latin-1", "replace")
        chain = re.findall(_NAMES, m[1].lower())
        try:
            for name in reversed(chain):
                data = DECODERS[name](data)
        except (ValueError, zlib.error, OSError, EOFError) as e:
            error = f"{'>'.join(chain)}: {e}"
            break
        if len(text) + len(data) > MOST_BYTES:
            error = "too large"
            break
        techniques += [n for n in chain if n not in techniques]
        text = text[: m.start()] + data.decode("utf-8", "replace") + text[m.end() :]
        layers += 1
    return {"content": text, "layers": layers, "techniques": techniques, "success": bool(techniques), "error": error}


_ESCAPES = re.compile(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})")
_CODES = re.compile(r"String\s*\.\s*fromCharCode\s*\(\s*([0-9xXa-fA-F,\s]+)\)")
_ATOB = re.compile(r"atob\s*\(\s*['\"]([A-Za-z0-9+/=]{20,})['\"]\s*\)")
_XOR = re.compile(r"charCodeAt\s*\(\s*\w*\s*\)\s*\^\s*(0x[0-9a-fA-F]+|\d+)")
_LONG = re.compile(r"['\"]([A-Za-z0-9+/=]{40,})['\"]")


def _printable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and sum(c.isprintable() or c in "\r\n\t" for c in text) >= 0.9 * len(text) else None


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def js(text: str) -> dict:
    """Resolve escapes, character codes, base64 literals and base64 under a one-byte XOR."""
    techniques: list[str] = []
    layers = 0

    def note(name: str, new: str) -> str:
        nonlocal layers
        if new != text:
            layers += 1
            if name not in techniques:
                techniques.append(name)
        return new

    for _ in range(MOST_ROUNDS):
        before = text
        text = note("escapes", _ESCAPES.sub(lambda m: chr(int(m[1] or m[2], 16)), text))
        text = note("from_char_code", _CODES.sub(lambda m: _quoted("".join(chr(int(n, 0) & 0xFFFF) for n in re.split(r"[,\s]+", m[1].strip()) if re.fullmatch(r"0[xX][0-9a-fA-F]+|[1-9]\d*|0", n))), text))
        key = _XOR.search(text)
        if key:
            k = int(key[1], 0) & 255

            def xored(m: re.Match) -> str:
                try:
                    plain = _printable(bytes(b ^ k for b in _b64(m[1].encode())))
                except (ValueError, binascii.Error):
                    plain = None
                return _quoted(plain) if plain else m[0]

            text = note("xor_base64", _LONG.sub(xored, text))
        else:

            def decoded(m: re.Match) -> str:
                try:
                    plain = _printable(_b64(m[1].encode()))
                except (ValueError, binascii.Error):
                    plain = None
                return _quoted(plain) if plain else m[0]

            text = note("atob", _ATOB.sub(decoded, text))
        if text == before or len(text) > MOST_BYTES:
            break
    return {"content": text, "layers": layers, "techniques": techniques, "success": layers > 0, "error": None}


RESULT = "struct<content:string,layers:int,techniques:array<string>,success:boolean,error:string>"


def deobfuscate(text: Column, kind: Column) -> Column:
    """The result for a file by kind (php or js); null for other kinds."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(("content", "layers", "techniques", "success", "error"))
        return pd.DataFrame([{"php": php, "js": js}.get(k, lambda _: none)(t) if t is not None else none for t, k in zip(texts, kinds, strict=True)], columns=list(none))

    return F.when(kind.isin("php", "js"), run(text, kind))


EMPTY_TAG = r"(?i)<(b|i|em|strong|span|u|s|small|mark|abbr|cite|code|sub|sup)(?:\s+[^>]*)?\s*>\s*</\1\s*>"


def without_empty_tags(html: Column, least: int = 10) -> Column:
    """HTML without empty inline tags, if there are so many that they hide text."""
    return F.when(F.regexp_count(html, F.lit(EMPTY_TAG)) >= least, F.regexp_replace(html, EMPTY_TAG, "")).otherwise(html)


def decrypted_page(html: Column) -> Column:
    """Plaintext of a page that decrypts itself by AES-GCM, null unless it looks like HTML.

    Of three base64 variables the shortest is the IV, the next the key, the longest the ciphertext.
    """
    b64 = r"['\"]([A-Za-z0-9+/=]{8,})['\"]"
    three = rf"var\s+\w+\s*=\s*{b64}\s*,\s*\w+\s*=\s*{b64}\s*,\s*\w+\s*=\s*{b64}"
    parts = F.array_sort(F.transform(F.array(*(F.regexp_extract(html, three, i) for i in (1, 2, 3))), lambda x: F.struct(F.length(x).alias("n"), x.alias("v"))))
    raw = lambda i: F.try_to_binary(parts[i]["v"], F.lit("base64"))
    key = raw(1)
    plain = F.try_aes_decrypt(F.concat(raw(0), raw(2)), key, F.lit("GCM")).cast("string")
    marked = html.rlike(r"crypto\.subtle\.(?:importKey|decrypt)") & html.contains("AES-GCM") & html.rlike(three) & F.length(key).isin(16, 24, 32)
    return F.when(marked, F.when(plain.rlike(r"(?i)<\s*(!doctype|html|head|body|div|script|form|meta)\b"), plain))
