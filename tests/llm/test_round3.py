"""Resampling, byte-pair encoding and the Merkle manifest against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lurescope.llm import bpe, common, merkle, resample
from tests.llm.test_operators import DOCS, corpus


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(5), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# Resampling


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(rows, target, buckets, percent, least):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text, buckets))
    for text in target:
        t.update(features(text, buckets))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        f = features(text, buckets)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    able = sorted((-r[3], r[0] is None, r[0] or 0) for r in out if r[4] >= least)
    cut = [x[0] for x in able[: percent * len(able) // 100]]
    return Counter(r[:4] + (r[4],) for r in out), [-x for x in cut]


@pytest.mark.parametrize("percent", [5, 100])
def test_resample(spark, docs, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = [rows[40][1], "One É two words", None, ""]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, benchmark, percent=percent).collect()
    want, drawn = brute_resample(rows, target, 10_000, percent, 20)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["n_words"]) for r in got) == want
    ranked = sorted((r["rank"], r["score"], r["doc_id"]) for r in got if r["rank"])
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1)) and [r[1] for r in ranked] == drawn
    assert all(a[1] > b[1] or a[2] is None or b[2] is None or a[2] <= b[2] for a, b in zip(ranked, ranked[1:]))
    assert all(r["n_words"] >= 20 for r in got if r["rank"])


def test_resample_folds_ascii_only_and_bears_empty_tables(spark, docs, empty):
    few = spark.createDataFrame([(1, "ÀB àb ÀB"), (2, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "Àb")], "item_id long, text string")
    got = {r["doc_id"]: r for r in resample.resample(few, benchmark, least_words=1, percent=50).collect()}
    assert got[1]["n_features"] == 6 and got[2]["n_features"] == got[2]["weight"] == 0 and got[2]["rank"] is None
    assert resample.resample(empty, benchmark).count() == 0
    without = resample.resample(few, benchmark.limit(0)).collect()
    assert len(without) == 2 and all(r["rank"] is None for r in without)


def test_rows_are_numbered_in_order(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    rows = [("a", random.Random(i).randint(0, 40)) for i in range(300)] + [("b", 5)] * 40
    df = spark.createDataFrame(rows, "g string, v int")
    got = common.number_rows(df, [F.desc("v")], ["g"], count="n").collect()
    for g in "ab":
        part = sorted((r["idx"], r["v"], r["n"]) for r in got if r["g"] == g)
        assert [p[0] for p in part] == list(range(len(part))) and {p[2] for p in part} == {len(part)}
        assert [p[1] for p in part] == sorted((v for h, v in rows if h == g), reverse=True)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r["idx"] for r in common.number_rows(df, [F.asc("v")]).collect()) == list(range(340))


# Byte pairs

MIXED = "ab cdé  \n\t'srelEZ012.,!#<|endoftext|>日本́\U0001f600\x00\x85\xa0İß\x1c　"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.VOCABULARY)


def samples():
    r = random.Random(8)
    out = ["".join(r.choice(MIXED) for _ in range(r.randint(0, 60))) for _ in range(400)]
    out += ["", "a<|endoftext|>  b <|endoftext|><|endoftext|>", "  <|endoftext|>  ", "<|endoftext|", "a" * 5000, "ab" * 3000 + " x", " " * 3000, "�"]
    return out + ["".join(r.choice("abcdefgh") for _ in range(n)) for n in (2, 3, 63, 64, 65, 66, 7000)]


def test_encodes_as_the_library(library, vocabulary):
    texts = samples()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    kept = {}
    for _ in range(2):
        got = vocabulary.encode(texts, kept)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert [vocabulary.decode(g) for g in got] == texts == [library.decode(w, skip_special_tokens=False) for w in want]


def test_trees_and_forests_merge_alike(vocabulary):
    r = random.Random(9)
    raw = [bytes(r.choice(b"aeinrst ") for _ in range(n)) for n in range(2, 60) for _ in range(4)]
    sized = defaultdict(list)
    for w in raw:
        sized[1 << (len(w) - 2).bit_length()].append(w)
    for size, group in sized.items():
        assert [np.frombuffer(x, "<u4").tolist() for x in vocabulary.merge_forest(group, size)] == [vocabulary.merge(w) for w in group]


def test_pair_tree_names_the_leftmost_lowest_rank():
    r = random.Random(10)
    for n in (1, 2, 3, 9, 40):
        ranks = [r.choice([-1, 0, 1, 2, 5]) for _ in range(n)]
        tree = bpe.PairTree(ranks)
        for _ in range(60):
            able = [(k, i) for i, k in enumerate(ranks) if k >= 0]
            assert tree.least() == (min(able) if able else None)
            at = r.randrange(n)
            ranks[at] = r.choice([-1, 0, 1, 7])
            tree.put(at, ranks[at])


def test_encode_and_decode_over_rows(spark, docs, empty, library):
    for r in bpe.encode_and_decode(docs).join(docs.filter("doc_id is not null").select("doc_id", "text").distinct(), "doc_id").collect():
        text = r["text"] or ""
        assert np.frombuffer(bytes(r["tokens"]), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids and r["decoded"] == text
    assert bpe.encode_and_decode(docs).count() == docs.count() and bpe.encode_and_decode(empty).count() == 0
    codec = bpe.Codec(spark)
    odd = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x7f")), (2, None), (3, bytearray())], "id long, tokens binary")
    assert [r["text"] for r in codec.decode(odd).orderBy("id").collect()] == ["", "", ""]
    clash = docs.withColumnRenamed("key", "tokens")
    assert codec.encode(clash).columns == clash.columns and codec.encode(clash, to="ids").columns == [*clash.columns, "ids"]


# The Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """root and each leaf's path [(sibling, before)]"""
    tiers = [leaves]
    while len(tiers[-1]) > 1:
        t = tiers[-1]
        tiers.append([H(*t[i : i + 2]) for i in range(0, len(t), 2)])
    out = []
    for i in range(len(leaves)):
        path = []
        for t in tiers[:-1]:
            j = i ^ 1
            path.append((t[j] if j < len(t) else None, i % 2 == 1))
            i //= 2
        out.append(path)
    return tiers[-1][0], out


def text_of(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


@pytest.mark.parametrize("levels", [1, 2, 9])
def test_manifest(spark, levels):
    r = random.Random(levels)
    langs = [None, "", "de", "en", "É", "z"]
    rows = [(i, r.choice(["s", None]), "en" if i % 3 else r.choice(langs), i if i % 5 else None, r.choice([None, "", f"text {i} é"])) for i in range(75)]
    rows += [(7, "s", "en", 1, "twice"), (7, "s", "en", 1, "twice"), (None, None, None, None, None), (None, "s", "en", 2, "no id"), (500, "x", "alone", 3, "one leaf")]
    cols = ["doc_id", "source", "lang", "n_chars", "text"]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, source string, lang string, n_chars long, text string, idx string, n int").repartition(4)
    groups = defaultdict(list)
    for x in rows:
        groups[x[2]].append((x[0] is not None, x[0] or 0, H(*map(text_of, x)), x))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, inner = [], {}
    for g in order:
        held = sorted(groups[g], key=lambda y: y[:3])
        root, ways = brute_tree([y[2] for y in held])
        subs.append(root)
        inner[g] = [(y[3], y[2], p) for y, p in zip(held, ways)]
    root, upper = brute_tree(subs)
    want = Counter()
    for g, sub, high in zip(order, subs, upper):
        for idx, (x, leaf, path) in enumerate(inner[g]):
            want[x[0], x[2], idx, leaf, sub, root, tuple(path + high), x[3]] += 1
    found = merkle.manifest(df, cols, "lang", "doc_id", ["n_chars"], levels)
    got = Counter((x["doc_id"], x["lang"], x["idx"], x["leaf"], x["subroot"], x["root"], tuple((s["sibling"], s["before"]) for s in x["path"]), x["n_chars"]) for x in found.collect())
    assert got == want
    checked = found.select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), (merkle.fold(F.lit("0" * 64), F.col("path")) == F.col("root")).alias("bad"), merkle.path_digest(F.col("path")).alias("d"), "path")
    for x in checked.collect():
        assert x["ok"] and not x["bad"] and x["d"] == H(*[s["sibling"] for s in x["path"] if s["sibling"]])


def test_manifest_of_nothing_and_of_one(spark, empty):
    cols = ["doc_id", "source", "lang", "n_chars", "text"]
    assert merkle.manifest(empty, cols, "lang", "doc_id").count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, None, None, None, "x" * 300_000)], "doc_id long, source string, lang string, n_chars long, text string"), cols, "lang", "doc_id").first()
    assert one["leaf"] == one["subroot"] == one["root"] == H("1:1", "-", "-", "-", "300000:" + "x" * 300_000) and one["path"] == []
