"""The digest index against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from lurescope.operators import digest_index as index
from lurescope.operators import similarity


def rows(seed=1):
    r = random.Random(seed)
    digit = lambda: r.choice("0123456789ABCDEF")
    base = ["T1" + "".join(digit() for _ in range(70)) for _ in range(12)]
    out = [(i, b) for i, b in enumerate(base)] + [(50, base[0]), (51, base[0].lower()), (52, None)]
    for i in range(160):
        d = list(base[i % 12])
        for _ in range(r.randint(1, 14)):
            at = r.randrange(8, 72)
            v = int(d[at], 16)
            d[at] = f"{v ^ r.choice([1, 2, 4, 5, 8]):X}"
        if i % 7 == 0:
            d[2] = digit()
        out.append((100 + i, "".join(d)))
    return out


def distance(a, b):
    frame = similarity.pd.DataFrame
    return int(similarity.tlsh_distances(frame({"d": [a.upper()]}), frame({"d": [b.upper()]}))[0, 0])


@pytest.fixture(scope="module")
def brute():
    held = [x for x in rows() if x[1]]
    return {(a, b): distance(x, y) for a, x in held for b, y in held if a < b}


@pytest.mark.parametrize("most", [0, 30])
def test_pairs(spark, brute, most):
    df = spark.createDataFrame(rows(), "id int, d string")
    got = {(r["a"], r["b"]): r["distance"] for r in index.pairs(df, "id", "d", most).collect()}
    assert got == {k: v for k, v in brute.items() if v <= most} and (most == 0 or len(got) > 20)
    if most == 30:
        tiles = {(r["a"], r["b"]): r["distance"] for r in similarity.tlsh_pairs(df, "id", "d", most).collect()}
        assert got == tiles


def test_values_near(spark):
    r = random.Random(2)
    values = [0, 65535, 0x1234, r.randrange(65536)]
    code = lambda v: np.array([v >> 2 * i & 3 for i in range(8)])
    for steps in (0, 1, 2):
        df = spark.createDataFrame([(v,) for v in values], "v int").select("v", index.values_near(index.F.col("v"), steps).alias("near"))
        for x in df.collect():
            assert sorted(x["near"]) == [w for w in range(65536) if abs(code(w) - code(x["v"])).sum() <= steps]
    with pytest.raises(ValueError, match="distances"):
        index.candidates(df, df, 48)


def test_search_and_variants(spark, brute):
    data = rows()
    df = spark.createDataFrame([(i, d, f"g{i % 2}" if i % 9 else None, i % 5 * 100) for i, d in data], "id int, d string, g string, size int")
    got = Counter((r["query"], r["id"], r["distance"]) for r in index.search(df.filter("id % 20 = 0"), df, "id", "d", 30).collect())
    both = brute | {(b, a): v for (a, b), v in brute.items()}
    assert got == {(a, b, v): 1 for (a, b), v in both.items() if v <= 30 and a % 20 == 0}
    pairs = {(r["grp"], r["a"], r["b"]) for r in index.variants(df, "id", "g", "d", "size").collect()}
    ok = lambda a, b: a % 9 and b % 9 and a % 2 == b % 2 and min(a % 5, b % 5) > 0 and max(a % 5, b % 5) <= 1.15 * min(a % 5, b % 5)
    assert pairs == {(f"g{a % 2}", a, b) for (a, b), v in brute.items() if v <= 30 and ok(a, b)} and pairs
    share = index.share_compared(df, "d", 30).first()
    assert share["digests"] == len({d.upper() for _, d in data if d}) and 0 < share["compared"] < share["pairs"]
    assert index.pairs(df.limit(0), "id", "d", 30).count() == 0


def test_cells_of_several_parts(spark, monkeypatch):
    """Parts far smaller than a cell, and a count of what the index compares that needs no pairs."""
    monkeypatch.setattr(similarity, "DIGESTS", 9)
    data = [(i, d) for i, d in rows() if d]
    df = spark.createDataFrame(data, "id int, d string")
    all_ = lambda ds: similarity.tlsh_distances(*[similarity.pd.DataFrame({"d": ds})] * 2)
    far = all_([d.upper() for _, d in data])
    got = Counter((r["a"], r["b"], r["distance"]) for r in similarity.tlsh_pairs(df, "id", "d", 30).collect())
    assert got == {(a, b, far[i, j]): 1 for i, (a, _) in enumerate(data) for j, (b, _) in enumerate(data) if a < b and far[i, j] <= 30}
    heads = all_(["T100" + d[4:8] + "0" * 64 for d in sorted({d.upper() for _, d in data})])
    assert index.share_compared(df, "d", 30).first()["compared"] == np.triu(heads <= 30, 1).sum()


def test_half_bodies_settle_by_distance(monkeypatch):
    """Sixteen steps of two in the first half are too far by themselves, as are header and half together; whole bodies are not looked at."""
    seen, whole = [], similarity._bodies
    monkeypatch.setattr(similarity, "_bodies", lambda x, y: seen.append(len(x)) or whole(x, y))
    raw = lambda *heads: similarity.pd.Series([bytes.fromhex("000000" + h + "00" * (32 - len(h) // 2)) for h in heads])
    i, j, d = similarity.near_in(raw("00"), raw("AA" * 4), 30)
    assert sum(seen) == 0 and len(i) == len(j) == len(d) == 0
    far = similarity.pd.Series([bytes.fromhex("000020" + "5555555555" + "00" * 27)])
    assert similarity.near_in(raw("00"), far, 30)[2].tolist() == [] and sum(seen) == 0
    assert similarity.near_in(raw("00"), raw("AA" * 3 + "55" + "03"), 40)[2].tolist() == [34]
