"""Ordered ranges and stage manifests against plain loops: hot keys, ties, nulls, empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lurescope.operators import manifests, ranges


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    key = lambda: r.choice([7, 7, 7, 7, 1, 2, None])
    return [(key(), r.choice([r.randrange(60), None]) if r.random() < 0.1 else r.randrange(60), i) for i in range(400)]


def test_last_before(spark, rows):
    left = spark.createDataFrame([(*x, "kept") for x in rows[:150]], "k int, at long, id int, got string").withColumnRenamed("got", "note")
    right = spark.createDataFrame(rows[150:], "k int, at long, id int").withColumn("got", F.col("id") * 10).withColumn("more", F.col("at"))
    want = Counter()
    for k, at, i in rows[:150]:
        able = [(b, j) for c, b, j in rows[150:] if k is not None and at is not None and c == k and b is not None and b <= at]
        best = max(able, default=None)
        want[k, at, i, "kept", best and best[1] * 10, best and best[0]] += 1
    got = ranges.as_of(left, right, "k", "at", "id", ["got", "more"])
    assert Counter(map(tuple, got.collect())) == want
    assert ranges.as_of(left.limit(0), right, "k", "at", "id", ["got"]).count() == 0
    lonely = ranges.as_of(left, right.limit(0), "k", "at", "id", ["got"]).collect()
    assert len(lonely) == 150 and all(r["got"] is None for r in lonely)


def test_intervals(spark, rows):
    r = random.Random(6)
    points = spark.createDataFrame(rows, "k int, at long, id int")
    spans = [(r.choice([7, 7, 1, None]), lo, lo + r.choice([0, 1, 2, 3, 5, 8, 60, -1, 64]), j) for j in range(80) for lo in [r.randrange(60)]]
    intervals = spark.createDataFrame(spans, "k int, lo long, hi long, span int")
    want = Counter((k, at, i, lo, hi, j) for k, at, i in rows for c, lo, hi, j in spans if k is not None and k == c and at is not None and lo <= at < hi)
    got = ranges.interval_join(points, intervals, "k", "at", "lo", "hi").select("k", "at", "id", "lo", "hi", "span")
    assert Counter(map(tuple, got.collect())) == want
    assert ranges.interval_join(points, intervals.limit(0), "k", "at", "lo", "hi").count() == 0


def test_rows_are_numbered_over_ranges(spark, rows):
    df = spark.createDataFrame([x for x in rows if x[0] is not None], "k int, at long, id int")
    got = ranges.number_rows(df, [F.asc_nulls_first("at"), F.desc("id")], ["k"], count="n").collect()
    for k in (1, 2, 7):
        mine = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0, -x[2]))
        assert [r["id"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["idx"])] == [x[2] for x in mine]
        assert {r["n"] for r in got if r["k"] == k} == {len(mine)}


def test_resources_go_to_stages(spark):
    navs = spark.createDataFrame([(1, 10, 100, "u0"), (1, 20, 101, "u1"), (1, 20, 102, "u2"), (2, 5, 103, "v0"), (None, 1, 104, "w")], "kit int, at long, id int, url string")
    res = [(1, 5, 1, "a"), (1, 10, 2, "a"), (1, 19, 3, "b"), (1, 20, 4, "a"), (1, 99, 5, None), (1, None, 6, "a"), (1, 15, 7, "logged"), (2, 4, 8, "logged"), (3, 4, 9, "a"), (None, 4, 10, "a")]
    log = spark.createDataFrame([(1, 3, 2, "logged", 9), (1, 2, 1, "logged", 0), (1, 1, 0, "logged", None), (2, 1, 3, None, 4)], "kit int, at long, id int, url string, doc_seq int")
    got = manifests.attribute(spark.createDataFrame(res, "kit int, at long, id int, url string"), navs, log, "kit", "at", "id").collect()
    assert {r["id"]: (r["seq"], r["found_by"]) for r in got} == {
        1: (2, "last"), 2: (0, "time"), 3: (0, "time"), 4: (2, "time"), 5: (2, "time"), 6: (0, "none"), 7: (0, "log"), 8: (0, "last"), 9: (0, "none"), 10: (0, "none"),
    }
    responses = spark.createDataFrame([(1, 11, 1, "u0", 200), (1, 30, 2, "u0", 302), (1, 12, 3, "u2", 200)], "kit int, at long, id int, url string, status int")
    made = {(r["kit"], r["seq"]): r for r in manifests.manifest(navs, responses, "kit", "at", "id").collect()}
    assert len(made) == 4 and made[1, 0]["status"] == 302 and made[1, 0]["body"] == "response" and made[1, 1]["body"] == "none" and made[1, 2]["body"] == made[2, 0]["body"] == "rendered"
    assert [made[k]["ended"] for k in ((1, 0), (1, 1), (1, 2), (2, 0))] == [20, 20, 30, 5] and made[1, 0]["nav_method"] == "initial" and made[1, 1]["nav_method"] is None
    hops = spark.createDataFrame([(1, 1, 1, "a", 301), (1, 2, 2, "b", 200), (2, 1, 3, "c", None)], "kit int, at long, id int, url string, status int")
    shown = sorted((r["kit"], r["seq"], r["url"], r["nav_method"], r["status"], r["terminal"]) for r in manifests.hop_stages(hops, "kit", "at", "id").fillna(-1, ["status"]).collect())
    assert shown == [(1, 0, "a", "initial", 301, False), (1, 1, "b", "js_location", 200, False), (1, 2, "b", "js_location", 200, True), (2, 0, "c", "initial", -1, False), (2, 1, "c", "js_location", 200, True)]
    assert manifests.manifest(navs.limit(0), responses, "kit", "at", "id").count() == 0
