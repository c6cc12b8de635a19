"""Steps whose memory or shuffle must not grow faster than their input."""

import random

from lurescope.operators import attribution as at
from lurescope.operators import graph, ranges, scoring, similarity


def test_levels_sent_or_shuffled(spark, monkeypatch):
    """Broadcast and shuffled levels find the same; a cycle ends."""
    kits = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 4), (7, 6), (6, 7), (8, 6)], "kit_id long, parent_kit_id long")
    want = {(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 3), (6, 6, 0), (6, 7, 1), (6, 8, 1)}
    for sent in (graph.SENT, 1):
        monkeypatch.setattr(graph, "SENT", sent)
        got = [tuple(r) for r in graph.descendants(kits, kits.filter("kit_id in (1, 6)").select("kit_id")).collect()]
        assert set(got) == want and len(got) == len(want)


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(scoring, "PAIRS", 50)
    rows = spark.createDataFrame([(i, "R", str(i % 3)) for i in range(60)], "kit_id long, type string, value string")
    out = scoring.shared_indicator_scores(rows, {"R": 30}, 8)
    assert out.rdd.getNumPartitions() >= 24 and out.count() == 3 * 20 * 19 // 2
    actors = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "kit_id long, actor long")
    both = scoring.shared_indicator_scores(rows, {"R": 30}, 8, ordered=False)
    top = scoring.rank_entities(both, actors, "actor").filter("kit_id = 0").collect()
    assert [(r["actor"], r["score"], r["supporting"]) for r in top] == [(1, 30, 10), (0, 30, 9)]


def test_token_sets_are_judged_where_they_meet(spark):
    r = random.Random(4)
    data = [(i, f"g{i % 2}", sorted(r.sample("abcdefghijkl", r.randint(7, 12)))) for i in range(70)] + [(70, "g0", []), (71, None, ["a"])]
    df = spark.createDataFrame(data, "id long, g string, w array<string>")
    score = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    for least in (0.6, 0.85, 1.0):
        out = similarity.token_pairs(df, "id", "g", "w", least)
        want = {(a, b, score(x, y)) for a, g, x in data for b, h, y in data if a < b and g == h and x and y and score(x, y) >= least}
        assert {tuple(x) for x in out.collect()} == want and want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3


def test_spans_without_meetings(spark):
    r = random.Random(5)
    points = [(i, r.randrange(-500, 1000)) for i in range(300)] + [(900, 100), (901, 200), (902, -100)]
    spans = [(i, r.randrange(-500, 1000)) for i in range(60)] + [(60, 100), (61, 5000), (62, -200)]
    got = ranges.summed_in_spans(spark.createDataFrame(points, "id long, t long"), spark.createDataFrame(spans, "stage long, lo long"), "id", "t", 100).collect()
    want = {s: [i for i, t in points if lo <= t < lo + 100] for s, lo in spans}
    assert {(x["stage"], x["events"], x["first_id"]) for x in got} == {(s, len(v), min(v)) for s, v in want.items() if v}


def test_suggestions_without_pairs_of_one_rule(spark):
    """The same as over every pair, where entities have many kits above a rule's points, few, or none."""
    r = random.Random(8)
    frame = spark.createDataFrame
    for seldom in (2, 60):
        iocs = [(r.randrange(90), "email", str(r.randrange(30 * seldom))) for _ in range(150)]
        rules = [(r.randrange(90), f"r{r.randrange(12)}") for _ in range(260)]
        roots, hosts = [(r.randrange(90), f"s{r.randrange(200)}") for _ in range(40)], [(r.randrange(90), f"h{r.randrange(200)}") for _ in range(60)]
        keys = at.signal_keys(frame(iocs, "kit_id long, type string, value string"), frame(rules, "kit_id long, rule string"), frame(roots, "kit_id long, root string"), frame(hosts, "kit_id long, host string"))
        near = frame([(*sorted(r.sample(range(90), 2)), r.choice([0, 31, 123, 149, 160])) for _ in range(30)], "a long, b long, distance int")
        able = frame([(k,) for k in range(90) if k % 3], "kit_id long")
        members = frame([(r.randrange(90), r.choice([1, 2, 3, 4, None])) for _ in range(60)] + [(1, 5), (2, 6)], "kit_id long, entity long")
        n = 3 if seldom == 2 else 20
        every = at.staged(at.pair_scores(keys, near, able), "test")
        got, want = at.suggest_from_keys(keys, near, members, able, n=n), at.suggest(every, members, able, n=n)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.columns == want.columns
    beyond = every.join(able.withColumnRenamed("kit_id", "a"), "a", "left_semi").filter("not (yara = 9 and score = 9)")
    assert sorted(map(tuple, at.pairs_beyond_a_rule(keys, near, able).collect())) == sorted(map(tuple, beyond.collect()))


def test_tasks_grow_with_rows(spark, monkeypatch):
    from lurescope.operators import relational
    from lurescope.plans import catalog

    monkeypatch.setattr(relational, "TASK_ROWS", 500)
    rows = spark.range(9000).withColumnRenamed("id", "kit_id")
    assert relational.dealt(rows, "kit_id").rdd.getNumPartitions() == 18
    for name in ("campaign_stats_counts", "family_polymorphism"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [kit_id" in plan and "Expand" not in plan


def test_hashes_meet_once_in_tiles(spark, monkeypatch):
    from lurescope.operators import similarity
    from lurescope.plans import catalog

    monkeypatch.setattr(similarity, "HASHES", 40)
    r = random.Random(5)
    base = [r.getrandbits(64) - 2**63 for _ in range(60)]
    rows = [(i, (base[i % 60] ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63))) if i % 3 else base[i % 60]) for i in range(200)] + [(200, None)]
    got = sorted(tuple(x) for x in similarity.hamming_pairs(spark.createDataFrame(rows, "v long, h long"), "v", "h", 4).collect())
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert got == [(i, j, bits(x, y)) for i, x in rows[:200] for j, y in rows[:200] if i < j and bits(x, y) <= 4] and len(got) > 200
    plan = catalog.QUERIES["ranked_neighbours"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1


def test_meetings_in_slices(spark, monkeypatch):
    """Many slices give what all pairs give, and what one slice shuffled is gone when the next one begins."""
    from pyspark.sql import functions as F

    r = random.Random(9)
    rows = spark.createDataFrame([(r.randrange(80), r.choice("RAN"), r.choice([*map(str, range(40)), "Ab", "aB", None])) for _ in range(400)], "kit_id long, type string, value string")
    actors = spark.createDataFrame([(r.randrange(80), r.randrange(9)) for _ in range(120)], "kit_id long, actor long")
    weights, tags = {"R": 30, "A": 15}, []
    every = scoring.shared_indicator_scores(rows, weights, 8, ordered=False)
    best = sorted((a, max((s, -b) for x, b, s, _ in every.collect() if x == a)) for a in {x["a"] for x in every.collect()})
    ranked = sorted(map(tuple, scoring.rank_entities(every, actors, "actor", n=3).collect()))
    for name, n in (("LEAST_ROUND", 200), ("ROUND", 0), ("BLOCK", 30), ("TILE", 5)):
        monkeypatch.setattr(scoring, name, n)
    written = scoring.staged
    monkeypatch.setattr(scoring, "staged", lambda df, tag: tags.append(tag) or written(df, tag))
    assert sorted((x["kit_id"], (x["score"], -x["peer"])) for x in scoring.best_peers(rows, weights, 8).collect()) == best and tags.count("slice") > 5
    assert sorted(map(tuple, scoring.peer_entities(rows, actors, "actor", weights, 8, n=3).collect())) == ranked
    shuffles = lambda: len(list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()))
    before = shuffles()
    ranges.staged(rows.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "test").collect()
    assert shuffles() <= before


def test_suggestions_in_slices(spark, monkeypatch):
    """Kits of an entity met in several slices, where later ones leave out what can't be among its best, give what all pairs give."""
    r = random.Random(12)
    frame = spark.createDataFrame
    some = lambda n, of: [(r.randrange(60), f"{of}{r.randrange(n)}") for _ in range(130)]
    keys = at.signal_keys(frame([(k, "email", v) for k, v in some(4, "m")], "kit_id long, type string, value string"), frame(some(6, "r"), "kit_id long, rule string"), frame(some(30, "s"), "kit_id long, root string"), frame(some(9, "h"), "kit_id long, host string"))
    near = frame([(*sorted(r.sample(range(60), 2)), r.choice([0, 31, 149, 160])) for _ in range(30)], "a long, b long, distance int")
    able = frame([(k,) for k in range(60) if k % 5], "kit_id long")
    members = frame([(r.randrange(60), r.choice([1, 2, 3, None])) for _ in range(60)] + [(1, 5)], "kit_id long, entity long")
    want = at.suggest(at.staged(at.pair_scores(keys, near, able), "test"), members, able, n=4)
    tags, written = [], at.staged
    monkeypatch.setattr(at, "staged", lambda df, tag: tags.append(tag) or written(df, tag))
    monkeypatch.setattr(at, "SLICE", 1)
    monkeypatch.setattr(at, "BLOCK", 100)
    got = at.suggest_from_keys(keys, near, members, able, n=4)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and tags.count("free") > 2
