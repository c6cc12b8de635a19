"""The stateful chain: streams in random batches against windows and against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest

from lurescope.streaming import chain as ch

KIND = "kit_id long, event_id long, step string, at timestamp"
T0 = datetime(2024, 1, 1)


def steps(seed, kits=6, n=120):
    r = random.Random(seed)
    names = ["signup", "view", "click", "purchase", "error", "unknown"]
    out = [(r.randrange(kits), i, r.choice(names), T0 + timedelta(minutes=r.choice([0, 5, 10, 11, 30, 31]) + r.randrange(600), microseconds=r.choice([0, 0, 1, 999_999]))) for i in range(n)]
    return out + r.sample(out, 20)


def plain(rows, chain=ch.Chain()):
    out = []
    for kit in {r[0] for r in rows}:
        progress, us = ch.Progress(chain), lambda t: (t - T0) // timedelta(microseconds=1)
        for at, _, step in sorted({(us(t), i, s) for k, i, s, t in rows if k == kit}):
            out += [(kit, *x) for x in progress.take(at, step)]
        out += [(kit, *x) for x in progress.wait(1 << 60)]
    return sorted(((k, a, T0 + timedelta(microseconds=at), kind, step, cursor) for k, a, at, kind, step, cursor in out), key=repr)


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_equals_a_plain_loop(spark, seed):
    rows = steps(seed)
    assert shown(ch.chain_rows(spark.createDataFrame(rows, KIND))) == plain(rows)


def test_a_stall_ends_where_a_step_comes_in_time(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [(1, 1, "signup", at(0)), (1, 2, "view", at(30)), (1, 3, "click", at(41)), (1, 4, "purchase", at(41)), (2, 5, "signup", at(0)), (2, 6, "error", at(31)), (None, 7, "view", at(0))]
    got = shown(ch.chain_rows(spark.createDataFrame(rows, KIND)))
    assert got == sorted([(1, 1, at(40), "resume", "view", 2), (1, 1, at(41), "complete", "purchase", 4), (2, 1, at(30), "requeue", "signup", None), (2, 1, at(31), "fail", "error", 5)], key=repr)
    assert ch.chain_rows(spark.createDataFrame([], KIND)).count() == 0


def test_random_batches_restart_and_replay_give_the_same_rows(spark, tmp_path):
    rows = steps(7)
    want = plain(rows)
    r = random.Random(3)

    def land(folder, parts):
        for part in parts:
            spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(folder)

    source = lambda folder: lambda: spark.readStream.schema(KIND).option("maxFilesPerTrigger", 2).parquet(folder)
    shuffled = rows[:]
    r.shuffle(shuffled)
    cut = sorted(r.sample(range(1, len(rows)), 4))
    parts = [shuffled[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])]
    # In any order within the delay, with a stop after two of the batches.
    landed, state = f"file://{tmp_path}/one", f"file://{tmp_path}/state"
    land(landed, parts[:2])
    first = ch.follow_all(spark, source(landed), lambda d: d, folder=state, delay="1 day", close=False)
    assert set(shown(first)) <= set(want)
    land(landed, parts[2:])
    assert shown(ch.follow_all(spark, source(landed), lambda d: d, folder=state, delay="1 day")) == want
    # Replayed from the start, in the order of time with a short delay, so that timers pass as the stream goes.
    landed = f"file://{tmp_path}/two"
    ordered = sorted(rows, key=lambda x: x[3])
    land(landed, [ordered[i : i + 40] for i in range(0, len(ordered), 40)])
    assert shown(ch.follow_all(spark, source(landed), lambda d: d, delay="1 minute")) == want
