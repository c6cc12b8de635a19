"""A kit's chain of steps as keyed state with event-time timers, and the same rows by batch.

Steps arrive in any order and may repeat. They are held until the watermark passes them and
then taken in the order of their times, so how a stream is cut into batches changes nothing.
A chain that stalls after a step is resumed from its cursor after one timeout, or queued anew
after another where it has no cursor yet; a last step ends the attempt, and the next step
begins another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lurescope.session import shared_folder

OUT = "kit_id long, attempt int, at timestamp, kind string, step string, cursor int"
MINUTE = 60_000_000


@dataclass(frozen=True)
class Chain:
    """The steps of a chain in order, which of them end it, and how long a stall may last.

    A cursor is the place of the furthest step, from 1; the first ``fresh`` steps leave none.
    """

    steps: tuple[str, ...] = ("signup", "view", "click", "purchase", "error")
    last: tuple[tuple[str, str], ...] = (("purchase", "complete"), ("error", "fail"))
    fresh: int = 1
    resume_after: int = 10 * MINUTE
    requeue_after: int = 30 * MINUTE

    def place(self, step: str) -> int:
        return self.steps.index(step) + 1 if step in self.steps else 0


class Progress:
    """One kit's chain, taking steps in order of time; times are in microseconds."""

    def __init__(self, chain: Chain, attempt: int = 1, furthest: int = 0, due: int = -1, kind: str = "", step: str = ""):
        self.chain, self.attempt, self.furthest, self.due, self.kind, self.step = chain, attempt, furthest, due, kind, step

    def state(self) -> tuple:
        return self.attempt, self.furthest, self.due, self.kind, self.step

    def cursor(self) -> int | None:
        return self.furthest if self.furthest > self.chain.fresh else None

    def wait(self, until: int) -> Iterator[tuple]:
        """What a time before ``until`` brings if no step comes."""
        if 0 <= self.due < until:
            yield self.attempt, self.due, self.kind, self.step, self.cursor()
            self.due = -1

    def take(self, at: int, step: str) -> Iterator[tuple]:
        """What a step brings; a stall ends at its timeout only if no step comes at that very time."""
        yield from self.wait(at)
        self.furthest, self.step = max(self.furthest, self.chain.place(step)), step
        ends = dict(self.chain.last)
        if step in ends:
            yield self.attempt, at, ends[step], step, self.cursor()
            self.attempt, self.furthest, self.due = self.attempt + 1, 0, -1
        elif self.cursor() is None:
            self.due, self.kind = at + self.chain.requeue_after, "requeue"
        else:
            self.due, self.kind = at + self.chain.resume_after, "resume"


class ChainProcessor(StatefulProcessor):
    """Holds a kit's steps until the watermark has passed them; one timer waits for what comes first."""

    def __init__(self, chain: Chain):
        self.chain = chain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, event_id long, step string")
        self.now = handle.getValueState("now", "attempt int, furthest int, due long, kind string, step string, passed long")

    def _go(self, key, new: set[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        state = self.now.get() if self.now.exists() else None
        progress, passed = Progress(self.chain, *state[:5]) if state else Progress(self.chain), state[5] if state else -1
        held = set(map(tuple, self.held.get())) if self.held.exists() else set()
        # A step not later than what was taken already is late, and a known one is a repeat.
        held |= {x for x in new if x[0] > passed}
        limit, rows = watermark_ms * 1000, []
        ready = sorted(x for x in held if x[0] <= limit)
        for at, _, step in ready:
            rows += progress.take(at, step)
        rows += progress.wait(limit)
        held.difference_update(ready)
        waits = [x for x in (progress.due, min(held)[0] if held else -1) if x >= 0]
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if waits:
            # A timer is past when the watermark is, so no step or stall of its millisecond is missed.
            self.handle.registerTimer(max(-(-(min(waits) + 1) // 1000), watermark_ms + 1))
        self.held.put(sorted(held)) if held else self.held.clear()
        self.now.update((*progress.state(), max(passed, limit if watermark_ms > 0 else -1)))
        if rows:
            out = pd.DataFrame(rows, columns=["attempt", "at", "kind", "step", "cursor"])
            out.insert(0, "kit_id", key[0])
            out["at"] = pd.to_datetime(out["at"], unit="us")
            out["cursor"] = out["cursor"].astype("Int32")
            yield out.astype({"attempt": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = {(int(a), int(i), s) for r in rows for a, i, s in zip(r["at_us"], r["event_id"], r["step"])}
        yield from self._go(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go(key, set(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def follow(steps: DataFrame, chain: Chain, delay: str) -> DataFrame:
    """The rows of OUT that a stream of kit_id, event_id, step, at brings; steps later than ``delay`` are lost."""
    timed = steps.withWatermark("at", delay).withColumn("at_us", F.unix_micros("at"))
    return timed.groupBy("kit_id").transformWithStateInPandas(ChainProcessor(chain), OUT, "Append", "EventTime")


def file_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream over a table of Parquet files, or over a single file, which is picked from its folder by name."""
    landed = spark.read.parquet(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    stream = spark.readStream.schema(landed.schema).options(**options)
    single = [f.rsplit("/", 1)[1] for f in landed.inputFiles()] == [name]
    return stream.option("pathGlobFilter", name).parquet(folder) if single else stream.parquet(path)


def follow_all(spark: SparkSession, source, steps_of, chain: Chain = Chain(), folder: str | None = None, delay: str = "1 day", close: bool = True) -> DataFrame:
    """Run the stream over all that ``source()`` (a streaming DataFrame) has now, and return all rows so far.

    ``steps_of`` selects kit_id, event_id, step, at of it. ``folder`` keeps the stream's log,
    state and rows: a later run goes on there, a new folder replays all to the same rows.
    With ``close`` a mark long after the last step moves the watermark past all steps and
    stalls, after which the stream takes no more.
    """
    folder = (folder or f"{shared_folder(spark)}/chain-{uuid.uuid4().hex[:12]}").rstrip("/")
    kind = "kit_id long, event_id long, step string, at timestamp"
    spark.createDataFrame([], kind).write.mode("ignore").parquet(f"{folder}/marks")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run() -> None:
        marks = spark.readStream.schema(kind).parquet(f"{folder}/marks")
        rows = follow(steps_of(source()).unionByName(marks), chain, delay)
        rows.filter("kit_id is not null").writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    try:
        run()
        if close:
            spark.sql("select cast(null as long) as kit_id, cast(-1 as long) as event_id, '' as step, timestamp'2262-01-01' as at").write.mode("append").parquet(f"{folder}/marks")
            run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(OUT).parquet(f"{folder}/rows")


def chain_rows(steps: DataFrame, chain: Chain = Chain()) -> DataFrame:
    """The rows of OUT for a table of kit_id, event_id, step, at, by windows over each kit's steps."""
    once = steps.filter("kit_id is not null").select("kit_id", "event_id", "step", "at").distinct()
    order = W.partitionBy("kit_id").orderBy("at", "event_id", "step")
    names = F.array(*map(F.lit, chain.steps))
    ends = F.create_map(*[F.lit(x) for pair in chain.last for x in pair])
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = once.withColumn("end", F.get(F.transform(F.array("step"), lambda x: ends[x]), F.lit(0))).withColumn("place", F.array_position(names, F.col("step")).cast("int")).withColumn("next", F.lead("at").over(order))
    s = s.withColumn("attempt", (F.coalesce(F.count("end").over(before), F.lit(0)) + 1).cast("int"))
    s = s.withColumn("furthest", F.max("place").over(W.partitionBy("kit_id", "attempt").orderBy("at", "event_id", "step").rowsBetween(W.unboundedPreceding, 0)))
    cursor = F.when(F.col("furthest") > chain.fresh, F.col("furthest"))
    wait = F.when(cursor.isNull(), F.lit(chain.requeue_after)).otherwise(F.lit(chain.resume_after))
    due = F.timestamp_micros(F.unix_micros("at") + wait)
    stalled = s.filter(F.col("end").isNull() & (F.col("next").isNull() | (due < F.col("next"))))
    kind = F.when(cursor.isNull(), "requeue").otherwise("resume")
    out = lambda d, at, kind: d.select("kit_id", "attempt", at.alias("at"), kind.alias("kind"), "step", cursor.alias("cursor"))
    return out(stalled, due, kind).unionByName(out(s.filter("end is not null"), F.col("at"), F.col("end")))
