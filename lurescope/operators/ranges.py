"""Order over ranges: numbering, last-before joins and interval joins in which no key has to be in one task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurescope.session import shared_folder

#: Spark's setting that removes shuffle files when the query that made them ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, computes once.

    What was shuffled for it is needed no more and is removed from the executors' disks.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANED)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def in_ranges(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """``rows`` dealt by ranges of group and order and written, with the range's number in ``_range``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def number_rows(rows: DataFrame, order: list, group: list[str] | None = None, to: str = "idx", count: str | None = None) -> DataFrame:
    """``rows`` with their place, from 0, in ``order`` within ``group``; in ``count``, if given, how many the group has.

    Ranges are counted, and places are those in a range plus the sizes of the ranges before
    it. Group columns hold no nulls. ``order`` tells rows apart, or the order of equal ones
    doesn't matter; they then share a range.
    """
    group = group or []
    ranged = in_ranges(rows, group, order)
    sizes = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_size"))
    ranges = W.partitionBy(*(group or [F.lit(0)]))
    before = F.coalesce(F.sum("_size").over(ranges.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).withColumn("_all", F.sum("_size").over(ranges)).drop("_size")
    place = F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order)) - 1 + F.col("_before")
    out = ranged.join(sizes, [*group, "_range"]).withColumn(to, place.cast("long"))
    return (out.withColumn(count, F.col("_all")) if count else out).drop("_range", "_before", "_all")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, tie: str, take: list[str], right_at: str | None = None, right_tie: str | None = None) -> DataFrame:
    """Every row of ``left`` with ``take`` of the last row of ``right`` of its key at its time or before.

    Rows of one time on the right are ordered by ``right_tie``; ``tie`` tells rows of the
    left apart. Both sides are sorted together by ranges; a range takes the last right row
    of each key before it from the ranges' summaries, one row for each key in a range.
    Without such a row ``take`` is null. Null keys and times match nothing and stay.
    """
    right_at, right_tie = right_at or at, right_tie or tie
    able = left.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    lone = left.filter(F.col(key).isNull() | F.col(at).isNull())
    held = F.struct(*[F.col(c).alias(c) for c in take])
    kind = right.select(held.alias("x")).schema["x"].dataType
    l = able.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(kind).alias("_held"), F.struct(*left.columns).alias("_row"))
    r = right.filter(F.col(key).isNotNull() & F.col(right_at).isNotNull())
    r = r.select(F.col(key).alias("_k"), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(right_tie).alias("_tie"), held.alias("_held"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"))
    both = in_ranges(r.unionByName(l), ["_k"], ["_at", "_side", "_tie"])
    last = both.filter("_side = 0").groupBy("_k", "_range").agg(F.max_by("_held", F.struct("_at", "_tie")).alias("_last"))
    held_ranges = both.select("_k", "_range").distinct().join(last, ["_k", "_range"], "left")
    carried = held_ranges.withColumn("_carry", F.last("_last", ignorenulls=True).over(W.partitionBy("_k").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))).drop("_last")
    inside = F.last("_held", ignorenulls=True).over(W.partitionBy("_k", "_range").orderBy("_at", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("_in", inside).filter("_side = 1").join(carried, ["_k", "_range"])
    out = found.select("_row.*", F.coalesce("_in", "_carry").alias("_got")).select(*left.columns, *[F.col(f"_got.{c}").alias(c) for c in take])
    return out.unionByName(lone.select(*left.columns, *[F.lit(None).cast(kind[c].dataType).alias(c) for c in take]))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, lo: str, hi: str) -> DataFrame:
    """Points in [lo, hi) of an interval of the same key; times are whole numbers from 0.

    An interval is laid into blocks of the least power of two that is as long, of which it
    meets two at most; a point looks into its block of each size that there is. A hot key
    is so divided by time, and an interval meets no points that are further off than its
    own length. Columns of both sides but the key differ. Empty intervals hold nothing.
    """
    size = F.when(F.col(hi) - F.col(lo) <= 1, 0).otherwise(F.length(F.bin(F.col(hi) - F.col(lo) - 1)))
    laid = intervals.filter(F.col(hi) > F.col(lo)).withColumn("_size", size.cast("int"))
    shift = lambda c: F.call_function("shiftright", F.col(c).cast("long") if isinstance(c, str) else c, F.col("_size"))
    sizes = laid.agg(F.collect_set("_size").alias("_sizes"))  # at most 64 numbers
    laid = laid.withColumn("_block", F.explode(F.sequence(shift(lo), shift(F.col(hi).cast("long") - 1))))
    looking = points.crossJoin(F.broadcast(sizes)).withColumn("_size", F.explode("_sizes")).drop("_sizes").withColumn("_block", shift(at))
    return looking.join(laid, [key, "_size", "_block"]).filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_size", "_block")


def summed_in_spans(points: DataFrame, spans: DataFrame, id_col: str, at: str, size: int) -> DataFrame:
    """stage, events, first_id: how many ``points`` are in [lo, lo + size) of each of ``spans`` (stage, lo) and their smallest id; spans without any are left out.

    A span is the end of one block of ``size`` and the start of the next, so running counts
    from both sides of the blocks give its sums and no point meets a span.
    """
    start = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(size))
    no = F.lit(None).cast("long")
    stage, kind = F.lit(None).cast(spans.schema["stage"].dataType), points.schema[id_col].dataType
    held = points.select(start(at).alias("_block"), F.col(at).alias("_at"), stage.alias("stage"), F.col(id_col).alias("_id"))
    ask = lambda block, when: spans.select(block.alias("_block"), when.alias("_at"), "stage", no.cast(kind).alias("_id"))
    from_lo = W.partitionBy("_block").orderBy(F.desc("_at")).rangeBetween(W.unboundedPreceding, W.currentRow)
    to_hi = W.partitionBy("_block").orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    sums = None
    for rows, frame in ((ask(start("lo"), F.col("lo")), from_lo), (ask(start("lo") + size, F.col("lo") + size), to_hi)):
        both = held.unionByName(rows).withColumn("_n", F.count("_id").over(frame)).withColumn("_first", F.min("_id").over(frame))
        part = both.filter("stage is not null").select("stage", "_n", "_first")
        sums = part if sums is None else sums.unionByName(part)
    return sums.groupBy("stage").agg(F.sum("_n").alias("events"), F.min("_first").alias("first_id")).filter("events > 0")
