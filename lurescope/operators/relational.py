"""Filters, junction joins, dashboards, windows and set operations over the model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ilike_any(text: str, *columns: str) -> Column:
    """Whether any of the columns contains ``text``, ignoring case."""
    return reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{text}%") for c in columns))


def page(df: DataFrame, order: Sequence[str | Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a total order; limits from 1 to 500."""
    if offset < 0 or not 1 <= limit <= 500:
        raise ValueError("offset must be 0 or more, limit 1 to 500")
    return df.orderBy(*order).offset(offset).limit(limit)


def newest_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def count_by(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """Rows per key, most first, ties by key."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), *keys).limit(n) if n else out


#: Rows of one input that a task of ``dealt`` gets, about.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys to so many tasks that each gets about TASK_ROWS, so a task's memory stays as tables grow."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(tasks, *keys)


def through(members: DataFrame, junction: DataFrame, key: str) -> DataFrame:
    """Members reached by a junction, once for each link."""
    return members.join(junction, key)


def sharing(junction_a: DataFrame, junction_b: DataFrame, key: str, *out: str) -> DataFrame:
    """Distinct pairs of two junctions that share a key."""
    return junction_a.join(junction_b, key).select(*out).distinct()


def collapse_runs(df: DataFrame, key: str, order: Sequence[str], token: str) -> DataFrame:
    """Each key's tokens in order without immediate repeats, as an array."""
    before = F.lag(token).over(Window.partitionBy(key).orderBy(*order))
    kept = df.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(token)))
    ordered = F.array_sort(F.collect_list(F.struct(*order, token)))
    return kept.groupBy(key).agg(F.transform(ordered, lambda x: x[token]).alias("tokens"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty, 0 if one is."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def three_way_diff(desired: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """insert, update, delete or unchanged for each key of either side."""
    d = desired.select(key, F.col(value).alias("new"), F.lit(True).alias("in_new"))
    c = current.select(key, F.col(value).alias("old"), F.lit(True).alias("in_old"))
    action = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "delete").when(F.col("new").eqNullSafe(F.col("old")), "unchanged").otherwise("update")
    return d.join(c, key, "full_outer").select(key, "new", "old", action.alias("action"))


def merge_fields(current: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Changed rows over current ones; blank and null fields never overwrite; new keys are added."""
    c = changes.select(key, *(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias(f"_{f}") for f in fields))
    return current.join(c, key, "full_outer").select(key, *(F.coalesce(f"_{f}", f).alias(f) for f in fields))


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the latest by ``order`` of both sides; a change wins a tie."""
    both = current.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    return newest_per_key(both, keys, F.desc(order), F.desc("_side")).drop("_side")


def within_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str, lo: str, hi: str) -> DataFrame:
    """Points in [lo, hi) of an interval of the same key."""
    return points.join(intervals, key).filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi)))


def domain_suffixes(domain: Column) -> Column:
    """a.b.c to [a.b.c, b.c, c], so that a suffix match is an equality join."""
    labels = F.split(F.lower(domain), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def set_verdict(score: Column) -> Column:
    """What a Jaccard says of two sets."""
    return F.when(score >= 0.9, "same").when(score >= 0.3, "similar").otherwise("different")


def seconds_of(duration: Column) -> Column:
    """A literal like 30m as seconds; null for anything else."""
    n = F.regexp_extract(duration, r"^(\d{1,9})[smhd]$", 1)
    unit = F.substring(duration, -1, 1)
    each = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400)
    return F.when(n != "", n.cast("long") * each)


def split_email(df: DataFrame, col: str) -> DataFrame:
    """Valid addresses (one @, a dot in the domain) with mailbox, domain and whether it is a service's."""
    parts = F.split(F.col(col), "@")
    valid = df.filter((F.size(parts) == 2) & F.contains(F.get(parts, F.lit(1)), F.lit(".")))
    mailbox = parts[0]
    service = mailbox.rlike(r"^(?:no-?reply|do-?not-?reply|admin|support|info|postmaster|webmaster|abuse)$")
    return valid.select(F.col(col).alias("email"), mailbox.alias("mailbox"), parts[1].alias("domain"), service.alias("service"))
