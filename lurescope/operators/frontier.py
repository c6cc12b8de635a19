"""Level by level from root pages along their links, with budgets, each address once in an investigation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurescope.functions.urls import normalized
from lurescope.operators.ranges import number_rows, staged

#: Kinds of links in the order in which a kit follows them.
SOURCES = ("redirect", "eml_link", "qr_code", "svg_chain_terminal")


def expand(roots: DataFrame, links: DataFrame, max_depth: int = 5, per_kit: int = 10, per_investigation: int | None = None) -> DataFrame:
    """investigation_id, url, parent_url, depth, source, rank of every page that the expansion reaches, roots at depth 0.

    ``roots``: investigation_id, url. ``links``: url, target, source, position. A kit
    follows its first ``per_kit`` targets that are web addresses other than its own, by
    kind and position, each address once. Of those, an investigation takes the ones it
    has not seen, compared as normalised, at any level: of one level's parents the first
    in order of address counts, and with ``per_investigation`` no more than are left of
    that number, roots included. Levels are written, so a level reads only the one
    before; pages seen are joined by investigation and address. No links, no level.
    """
    order = F.coalesce(F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")).cast("int"), F.lit(0))
    able = links.filter(F.col("target").rlike("^https?://") & (F.col("target") != F.col("url")) & (order > 0)).withColumn("_o", F.struct(order.alias("kind"), "position"))
    once = able.groupBy("url", "target").agg(F.min("_o").alias("_o"))
    rank = F.row_number().over(W.partitionBy("url").orderBy("_o", "target"))
    followed = once.withColumn("rank", rank).filter(F.col("rank") <= per_kit)
    kind = F.element_at(F.array(*map(F.lit, SOURCES)), F.col("_o.kind"))
    followed = staged(followed.select("url", "target", kind.alias("source"), "rank"), "links")

    first = roots.filter("url is not null").groupBy("investigation_id", normalized(F.col("url")).alias("_key")).agg(F.min("url").alias("url"))
    none = F.lit(None).cast("string")
    levels = [_within(first.withColumn("parent_url", none).withColumn("depth", F.lit(0)).withColumn("source", none).withColumn("rank", F.lit(None).cast("int")), None, per_investigation)]
    for depth in range(1, max_depth + 1):
        met = levels[-1].select("investigation_id", F.col("url").alias("parent_url")).join(followed, F.col("parent_url") == F.col("url")).drop("url")
        met = met.withColumn("_key", normalized(F.col("target")))
        new = met.groupBy("investigation_id", "_key").agg(F.min(F.struct("parent_url", "rank", "target", "source")).alias("_m"))
        seen = reduce(DataFrame.unionByName, levels).select(F.col("investigation_id").alias("_i"), F.col("_key").alias("_k"))
        new = new.join(seen, F.col("investigation_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left_anti")
        new = new.select("investigation_id", "_key", F.col("_m.target").alias("url"), F.col("_m.parent_url").alias("parent_url"), F.lit(depth).alias("depth"), F.col("_m.source").alias("source"), F.col("_m.rank").alias("rank"))
        level = _within(new, levels, per_investigation)
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).drop("_key")


def _within(new: DataFrame, before: list[DataFrame] | None, budget: int | None) -> DataFrame:
    """The pages of a level that the investigation's budget has room for, in order of parent and rank."""
    columns = ["investigation_id", "_key", "url", "parent_url", "depth", "source", "rank"]
    new = new.select(*columns)
    if budget is None:
        return staged(new, "level")
    # A key without nulls for the investigation, so that pages without one share a budget too.
    keyed = new.withColumn("_g", F.coalesce(F.col("investigation_id").cast("string"), F.lit("")))
    placed = number_rows(keyed, [F.asc("parent_url"), F.asc("rank"), F.asc("_key")], ["_g"])
    if before:
        used = reduce(DataFrame.unionByName, before).groupBy(F.coalesce(F.col("investigation_id").cast("string"), F.lit("")).alias("_g")).agg(F.count(F.lit(1)).alias("_used"))
        placed = placed.join(used, "_g", "left")
    else:
        placed = placed.withColumn("_used", F.lit(0))
    return staged(placed.filter(F.col("idx") + F.coalesce("_used", F.lit(0)) < budget).select(*columns), "level")
