"""Trees of kits, level by level, and connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.operators.ranges import staged
from lurescope.session import shared_folder


#: Rows of a level that are sent to all tasks; larger levels are shuffled.
SENT = 200_000


def descendants(kits: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, kit_id, depth) of each root's subtree, the root itself at depth 0. ``roots`` has kit_id.

    The links of parents are written once, and so is each level, to whatever depth there
    is; levels of at most SENT rows are broadcast to the links, so that these aren't
    shuffled. A kit that a cycle leads to again is not visited again.
    """
    down = staged(kits.filter("parent_kit_id is not null").select(F.col("parent_kit_id").alias("up"), F.col("kit_id").alias("child")), "links")
    levels = [staged(roots.select(F.col("kit_id").alias("root"), "kit_id", F.lit(0).alias("depth")).distinct(), "level")]
    rows = [levels[0].count()]
    way = lambda df, n: F.broadcast(df) if n <= SENT else df.hint("merge")
    while rows[-1]:
        below = down.join(way(levels[-1], rows[-1]), F.col("kit_id") == F.col("up")).select("root", F.col("child").alias("kit_id"), F.lit(len(levels)).alias("depth"))
        seen = reduce(DataFrame.unionByName, levels).select("root", "kit_id")
        levels.append(staged(below.distinct().join(way(seen, sum(rows)), ["root", "kit_id"], "left_anti"), "level"))
        rows.append(levels[-1].count())
    found = reduce(DataFrame.unionByName, levels)
    return found if sum(rows) <= SENT else found.hint("merge")


def ancestors(kits: DataFrame, subjects: DataFrame, max_depth: int = 5) -> DataFrame:
    """(kit_id, ancestor, depth) up to ``max_depth`` steps, the parent at depth 1."""
    up = kits.select(F.col("kit_id").alias("child"), F.col("parent_kit_id").alias("up"))
    level = subjects.select("kit_id").join(up, F.col("kit_id") == F.col("child")).filter("up is not null").select("kit_id", F.col("up").alias("ancestor"), F.lit(1).alias("depth"))
    out = level
    for depth in range(2, max_depth + 1):
        level = level.join(up, F.col("ancestor") == F.col("child")).filter("up is not null").select("kit_id", F.col("up").alias("ancestor"), F.lit(depth).alias("depth"))
        out = out.unionByName(level)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (v, label): the smallest vertex each vertex reaches, by hooking and shortcutting."""
    _checkpoint_dir(edges)
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("u", "v").checkpoint()
    labels = both.groupBy("u").agg(F.min("v").alias("near")).select(F.col("u").alias("v"), F.least("u", "near").alias("label"))
    while True:
        sent = both.join(labels.select(F.col("v").alias("u"), F.col("label").alias("of_u")), "u").groupBy("v").agg(F.min("of_u").alias("best"))
        hooked = labels.join(sent, "v").select("v", F.col("label").alias("old"), F.least("label", "best").alias("l"))
        jump = hooked.select(F.col("v").alias("l"), F.col("l").alias("next"))
        after = hooked.join(jump, "l").select("v", "old", F.least("l", "next").alias("label")).checkpoint()
        labels = after.drop("old")
        if after.filter("label <> old").isEmpty():
            return labels


def _checkpoint_dir(df: DataFrame) -> None:
    """Checkpoints go to spark.checkpoint.dir; a folder of our own only where that is unset."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
