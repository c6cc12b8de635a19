"""Whether a rendered kit repeats another: an ancestor nearest first, then a sibling, then any kit of equal content."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.operators.ranges import staged
from lurescope.operators.similarity import tlsh_distance, tlsh_parts

KIT = ["kit_id", "parent_kit_id", "investigation_id", "url", "rendered", "sha", "digest", "created_at"]


@dataclass(frozen=True)
class Closeness:
    """When two digests are close, and a block such that close ones lie at most ``reach`` blocks apart."""

    near: Callable[[Column, Column], Column]
    block: Callable[[Column], Column]
    reach: int = 1


def tlsh_closeness(most: int = 30) -> Closeness:
    """Locality-sensitive digests at most ``most`` apart: lengths that differ by more than most / 12 are too far by themselves."""
    width = max(1, most // 12)
    return Closeness(lambda a, b: tlsh_distance(tlsh_parts(a), tlsh_parts(b)) <= most, lambda d: F.floor(tlsh_parts(d)["l"] / width))


def number_closeness(most: int) -> Closeness:
    return Closeness(lambda a, b: F.abs(a - b) <= most, lambda d: F.floor(d / (most + 1)))


def _others(kits: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """keys, with the first and the second kit of each in order, as structs <prefix>1 and <prefix>2: of any kit's others, one is the first."""
    order = F.struct("created_at", "kit_id")
    held = kits.select(*keys, order.alias("_o"))
    first = held.groupBy(*keys).agg(F.min("_o").alias(f"{prefix}1"))
    second = held.join(first, keys).filter(F.col("_o") > F.col(f"{prefix}1")).groupBy(*keys).agg(F.min("_o").alias(f"{prefix}2"))
    return first.join(second, keys, "left")


def _other(prefix: str) -> Column:
    return F.when(F.col(f"{prefix}1.kit_id") == F.col("kit_id"), F.col(f"{prefix}2")).otherwise(F.col(f"{prefix}1"))


def ancestor_matches(subjects: DataFrame, kits: DataFrame, close: Closeness, max_depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """(found, rest): kit_id, matched, via, depth of subjects that repeat an ancestor, and the other subjects.

    Ancestors are looked at level by level, nearest first, and a subject that matches
    goes no further. Within an ancestor a rendered one's equal address comes first,
    then a close digest, then equal content.
    """
    up = kits.select(F.col("kit_id").alias("matched"), F.col("parent_kit_id").alias("_further"), *[F.col(c).alias(f"_{c}") for c in ("url", "rendered", "sha", "digest")])
    open_, found = subjects.withColumn("_at", F.col("parent_kit_id")), []
    lost = []
    for depth in range(1, max_depth + 1):
        met = open_.join(up, F.col("_at") == F.col("matched"), "left")
        via = F.when(F.col("_rendered") & (F.col("url") == F.col("_url")), "url").when(close.near(F.col("digest"), F.col("_digest")), "digest").when(F.col("sha") == F.col("_sha"), "sha256")
        level = staged(met.withColumn("via", via), "ancestors")
        found.append(level.filter("via is not null").select("kit_id", "matched", "via", F.lit(depth).alias("depth")))
        left = level.filter("via is null").select(*KIT, F.col("_further").alias("_at"))
        lost.append(left.filter("_at is null").drop("_at"))
        open_ = left.filter("_at is not null")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, [*lost, open_.drop("_at")])


def sibling_matches(subjects: DataFrame, kits: DataFrame, close: Closeness) -> DataFrame:
    """kit_id, matched, via of subjects whose parent has another rendered child of close digest or equal content: the first in order.

    Equal content is found from each content's first two kits; digests are joined by
    parent and block, so a parent's children meet those of like blocks only.
    """
    able = kits.filter("rendered and parent_kit_id is not null")
    same = subjects.join(_others(able.filter("sha is not null"), ["parent_kit_id", "sha"], "_s"), ["parent_kit_id", "sha"]).withColumn("_o", _other("_s")).filter("_o is not null").select("kit_id", "_o", F.lit(1).alias("_kind"))
    blocks = F.transform(F.sequence(F.lit(-close.reach), F.lit(close.reach)), lambda k: close.block(F.col("digest")) + k)
    mine = subjects.filter("digest is not null").select("kit_id", "parent_kit_id", "digest", F.explode(blocks).alias("_block"))
    theirs = able.filter("digest is not null").select("parent_kit_id", close.block(F.col("digest")).alias("_block"), F.col("digest").alias("_digest"), F.struct("created_at", "kit_id").alias("_o"))
    near = mine.join(theirs, ["parent_kit_id", "_block"]).filter((F.col("_o.kit_id") != F.col("kit_id")) & close.near(F.col("digest"), F.col("_digest"))).select("kit_id", "_o", F.lit(0).alias("_kind"))
    best = same.unionByName(near).groupBy("kit_id").agg(F.min(F.struct("_o", "_kind")).alias("_b"))
    return best.select("kit_id", F.col("_b._o.kit_id").alias("matched"), F.when(F.col("_b._kind") == 0, "digest").otherwise("sha256").alias("via"))


def content_matches(subjects: DataFrame, kits: DataFrame) -> DataFrame:
    """kit_id, matched, via of subjects whose content another kit has: the first of the same investigation, else the first of all."""
    held = kits.filter("sha is not null")
    own = _others(held.filter("investigation_id is not null"), ["sha", "investigation_id"], "_i")
    every = _others(held, ["sha"], "_e")
    met = subjects.filter("sha is not null").join(own, ["sha", "investigation_id"], "left").join(every, "sha")
    return met.select("kit_id", F.coalesce(_other("_i"), _other("_e")).alias("_o")).filter("_o is not null").select("kit_id", F.col("_o.kit_id").alias("matched"), F.lit("sha256").alias("via"))


def decide(kits: DataFrame, close: Closeness, max_depth: int = 5) -> DataFrame:
    """Per rendered kit that repeats another: kit_id, matched, relation, via, depth, verdict.

    ``kits`` has the columns of KIT. A match of another investigation is a correlation and
    the kit goes on; of its own, a kit is stuck at an ancestor's gate or a duplicate.
    Null addresses, contents and digests match nothing; first means by created_at, then id.
    """
    kits = kits.select(*KIT)
    subjects = kits.filter("rendered")
    up, rest = ancestor_matches(subjects, kits, close, max_depth)
    beside = staged(sibling_matches(rest, kits, close), "siblings")
    rest = rest.join(beside.select("kit_id"), "kit_id", "left_anti")
    far = content_matches(rest, kits)
    none = F.lit(None).cast("int")
    found = up.withColumn("relation", F.lit("ancestor")).unionByName(beside.withColumn("relation", F.lit("sibling")).withColumn("depth", none)).unionByName(far.withColumn("relation", F.lit("content")).withColumn("depth", none))
    of = lambda key, to: kits.select(F.col("kit_id").alias(key), F.col("investigation_id").alias(to))
    both = found.join(of("kit_id", "_x"), "kit_id").join(of("matched", "_y"), "matched")
    verdict = F.when(~F.col("_x").eqNullSafe(F.col("_y")), "correlated").when(F.col("relation") == "ancestor", "stuck_at_gate").otherwise("duplicate")
    return both.select("kit_id", "matched", "relation", "via", "depth", verdict.alias("verdict"))
