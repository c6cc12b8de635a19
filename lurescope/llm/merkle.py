"""A Merkle manifest of a dataset: a leaf for each row, a tree for each group, a tree over the groups.

Leaves are numbered within their group and cut into blocks of a fixed size, whose ordered
arrays are collapsed level by level with ``sequence``, ``transform``, ``slice`` and
``aggregate`` in the JVM. The roots of blocks are the leaves of the next round, until one
node of each group is left. A row's proof is its path in its block, then that of its
block's root in the next round's block, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import number_rows, stage

#: A block holds 2^BLOCK_LEVELS nodes, which are BLOCK_LEVELS levels of a tree with two nodes to a run.
BLOCK_LEVELS = 9


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(columns: list[Column]) -> Column:
    """The digest of a row: each value as its byte count, a colon and the value, or ``-`` if null."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def group_key(group: Column) -> Column:
    """A key without nulls whose bytewise order is that of the groups, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its siblings, bottom up, lead to; runs without a sibling hash the node alone."""
    return F.aggregate(path, node, lambda held, step: digest(F.when(step["sibling"].isNull(), held).when(step["before"], F.concat(step["sibling"], held)).otherwise(F.concat(held, step["sibling"]))))


def path_digest(path: Column) -> Column:
    """The digest of all siblings of a path, bottom up."""
    return digest(F.array_join(F.transform(path, lambda step: step["sibling"]), ""))


def collapse(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Blocks of ``nodes`` (grp, idx, n, node, item): grp, block, n, held (idx and item of each), tiers (a block's levels, its nodes first), top (its root).

    ``n`` is how many nodes the group has; a group of one block ends with its root, blocks
    of larger groups go through all ``levels``, however few nodes the last one has.
    """
    size = 1 << levels
    blocks = nodes.groupBy("grp", F.expr(f"idx div {size}").alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "node", "item"))).alias("held"))
    deep = F.when(F.col("n") > size, F.lit(levels)).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(F.lit(0))

    def above(tier: Column) -> Column:
        """The digests of runs of two."""
        runs = F.sequence(F.lit(0), F.floor((F.size(tier) - 1) / 2).cast("int"))
        return F.transform(runs, lambda i: digest(F.array_join(F.slice(tier, 2 * i + 1, 2), "")))

    steps = F.when(deep > 0, F.sequence(F.lit(1), deep)).otherwise(F.array().cast("array<int>"))
    tiers = F.aggregate(steps, F.array(F.transform("held", lambda x: x["node"])), lambda tiers, _: F.concat(tiers, F.array(above(F.element_at(tiers, -1)))))
    out = blocks.select("grp", "block", "n", F.transform("held", lambda x: F.struct(x["idx"].alias("idx"), x["item"].alias("item"))).alias("held"), tiers.alias("tiers"))
    return out.withColumn("top", F.get(F.element_at("tiers", -1), F.lit(0)))


def rounds_of(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """Blocks of the nodes, blocks of their roots, and so on until each group has one block."""
    size = 1 << levels
    rounds = [stage(collapse(nodes, levels), "merkle-blocks")]
    while rounds[-1].filter(F.col("n") > size).limit(1).count():
        left = F.expr(f"(n + {size - 1}) div {size}")
        above = rounds[-1].select("grp", F.col("block").alias("idx"), left.alias("n"), F.col("top").alias("node"), F.lit(None).cast("string").alias("item"))
        rounds.append(stage(collapse(above, levels), "merkle-blocks"))
    return rounds


def paths(rounds: list[DataFrame], upper: DataFrame) -> DataFrame:
    """grp, idx, node, item, path, subroot, root of every leaf.

    ``upper`` has the path above each group's root, with subroot and root: grp, idx (0), path, subroot, root.
    Both sides of each join have one row for a block.
    """

    def steps(place: Column) -> Column:
        def at(level: Column) -> Column:
            own = F.call_function("shiftright", place, level)
            before = own % 2 == 1
            return F.struct(F.get(F.get("tiers", level), F.when(before, own - 1).otherwise(own + 1)).alias("sibling"), before.alias("before"))

        deep = F.size("tiers") - 1
        return F.transform(F.when(deep > 0, F.sequence(F.lit(0), deep - 1)).otherwise(F.array().cast("array<int>")), at)

    for blocks in reversed(rounds):
        joined = blocks.join(upper.select("grp", F.col("idx").alias("block"), F.col("path").alias("_upper"), "subroot", "root"), ["grp", "block"])
        leaf = lambda x, i: F.struct(x["idx"].alias("idx"), F.get(F.get("tiers", F.lit(0)), i).alias("node"), x["item"].alias("item"), F.concat(steps(i), F.col("_upper")).alias("path"))
        upper = joined.select("grp", "subroot", "root", F.inline(F.transform("held", leaf)))
    return upper


def manifest(docs: DataFrame, columns: list[str], group_col: str, id_col: str, carry: list[str] | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """idx, leaf, path (siblings bottom up, to the root), subroot, root, ``id_col``, ``group_col`` and ``carry`` for every row of ``docs``.

    Rows of a group ascend by id, a null id first, then by digest, so repeated rows are
    leaves side by side. A null group is a group, before all others; a lone leaf is its
    group's subroot, and a lone subroot the root. A null value has a mark of its own that
    no text has. An empty table gives an empty result. Very long texts are read whole and
    only their digests move. Columns not named are no part of a leaf and are left out.
    """
    own = list(dict.fromkeys([id_col, group_col, *(carry or [])]))
    leaves = docs.select(group_key(F.col(group_col)).alias("grp"), leaf_of([F.col(c) for c in columns]).alias("node"), F.struct(*own).alias("item"))
    leaves = number_rows(stage(leaves, "merkle-leaves"), [F.asc_nulls_first(f"item.{id_col}"), F.asc("node")], ["grp"], count="n")
    rounds = rounds_of(leaves, levels)
    subroots = rounds[-1].select(F.lit("").alias("grp"), F.col("top").alias("node"), F.col("grp").alias("item"))
    tops = rounds_of(number_rows(subroots, [F.asc("item")], ["grp"], count="n"), levels)
    none = F.array().cast("array<struct<sibling:string,before:boolean>>")
    top = paths(tops, tops[-1].select("grp", F.col("block").alias("idx"), none.alias("path"), F.col("top").alias("subroot"), F.col("top").alias("root")))
    upper = top.select(F.col("item").alias("grp"), F.lit(0).cast("long").alias("idx"), "path", F.col("node").alias("subroot"), "root")
    return paths(rounds, upper).select("item.*", "idx", F.col("node").alias("leaf"), "path", "subroot", "root")
