"""Mixing sources to target weights by fitting a word budget with subset sums.

Documents are counted by source and exact size. Each source takes every document as
often as its target allows in full, then a proportional share of each size, and a
bounded knapsack over the sizes left closes the remaining gap to the word. Which
documents of a size are taken is decided by a seeded hash, through counts of hash
cells, so no group of equal sizes is ever sorted in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurescope.llm.common import skew_safe_join, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target stops at so many times its source's size.
MOST = 3


def targets_of(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Words for each source: weights share all words, and what is above ``most`` times a size is shared anew."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), list(order)
    while free:
        whole = sum(weight[s] for s in free)
        share = {s: left * weight[s] / whole for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
        left = max(0.0, left - sum(target[s] for s in over))
        free = [s for s in free if s not in target]
    return target


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take, at most ``counts``, for the largest sum up to ``budget``."""
    taken = np.zeros(len(sizes), dtype=np.int64)
    reach = np.zeros(budget + 1, dtype=bool)
    reach[0] = True
    by = np.full(budget + 1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for i, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        count, part = min(count, budget // size if size else 0), 1
        while count > 0 and not reach[budget]:
            part = min(part, count)
            step = part * size
            fresh = np.zeros_like(reach)
            fresh[step:] = reach[: budget + 1 - step]
            fresh &= ~reach
            by[fresh] = len(items)
            items.append((i, part))
            reach |= fresh
            count, part = count - part, part * 2
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, part = items[by[at]]
        taken[i] += part
        at -= part * int(sizes[i])
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, target: float, seed: int) -> tuple[int, np.ndarray]:
    """Times that every document is taken, and how many of each size are taken once more."""
    total = int((sizes * counts).sum())
    more = np.zeros(len(sizes), dtype=np.int64)
    if not total:
        return 0, more
    times = min(MOST, int(target // total))
    budget = int(round(target - times * total))
    if times >= MOST or budget <= 0:
        return times, more
    if budget >= total:
        return times + 1, more
    live = sizes > 0
    more[live] = (counts[live] * budget) // total
    left = budget - int((sizes * more).sum())
    # The shares leave less than one document of each size, so what one pass over the sizes
    # leaves is no more than the longest document, and so is the knapsack's table.
    longest = int(sizes.max())
    order = np.random.default_rng(seed).permutation(np.flatnonzero(live))
    for i in order:
        if left <= longest:
            break
        if more[i] < counts[i]:
            more[i] += 1
            left -= int(sizes[i])
    order = order[(sizes[order] <= left) & (more[order] < counts[order])]
    more[order] += knapsack(sizes[order], counts[order] - more[order], left)
    return times, more


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    A null text has size 0, and documents of size 0 are taken 0 words. A null source
    is a source of its own, last in order. Equal rows share one hash; which of them is
    taken makes no difference to the result. Other columns are ignored. An empty table
    gives an empty result. One row per source comes to the driver.
    """
    spark = docs.sparkSession
    source = F.col(source_col).cast("string")
    src = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    h = F.xxhash64(F.lit(seed), F.col(id_col)).bitwiseAND(F.lit((1 << 63) - 1))
    base = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), src.alias("src"), size.alias("size"), h.alias("h")), "mix-sizes")
    total = base.count()
    hist = stage(base.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sums = {r[0]: int(r[1]) for r in hist.groupBy("src").agg(F.sum(F.col("size") * F.col("n"))).collect()}
    named = {None if k == "n" else k[1:]: v for k, v in sums.items()}
    wanted = targets_of(named)
    rows = [("n" if k is None else f"s{k}", named[k], float(v)) for k, v in wanted.items()]
    targets = spark.createDataFrame(rows, "src string, source_size long, target double")

    def fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        times, more = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), float(pdf["target"].iloc[0]), seed)
        return pdf.assign(times=times, more=more)

    # A source has a row for each size, however many documents it has.
    plan = hist.join(targets, "src").groupBy("src").applyInPandas(fit_source, "src string, size long, n long, source_size long, target double, times long, more long")
    plan = stage(plan.withColumn("bits", F.least(F.lit(20), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / 256.0)).cast("int")))), "mix-plan")

    cell = F.expr("shiftrightunsigned(h, 63 - bits)")
    open_sizes = plan.filter("more > 0 and more < n").select("src", "size", "n", "more", "bits")
    in_open = skew_safe_join(base, open_sizes, ["src", "size"], "n", total).filter("more is not null")
    cells = in_open.groupBy("src", "size", "more", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("src", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    edge = cells.withColumn("upto", upto).filter("upto >= more and upto - c < more").select("src", "size", F.col("cell").alias("edge"), (F.col("more") - F.col("upto") + F.col("c")).alias("need"))
    full = stage(plan.join(edge, ["src", "size"], "left"), "mix-edges")
    placed = skew_safe_join(base, full, ["src", "size"], "n", total).withColumn("cell", cell)
    # Only a cell's few rows are ranked.
    rank = F.row_number().over(Window.partitionBy("src", "size").orderBy("h", "doc_id"))
    on_edge = placed.filter("cell = edge").withColumn("extra", (rank <= F.col("need")).cast("long"))
    off_edge = placed.filter("edge is null or cell <> edge").withColumn("extra", F.when(F.col("edge").isNull(), (F.col("more") >= F.col("n")).cast("long")).otherwise((F.col("cell") < F.col("edge")).cast("long")))
    out = on_edge.unionByName(off_edge)
    copies = F.when(F.col("size") > 0, F.col("times") + F.col("extra")).otherwise(F.lit(0).cast("long"))
    source_out = F.when(F.col("src") == "n", F.lit(None).cast("string")).otherwise(F.expr("substring(src, 2)"))
    return out.select("doc_id", source_out.alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
