"""Search of locality-sensitive digests by an index of their headers, exact at small distances.

A digest's header has its length and two ratios, and the distance of two digests is at
least that of their headers. The index holds each digest under its header, of which there
are 65,536 at most, and a query looks under all headers near its own: what it meets is
compared, the rest can't be close. Equal digests are one entry.

``candidates`` finds the same by the body, 128 two-bit codes in 16 parts of 8: digests at
most ``most`` apart have a part whose codes differ by most // 16 in sum. Texts of one
language have like bodies, so it meets more and holds each entry 16 times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.operators.similarity import cell_counts, near_cells, near_classes, tlsh_pairs, tlsh_parts

PARTS, CODES = 16, 8
#: Beyond this distance a part's neighbours are so many that tiles of all pairs are cheaper.
MOST = 47


def parts_of(digest: Column) -> Column:
    """Number and value of each part of a body."""
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.struct(k.alias("part"), F.conv(F.substring(digest, 9 + 4 * k, F.lit(4)), 16, 10).cast("int").alias("value")))


def values_near(value: Column, steps: int) -> Column:
    """All values whose codes differ from those of ``value`` by ``steps`` or less in sum."""
    out = F.array(value)
    for _ in range(steps):

        def around(v: Column) -> Column:
            code = lambda i: F.shiftright(v, 2 * i).bitwiseAND(3)
            up = [F.when(code(i) < 3, v + (1 << 2 * i)) for i in range(CODES)]
            down = [F.when(code(i) > 0, v - (1 << 2 * i)) for i in range(CODES)]
            return F.array_compact(F.array(v, *up, *down))

        out = F.array_distinct(F.flatten(F.transform(out, around)))
    return out


def candidates(queries: DataFrame, entries: DataFrame, most: int) -> DataFrame:
    """Pairs of a query's and an entry's digest (x, y) that have a near part, once for each such part, with both decoded (p, q)."""
    if not 0 <= most <= MOST:
        raise ValueError(f"distances from 0 to {MOST}")
    asked = queries.select(F.col("d").alias("x"), tlsh_parts(F.col("d")).alias("p"), F.explode(parts_of(F.col("d"))).alias("_s"))
    asked = asked.select("x", "p", F.col("_s.part").alias("part"), F.explode(values_near(F.col("_s.value"), most // PARTS)).alias("value"))
    held = entries.select(F.col("d").alias("y"), tlsh_parts(F.col("d")).alias("q"), F.explode(parts_of(F.col("d"))).alias("_s")).select("y", "q", "_s.part", "_s.value")
    return asked.join(held, ["part", "value"])


def _digests(df: DataFrame, digest_col: str) -> DataFrame:
    return df.select(F.upper(digest_col).alias("d")).filter("d is not null").distinct()


def near_digests(queries: DataFrame, entries: DataFrame, most: int) -> DataFrame:
    """x, y, distance of all digests (column d, distinct) at ``most`` or less, equal ones included."""
    own = lambda df, asked: df.select("d", F.lit(asked).alias("asked"), F.lit(not asked).alias("held"))
    both = own(queries, True).unionByName(own(entries, False)).groupBy("d").agg(F.max("asked").alias("asked"), F.max("held").alias("held"))
    near = near_classes(both.withColumn("id", F.col("d")), most, queries=True).select(F.col("a").alias("x"), F.col("b").alias("y"), "distance")
    return near.unionByName(both.filter("asked and held").select(F.col("d").alias("x"), F.col("d").alias("y"), F.lit(0).alias("distance")))


def search(queries: DataFrame, rows: DataFrame, id_col: str, digest_col: str, most: int) -> DataFrame:
    """query, id, distance: for each row of ``queries`` all other rows at ``most`` or less. Null digests match nothing; rows of one id are themselves."""
    near = near_digests(_digests(queries, digest_col), _digests(rows, digest_col), most)
    asked = queries.select(F.col(id_col).alias("query"), F.upper(digest_col).alias("x"))
    held = rows.select(F.col(id_col).alias("id"), F.upper(digest_col).alias("y"))
    return asked.join(near, "x").join(held, "y").filter("query <> id").select("query", "id", "distance").distinct()


def pairs(df: DataFrame, id_col: str, digest_col: str, most: int) -> DataFrame:
    """Pairs a < b of rows at ``most`` or less."""
    return tlsh_pairs(df, id_col, digest_col, most)


def share_compared(df: DataFrame, digest_col: str, most: int) -> DataFrame:
    """One row: digests, pairs of them, and how many the index compares."""
    cells, n = cell_counts(_digests(df, digest_col))
    compared = total = int(n.sum())
    if total:
        x, y = near_cells(cells, most)
        compared = (sum(int(i) * int(j) for i, j in zip(n[x], n[y], strict=True)) - total) // 2
    return df.sparkSession.createDataFrame([(total, total * (total - 1) // 2, compared)], "digests long, pairs long, compared long")


def variants(df: DataFrame, id_col: str, group_col: str, digest_col: str, size_col: str, most: int = 30, ratio: float = 1.15) -> DataFrame:
    """Pairs a < b of one group whose digests are at ``most`` or less and whose sizes are within ``ratio``.

    Null groups and sizes of 0 match nothing.
    """
    rows = df.filter(F.col(group_col).isNotNull() & F.col(digest_col).isNotNull() & (F.col(size_col) > 0)).select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), F.upper(digest_col).alias("d"), F.col(size_col).alias("n"))
    keys = rows.select("d").distinct()
    near = near_digests(keys, keys, most)
    of = lambda i, n, d: rows.select("g", F.col("id").alias(i), F.col("n").alias(n), F.col("d").alias(d))
    both = near.join(of("a", "_n", "x"), "x").join(of("b", "_m", "y"), ["g", "y"]).filter("a < b")
    return both.filter(F.greatest("_n", "_m") <= F.least("_n", "_m") * ratio).select(F.col("g").alias("grp"), "a", "b", "distance")
