"""What the operators of this package share: staged tables and joins that bear hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a key filter: so many for each key, and between these bounds (32 MB at most).
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 18, 1 << 28
#: A key is heavy when it holds at least 1/HEAVY_PARTS of the rows, so there are at most HEAVY_PARTS of them.
HEAVY_PARTS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, one is made here if driver and executors are one process;
    a cluster without the setting is an error, as its executors could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lurescope-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, computes once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def skew_safe_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``left`` LEFT JOIN ``right`` where ``right`` has one row per key and ``weight`` left rows belong to it.

    Keys with at least ``total / HEAVY_PARTS`` rows (so at most HEAVY_PARTS of them) are
    joined by broadcast and never shuffled; the rest is an ordinary shuffled join in
    which no key holds more than that share.
    """
    heavy = F.col(weight) * F.lit(HEAVY_PARTS) >= F.lit(max(total, 1))
    big = right.filter(heavy).withColumn("_heavy", F.lit(True))
    tagged = left.join(F.broadcast(big), keys, "left")
    hot = tagged.filter("_heavy").drop("_heavy")
    cold = tagged.filter("_heavy is null").select(*left.columns)
    return hot.unionByName(cold.join(right.filter(~heavy), keys, "left"))


def number_rows(rows: DataFrame, order: list, group: list[str] | None = None, to: str = "idx", count: str | None = None) -> DataFrame:
    """``rows`` with their place, from 0, in ``order`` within ``group``; in ``count``, if given, how many the group has.

    Rows are dealt by ranges of group and order, ranges are counted, and places are those
    in a range plus the sizes of the ranges before it: no group, however large, has to be
    in one task. Group columns hold no nulls. ``order`` tells rows apart, or the order of
    equal ones doesn't matter; they then share a range.
    """
    spark, group = rows.sparkSession, group or []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(rows.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_size"))
    ranges = W.partitionBy(*(group or [F.lit(0)]))
    before = F.coalesce(F.sum("_size").over(ranges.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).withColumn("_all", F.sum("_size").over(ranges)).drop("_size")
    place = F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order)) - 1 + F.col("_before")
    out = ranged.join(sizes, [*group, "_range"]).withColumn(to, place.cast("long"))
    return (out.withColumn(count, F.col("_all")) if count else out).drop("_range", "_before", "_all")


def key_filter(keys: DataFrame, bits_per_key: int = BITS_PER_KEY, most: int = MOST_BITS):
    """A function of a long column that is true for every ``key`` of ``keys`` and false for most others.

    A bitmap is what driver and tasks get. It has ``bits_per_key`` bits for each key and
    ``most`` at most; where keys are so many that it fills up, more rows pass, which
    costs time and loses nothing.
    """
    spark = keys.sparkSession
    wanted = keys.count() * bits_per_key
    size = LEAST_BITS
    while size < min(wanted, most):
        size *= 2
    word = F.shiftrightunsigned(F.pmod(F.col("key"), F.lit(size)), 5).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pmod(key, {size}) & 31 as int))")
    bits = np.zeros(size >> 5, dtype=np.uint32)
    words = keys.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    bits[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    seen = spark.sparkContext.broadcast(bits)

    # Arrow columns, so that these workers need no pandas.
    @F.arrow_udf("boolean")
    def may_be(key: pa.Array) -> pa.Array:
        at = np.mod(key.to_numpy(zero_copy_only=False), size)
        return pa.array((seen.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)

    return may_be


def key_of(sha: str, bits: int = 60):
    """The leading bits of a hex digest column as a long."""
    return F.shiftrightunsigned(F.conv(F.substring(sha, 1, 15), 16, 10).cast("long"), 60 - bits)


def worker_cache(name: str | None) -> dict:
    """A dict that outlives a task in its Python worker, for what one model needs again and again.

    A worker holds one model's at a time; a task that needs none passes null, so that
    what an earlier operator held is given back.
    """
    import sys
    import types

    module = sys.modules.setdefault("_lurescope_worker_cache", types.ModuleType("_lurescope_worker_cache"))
    held = module.__dict__.setdefault("held", {})
    if name not in held:
        if held:
            held.clear()  # one model at a time
            give_back()
        if name is None:
            return {}
        held[name] = {}
    return held[name]


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def shipped(spark: SparkSession, model) -> Callable:
    """A function that gives a worker ``model``; it is sent by value, so workers need no installed copy of the package."""
    sent, name = spark.sparkContext.broadcast(cloudpickle.dumps(model)), uuid.uuid4().hex

    def get():
        import pickle

        held = worker_cache(name)
        if "model" not in held:
            held["model"] = pickle.loads(sent.value)
        return held["model"]

    return get


def in_fold(id_col: str, parts: int, part: int):
    """Whether crc32 of an id's text leaves ``part``; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def sample_by_class(rows: DataFrame, class_col: str, id_col: str, per_class: int, seed: int = 29) -> DataFrame:
    """About ``per_class`` rows of each class, those whose seeded hash is smallest; all rows of a small class.

    Counts of the HEAVY_PARTS largest classes are broadcast; rows of further ones are shuffled.
    """
    n = rows.filter(F.col(class_col).isNotNull()).groupBy(class_col).agg(F.count(F.lit(1)).alias("_n"))
    top = n.orderBy(F.desc("_n"), class_col).limit(HEAVY_PARTS)
    counted = rows.join(F.broadcast(top), class_col)
    if n.limit(HEAVY_PARTS + 1).count() > HEAVY_PARTS:
        # Staged, so that both joins divide the classes in the same way.
        top = stage(top, "classes")
        rest = rows.join(F.broadcast(top), class_col, "left_anti").join(n, class_col)
        counted = rows.join(F.broadcast(top), class_col).unionByName(rest)
    share = F.xxhash64(F.lit(seed), F.col(id_col)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    return counted.filter(share * F.col("_n") < per_class).drop("_n")


def small_batches(spark: SparkSession, rows: int = 1024, size: str = "2m") -> None:
    """Bound what goes to a Python worker at once, for rows that hold whole documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
