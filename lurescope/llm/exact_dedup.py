"""Exact dedup over an extendible-hash index kept in shared files.

A document's key is a prefix of the SHA-256 of its text without white space. The
directory maps the leading bits of a key to a bucket and doubles whenever a bucket
over capacity already uses all directory bits, so a bucket is a range of keys. Only
texts whose key may occur twice are moved: tasks first collapse equal texts among
their own rows, look their bucket up in the directory, and the bucket's owner walks
its keys in order, chains the different texts of a key and compares their bytes. A key
that holds many rows is chained by several tasks before its owner does. The chains are
written as the index; documents are probed through the directory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import HEAVY_PARTS, key_filter, key_of, new_path, skew_safe_join, small_batches, stage, worker_cache

#: Characters that equality ignores: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Tasks that chain a key of many rows before its owner does.
HELPERS = 64


def build_directory(counts: dict[int, int], max_depth: int, capacity: int) -> tuple[int, np.ndarray, list[tuple[int, int, int, int]]]:
    """Split overfull buckets, doubling the directory when needed.

    ``counts``: keys by their first ``max_depth`` bits. Returns the directory's depth,
    the directory (bucket of each prefix of that length) and the buckets as
    (id, depth, prefix, keys). A bucket at ``max_depth`` may stay overfull: its owner
    streams it in key order and so needs no room for it.
    """
    hist = np.zeros(1 << max_depth, dtype=np.int64)
    for prefix, n in counts.items():
        hist[prefix] = n
    below = np.concatenate([[0], np.cumsum(hist)])
    held = lambda depth, prefix: int(below[(prefix + 1) << (max_depth - depth)] - below[prefix << (max_depth - depth)])
    depth, directory, buckets = 0, np.zeros(1, dtype=np.int64), [(0, 0)]
    todo = [0]
    while todo:
        b = todo.pop()
        d, prefix = buckets[b]
        if d == max_depth or held(d, prefix) <= capacity:
            continue
        if d == depth:
            directory, depth = np.repeat(directory, 2), depth + 1
        buckets[b] = (d + 1, prefix << 1)
        buckets.append((d + 1, prefix << 1 | 1))
        span = 1 << (depth - d - 1)
        lo = (prefix << 1 | 1) * span
        directory[lo : lo + span] = len(buckets) - 1
        todo += [b, len(buckets) - 1]
    return depth, directory, [(i, d, p, held(d, p)) for i, (d, p) in enumerate(buckets)]


def _better(a: tuple, b: tuple) -> tuple:
    """Of (code points, doc_id): the longer, then the smaller id; an absent id comes last."""
    rank = lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1])
    return a if rank(a) <= rank(b) else b


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 60, capacity: int = 64, max_depth: int = 16, flush_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are equal. Of equal texts the one
    with most code points stays, then the smallest id; a null id is last. Rows that
    repeat an id and text are returned as often as they occur. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    ``hash_bits`` (60 at most) shortens keys, ``capacity`` is keys per bucket.
    """
    spark = docs.sparkSession
    small_batches(spark)
    max_depth = min(max_depth, hash_bits)
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.translate(text, BLANKS, "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n"), norm.alias("norm"))
    rows = rows.withColumn("sha", F.sha2("norm", 256))
    rows = rows.withColumn("key", key_of("sha", hash_bits))
    entries = stage(rows.select("doc_id", "n", "sha", "key"), "dedup-entries")
    total = entries.count()
    keys = stage(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1"), "dedup-keys")

    # At most 2**max_depth rows reach the driver, whatever the input.
    prefix = F.shiftrightunsigned("key", hash_bits - max_depth)
    counts = {r[0]: r[1] for r in keys.groupBy(prefix.alias("p")).count().collect()}
    depth, directory, _ = build_directory(counts, max_depth, capacity)
    path = new_path(spark, "dedup-directory")
    spark.createDataFrame(list(enumerate(directory.tolist())), "prefix long, bucket long").coalesce(1).write.parquet(path)
    places = spark.read.schema("prefix long, bucket long").parquet(path)

    def looked_up(df: DataFrame) -> DataFrame:
        """``df`` with the bucket that the directory names for its key."""
        return df.withColumn("prefix", F.shiftrightunsigned("key", hash_bits - depth)).join(F.broadcast(places), "prefix").drop("prefix")

    may_repeat = key_filter(keys)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of equal texts among a task's rows, one row with their number and the best of them."""
        worker_cache(None)
        held: dict[tuple[int, bytes], list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            for i in range(0, len(items), 512):
                part = items[i : i + 512]
                columns = [[v[0] for _, v in part], [k for (k, _), _ in part], [b for (_, b), _ in part], *([v[j] for _, v in part] for j in range(1, 5))]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "key", "norm", "sha", "cnt", "best_n", "best_id"])

        for batch in batches:
            norms = batch.column("norm").cast(pa.binary())
            for i, (doc, n, sha, key, bucket) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "sha", "key", "bucket")), strict=True)):
                body = norms[i].as_py()
                if (at := held.get((key, body))) is None:
                    held[key, body] = [bucket, sha, 1, n, doc]
                    size += len(body) + 300
                else:
                    at[2] += 1
                    at[3], at[4] = _better((at[3], at[4]), (n, doc))
            if size > flush_bytes:
                yield from out()
                held, size = {}, 0
        yield from out()

    names = ["bucket", "key", "chain", "norm", "sha", "cnt", "best_n", "best_id", "hot"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    linked = "bucket long, key long, chain int, norm binary, sha string, cnt long, best_n long, best_id long, hot boolean"

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key: chain the key's different texts, comparing bytes. Hot ones keep their bytes for the owner."""
        current, chain, done = None, [], []
        size = 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        def close() -> int:
            hot = current is not None and current[2]
            done.extend((*current[:2], i, body if hot else None, *rest, hot) for i, (body, *rest) in enumerate(chain) if hot or rest[1] > 1)
            return sum(len(x[0]) for x in chain) if hot else 0

        for batch in batches:
            bodies = batch.column("norm")
            for i, (b, k, sha, cnt, n, doc, hot) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "sha", "cnt", "best_n", "best_id", "hot")), strict=True)):
                if (b, k, hot) != current:
                    size += close()
                    current, chain = (b, k, hot), []
                    if len(done) > 5000 or size > 8 << 20:
                        yield out()
                        done.clear()
                        size = 0
                body = bodies[i].as_py()
                for link in chain:
                    if link[0] == body:
                        link[2] += cnt
                        link[3], link[4] = _better((link[3], link[4]), (n, doc))
                        break
                else:
                    chain.append([body, sha, cnt, n, doc])
        close()
        yield out()

    moved = looked_up(rows.filter(may_repeat("key"))).mapInArrow(collapse, "bucket long, key long, norm binary, sha string, cnt long, best_n long, best_id long")
    # At most HEAVY_PARTS keys hold so many rows.
    hot = keys.filter(F.col("n_rows") * F.lit(HEAVY_PARTS) >= F.lit(max(total, HEAVY_PARTS * HELPERS))).select("key", F.lit(True).alias("hot"))
    moved = moved.join(F.broadcast(hot), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    moved = moved.withColumn("salt", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(HELPERS))).otherwise(F.lit(0)))
    first = stage(moved.repartition("bucket", "salt").sortWithinPartitions("bucket", "key").mapInArrow(chains, linked), "dedup-chains")
    owned = first.filter("hot").drop("chain").withColumn("hot", F.lit(False)).repartition("key").sortWithinPartitions("bucket", "key")
    index = first.filter("not hot").unionByName(owned.mapInArrow(chains, linked))
    groups = stage(index.select("bucket", "key", "sha", F.col("cnt").alias("group_size"), F.col("best_id").alias("keep_id")), "dedup-index")

    probed = entries.withColumn("may", may_repeat("key"))
    found = skew_safe_join(looked_up(probed.filter("may").drop("may")), groups, ["bucket", "key", "sha"], "group_size", total).drop("bucket")
    alone = probed.filter("not may").drop("may").withColumn("group_size", F.lit(None).cast("long")).withColumn("keep_id", F.lit(None).cast("long"))
    found = found.select(*alone.columns).unionByName(alone)
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
