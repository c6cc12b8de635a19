"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, mixing.

Each stage takes what its predecessor kept and returns the columns of documents; the
last adds size, source_size, target, copies and taken. Part of subpackage llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm.common import in_fold, key_filter, skew_safe_join, stage
from lurescope.llm.decontam import decontaminate
from lurescope.llm.exact_dedup import exact_dedup
from lurescope.llm.langid import fit_languages, predict_languages
from lurescope.llm.mixing import mix
from lurescope.llm.near_dedup import near_dedup
from lurescope.sources.tables import table

#: Row keys of rows without an id of their own begin here.
OWN_KEYS = 1 << 62


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of its own for each row in ``__row``: the id, or a number from OWN_KEYS on where it is null or repeats.

    Only where there are such rows are documents written again, so that the numbers stay.
    """
    shared = stage(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__shared")).filter("doc_id is null or __shared > 1"), "shared-ids")
    rows = docs.withColumn("__row", F.col("doc_id").cast("long"))
    total = shared.agg(F.sum("__shared")).first()[0]
    if not total:
        return rows
    may_be = key_filter(shared.select(F.xxhash64(F.col("doc_id").cast("long")).alias("key")))
    flagged = rows.withColumn("__may", may_be(F.xxhash64("__row")) | F.col("__row").isNull())
    repeated = skew_safe_join(flagged.filter("__may and doc_id is not null").drop("__may"), shared.filter("doc_id is not null"), ["doc_id"], "__shared", total)
    own = F.lit(OWN_KEYS) + F.monotonically_increasing_id()
    out = flagged.filter("not __may").drop("__may").withColumn("__shared", F.lit(None).cast("long")).unionByName(repeated)
    out = out.unionByName(flagged.filter("doc_id is null").drop("__may").withColumn("__shared", F.lit(1).cast("long")))
    return stage(out.withColumn("__row", F.when(F.col("__shared").isNull(), F.col("__row")).otherwise(own)).drop("__shared"), "keyed")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Keyed ``docs`` without the rows of ``dropped`` (doc_id: row keys); only rows that may be dropped are shuffled."""
    dropped = stage(dropped.select(F.col("doc_id").alias("__row")), "dropped")
    may_be = key_filter(dropped.select(F.xxhash64("__row").alias("key")))
    flagged = docs.withColumn("__may", may_be(F.xxhash64("__row")))
    sure = flagged.filter("not __may").drop("__may", "__row")
    return sure.unionByName(flagged.filter("__may").drop("__may").join(dropped, "__row", "left_anti").select(*sure.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter, and texts of which no language has half of the likelihood.

    Null and empty texts go; rows that repeat are judged alike; without labelled rows
    every text with a letter stays. An empty table stays empty, further columns stay.
    """
    model = fit_languages(docs.filter(~in_fold("doc_id", 5, 0)), "text", "lang", "doc_id")
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = predict_languages(docs, model, "text", "__lang", "__score")
    return found.filter("__lang <> 'und' and __score >= 0.5").drop("__lang", "__score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest, then the one with the smallest id.

    Null texts count as empty, which are all equal. Of rows with a null or repeated id,
    which come last, one stays too. An empty table stays empty, further columns stay.
    """
    rows = keyed(docs)
    return without(rows, exact_dedup(rows, "__row").filter("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id.

    Texts without words stay. Rows with a null or repeated id come last and are rows
    like others. An empty table stays empty, further columns stay.
    """
    rows = keyed(docs)
    return without(rows, near_dedup(rows, "__row").filter("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a benchmark window go, whatever their ids. Texts without words stay, and all rows where the benchmark is empty."""
    rows = keyed(docs)
    return without(rows, decontaminate(rows, table(spark, sf_dir, "benchmark"), "__row").filter("size(hits) > 0"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, with size, source_size, target, copies and taken; columns of those names are replaced.

    Texts without words are not taken. A null source is a source. An empty table gives an empty result.
    """
    rows = keyed(docs).drop("size", "source_size", "target", "copies", "taken")
    taken = mix(rows, "__row").filter("copies > 0").select(F.col("doc_id").alias("__row"), "size", "source_size", "target", "copies", "taken")
    return rows.join(taken, "__row").drop("__row")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontamination), ("mixing", mixing)]
#: The stages' models, trees and knapsacks have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the mix takes of what all stages before it keep; nulls, ties, repeats and empty tables as the stages say."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
