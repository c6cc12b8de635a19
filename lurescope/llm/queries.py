"""The opN queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm.bpe import encode_and_decode
from lurescope.llm.decontam import SLOP, decontaminate
from lurescope.llm.exact_dedup import exact_dedup
from lurescope.llm.html_text import extract
from lurescope.llm.langid import identify
from lurescope.llm.merkle import fold, leaf_of, manifest, path_digest
from lurescope.llm.mixing import mix
from lurescope.llm.near_dedup import near_dedup
from lurescope.llm.quality import quality
from lurescope.llm.resample import resample
from lurescope.llm.secrets import KINDS, listed, scan_secrets
from lurescope.llm.toxicity import toxicity
from lurescope.llm.warc import round_trip
from lurescope.sources.tables import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("file", "offset")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"), F.array_join(F.array_sort("near"), ",").alias("near_items"),
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    verdicts = lambda v: F.size(F.filter("secrets", lambda x: x["verdict"] == v)).cast("long")
    base = F.filter("secrets", lambda x: x["ord"] < len(KINDS))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
        of("owned").alias("n_owned"), verdicts("live").alias("n_live"), verdicts("example").alias("n_example"),
    )


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_and_decode(table(spark, sf_dir, "documents"))
    n_tokens = F.expr("octet_length(tokens) div 4")
    return found.select("doc_id", n_tokens.cast("long").alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents")
    tampered = F.col("n_chars") + F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, 1).otherwise(0)
    docs = docs.withColumn("altered", leaf_of([tampered if c == "n_chars" else F.col(c) for c in columns]))
    found = manifest(docs, columns, "lang", "doc_id", ["altered"]).withColumn("folded_root", fold(F.col("altered"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_warc": op2_warc,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_html_text": op8_html_text,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality": op10_quality,
    "op11_resample": op11_resample,
    "op12_bpe": op12_bpe,
    "op13_merkle": op13_merkle,
}
