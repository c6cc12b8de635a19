"""Importance resampling towards a target distribution, on hashed n-grams of words.

Texts become a table of words with their positions; a window over each document's
positions brings the following words beside each one, which makes the n-grams of every
order, and these are hashed into buckets. Buckets are counted over both corpora, a bucket's
gain is the logarithm of its smoothed share in the target over that in the documents, and
gains are joined back to the documents' buckets and summed.

Documents are dealt by row before their words are listed, so words are not shuffled.
The table of buckets is written once and read by the count and by the sum. What is sent
to tasks is the table of gains, one row a bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurescope.llm.common import number_rows, stage

#: Words after A-Z are made lower case: digits, letters and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text bytes of a part whose words are sorted in one task.
PART_BYTES = 32 << 20


def word_buckets(docs: DataFrame, id_col: str, text_col: str, orders: int, buckets: int) -> DataFrame:
    """row, id, b1 to b<orders> for every word: the buckets of the n-grams that begin with it, null behind the text's end.

    A text without words has one row without buckets. ``row`` tells rows of one id apart;
    it counts on ``docs`` to list its rows alike when a lost task is run again, as reading files does.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).repartition(parts, "row")
    word = F.col("word")
    # lower() is quick and right for plain ASCII; other words change A-Z only.
    folded = F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))
    words = texts.select("row", "id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "word")).withColumn("word", folded)
    by_place = W.partitionBy("row").orderBy("pos")
    following = words.select("row", "id", "word", *[F.lead("word", k).over(by_place).alias(f"w{k}") for k in range(1, orders)])
    out, gram = [F.col("row"), F.col("id")], word
    for k in range(1, orders + 1):
        if k > 1:
            gram = F.concat(gram, F.lit(" "), F.col(f"w{k - 1}"))
        out.append(F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int").alias(f"b{k}"))
    return following.select(*out)


def bucket_counts(found: DataFrame, orders: int) -> DataFrame:
    """bucket, n over all n-grams."""
    each = reduce(DataFrame.unionByName, [found.groupBy(F.col(f"b{k}").alias("bucket")).agg(F.count(F.lit(1)).alias("n")) for k in range(1, orders + 1)])
    return each.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int, scale: int) -> DataFrame:
    """bucket, gain (long) for every bucket, from the counts of the documents and of the target."""
    both = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.lit(float(scale)) * F.log(ratio)).cast("long").alias("gain"))


def gumbel(id_col: str, seed: int, scale: int):
    """A document's scaled draw from the Gumbel distribution, by a seeded hash of its id (a null id is ``null``)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    orders: int = 3, buckets: int = 10_000, least_words: int = 20, percent: int = 5, seed: int = 42, scale: int = 1000,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (all long), n_words for every row of ``docs``.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn
    without replacement, with chances by their weights (highest of weight plus Gumbel draw);
    ``rank`` counts them, others have null. Ties go to the smaller id, a null id last.
    Null and empty texts have no features and weight 0. Repeated rows are documents like
    others. Without a target all its counts are 0; an empty table gives an empty result.
    Very long texts are taken whole. Further columns of ``docs`` are left out.
    """
    spark = docs.sparkSession
    found = stage(word_buckets(docs, id_col, text_col, orders, buckets), "resample-buckets")
    wanted = word_buckets(target.withColumn("_no", F.lit(None).cast("long")), "_no", target_col, orders, buckets)
    gains = stage(bucket_gains(bucket_counts(found, orders), bucket_counts(stage(wanted, "resample-target"), orders), buckets, scale), "resample-gains")
    cols = [f"b{k}" for k in range(1, orders + 1)]
    for b in cols:
        found = found.join(F.broadcast(gains.select(F.col("bucket").alias(b), F.col("gain").alias(f"g_{b}"))), b, "left")
    add = lambda of: reduce(lambda x, y: x + y, [of(b) for b in cols])
    scored = found.groupBy("row", "id").agg(
        F.count("b1").alias("n_words"), add(lambda b: F.count(b)).alias("n_features"),
        F.coalesce(F.sum(add(lambda b: F.coalesce(F.col(f"g_{b}"), F.lit(0)))), F.lit(0)).alias("weight"),
    )
    scored = stage(scored.withColumn("score", F.col("weight") + gumbel("id", seed, scale)), "resample-scores")
    can = F.col("n_words") >= least_words
    total = scored.filter(can).count()
    ranked = number_rows(scored.filter(can), [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")], to="place")
    rank = F.when(F.col("place") < (percent * total) // 100, F.col("place") + 1)
    out = [F.col("id").alias("doc_id"), "n_features", "weight", "score"]
    return ranked.select(*out, rank.alias("rank"), "n_words").unionByName(scored.filter(~can).select(*out, F.lit(None).cast("long").alias("rank"), "n_words"))
