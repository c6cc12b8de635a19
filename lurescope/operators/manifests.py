"""Stages of a render from its navigations, responses, resources and redirect hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.operators.ranges import as_of, number_rows, staged


def numbered(navs: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """``navs`` with seq (from 0, by time and ``tie``) and n, how many the key has; rows without key or time are left out."""
    able = navs.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    return number_rows(able, [F.asc(at), F.asc(tie)], [key], to="seq", count="n").withColumn("seq", F.col("seq").cast("int"))


def attribute(resources: DataFrame, navs: DataFrame, log: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """``resources`` with the seq of their stage and found_by: log, time, last or none.

    The first entry of ``log`` for a resource's address that names a stage (doc_seq)
    overrides its time; a time before all stages goes to the last one, as does one
    after all; without a time, or without stages, it is stage 0. A stage is open until
    the next begins; of stages that begin at once, the last is open.
    """
    order = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"))
    named = log.filter("url is not null and doc_seq is not null").groupBy(key, "url").agg(F.min_by("doc_seq", order).alias("_named"))
    stages = staged(numbered(navs, key, at, tie).withColumn("_inside", F.col("seq")), "stages")
    placed = as_of(resources, stages, key, at, tie, ["_inside"])
    count = stages.groupBy(key).agg((F.max("seq")).alias("_last"))
    out = placed.join(named, [key, "url"], "left").join(count, key, "left")
    last = F.when(F.col(at).isNotNull(), F.col("_last"))
    by = F.when(F.col("_named").isNotNull(), "log").when(F.col("_inside").isNotNull(), "time").when(last.isNotNull(), "last").otherwise("none")
    return out.select(*resources.columns, F.coalesce("_named", "_inside", last, F.lit(0)).alias("seq"), by.alias("found_by"))


def manifest(navs: DataFrame, responses: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Ordered stages: key, seq, url, is_final, nav_method, response, status, body, started, ended.

    A stage ends where the next begins, the last with the key's last response, never
    before its own start. Of several responses of an address the last one counts. The
    last stage shows the rendered page, others their response, if there is one.
    """
    stages = staged(numbered(navs.select(key, tie, "url", F.col(at).alias("started")), key, "started", tie), "stages")
    following = stages.select(key, (F.col("seq") - 1).alias("seq"), F.col("started").alias("_next"))
    last = responses.groupBy(key).agg(F.max(at).alias("_last"))
    settled = responses.groupBy(key, "url").agg(F.max_by(F.struct(F.col(tie).alias("response"), "status"), F.struct(at, tie)).alias("_r"))
    out = stages.join(following, [key, "seq"], "left").join(last, key, "left").join(settled, [key, "url"], "left")
    final = F.col("seq") == F.col("n") - 1
    ended = F.greatest("started", F.coalesce("_next", "_last", "started"))
    body = F.when(final, "rendered").when(F.col("_r").isNotNull(), "response").otherwise("none")
    return out.select(key, tie, "seq", "url", final.alias("is_final"), F.when(F.col("seq") == 0, "initial").alias("nav_method"), F.col("_r.response").alias("response"), F.col("_r.status").alias("status"), body.alias("body"), "started", ended.alias("ended"))


def hop_stages(hops: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """One stage for each hop and one for where the last led: key, seq, url, nav_method, status, terminal.

    The first hop is initial, further ones by their own status; the terminal stage is
    reached by the last hop's.
    """
    rows = staged(numbered(hops, key, at, tie), "hops")
    by_status = F.when((F.col("status") >= 300) & (F.col("status") < 400), "http_3xx").otherwise("js_location")
    each = rows.select(key, "seq", "url", F.when(F.col("seq") == 0, "initial").otherwise(by_status).alias("nav_method"), "status", F.lit(False).alias("terminal"))
    last = rows.filter("seq = n - 1")
    return each.unionByName(last.select(key, (F.col("seq") + 1).alias("seq"), "url", by_status.alias("nav_method"), F.lit(200).alias("status"), F.lit(True).alias("terminal")))
