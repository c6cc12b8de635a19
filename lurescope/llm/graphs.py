"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import skew_safe_join, stage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (v, label): the smallest vertex that each vertex reaches.

    Every round takes the smallest label among the neighbours and then the label of
    that label, so paths shorten by half. Hubs and labels that many vertices share are
    joined by broadcast (see skew_safe_join). Vertices without links have no row.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct().select(F.col("a").alias("u"), F.col("b").alias("v")), "cc-links")
    n = both.count()
    degree = stage(both.groupBy("u").agg(F.count(F.lit(1)).alias("deg"), F.min("v").alias("near")), "cc-degrees")
    labels = stage(degree.select(F.col("u").alias("v"), "deg", F.least("u", "near").alias("label")), "cc-labels")
    while n:
        sent = skew_safe_join(both, labels.select(F.col("v").alias("u"), "deg", F.col("label").alias("of_u")), ["u"], "deg", n)
        best = sent.groupBy("v").agg(F.min("of_u").alias("best"))
        hooked = stage(labels.join(best, "v").select("v", "deg", F.col("label").alias("old"), F.least("label", "best").alias("l")), "cc-hooked")
        of_label = hooked.groupBy("l").agg(F.count(F.lit(1)).alias("held"))
        of_label = of_label.join(hooked.select(F.col("v").alias("l"), F.col("l").alias("next")), "l")
        labels_ = skew_safe_join(hooked, of_label, ["l"], "held", n)
        labels = stage(labels_.select("v", "deg", F.least("l", "next").alias("label"), "old"), "cc-labels")
        if labels.filter("label <> old").isEmpty():
            break
        labels = labels.drop("old")
    return labels.select("v", "label")
