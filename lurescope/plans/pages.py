"""Queries over page structure."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from lurescope.functions import urls
from lurescope.operators import digest_index as index
from lurescope.operators import polymorphism as poly
from lurescope.operators.layers import replay
from lurescope.operators.linediff import compare
from lurescope.operators.ranges import number_rows, staged
from lurescope.operators.rulepack import load_rules, scan_pack, string_matches
from lurescope.operators.similarity import tlsh_digests, tlsh_distance, tlsh_parts
from lurescope.plans.catalog import query
from lurescope.sources.tables import table


def by_host(spark, sf_dir):
    """Pages with their host, null where the address has none."""
    return table(spark, sf_dir, "pages").withColumn("host", F.nullif(urls.host(F.col("url")), F.lit("")))


@query("page_skeletons")
def page_skeletons(spark, sf_dir):
    """Each page's number of elements and paths, and its skeleton's hash."""
    return poly.skeletons(table(spark, sf_dir, "pages"), "page_id", "html")


@query("page_structural_diff")
def page_structural_diff(spark, sf_dir):
    """Every path that pages of one host have: in how many of them, whether all share it, and whether its text varies."""
    rows = by_host(spark, sf_dir).filter("host is not null")
    sizes = rows.groupBy(F.col("host").alias("grp")).agg(F.count(F.lit(1)).alias("variants")).filter("variants >= 2")
    return poly.path_counts(poly.elements(rows, "page_id", "html", "host"), sizes).withColumnRenamed("grp", "host")


@query("page_polymorphism")
def page_polymorphism(spark, sf_dir):
    """Per host with two pages or more, what its pages share and whether they are variants of one another."""
    rows = by_host(spark, sf_dir)
    found = poly.polymorphism(rows, tlsh_digests(rows, "page_id", "html"), "page_id", "host", "html")
    return found.withColumnRenamed("grp", "host").withColumn("tokens", F.array_join("tokens", ","))


def _pack():
    return load_rules([str(Path(__file__).parent.parent / "rules")])[0]


@query("page_rule_pack")
def page_rule_pack(spark, sf_dir):
    """The rules of the pack that each page matches."""
    return scan_pack(table(spark, sf_dir, "pages"), "html", _pack()).select("page_id", F.array_join("rules", ",").alias("rules"))


@query("document_rule_pack")
def document_rule_pack(spark, sf_dir):
    """The rules of the pack that each whole document matches."""
    return scan_pack(table(spark, sf_dir, "documents"), "text", _pack()).select("doc_id", F.array_join("rules", ",").alias("rules"))


@query("page_rule_strings")
def page_rule_strings(spark, sf_dir):
    """Every match of a string of the pack in a page, by offset, with 64 bytes on both sides."""
    return string_matches(table(spark, sf_dir, "pages"), "page_id", "html", _pack()).withColumnRenamed("id", "page_id")


@query("document_rule_strings")
def document_rule_strings(spark, sf_dir):
    """Every match of a string of the pack in a document, by offset, with 64 bytes on both sides."""
    return string_matches(table(spark, sf_dir, "documents"), "doc_id", "text", _pack()).withColumnRenamed("id", "doc_id")


@query("page_line_diff")
def page_line_diff(spark, sf_dir):
    """Each page against the one before it on the same host: changed lines by class, shared structure and digests' distance."""
    rows = by_host(spark, sf_dir).filter("host is not null")
    numbered = number_rows(rows.select("host", "page_id"), [F.asc("page_id")], ["host"])
    pairs = numbered.select("host", "idx", F.col("page_id").alias("b")).join(numbered.select("host", (F.col("idx") + 1).alias("idx"), F.col("page_id").alias("a")), ["host", "idx"])
    found = compare(rows, pairs, "page_id", "html").withColumn("examples", F.array_join("examples", "\n"))
    digests = tlsh_digests(rows, "page_id", "html")
    of = lambda side: digests.select(F.col("page_id").alias(side), F.col("tlsh").alias(f"_{side}"))
    distance = tlsh_distance(tlsh_parts(F.col("_a")), tlsh_parts(F.col("_b")))
    return found.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("distance", distance).drop("_a", "_b")


# Digests --------------------------------------------------------------------------------------------


def _document_digests(spark, sf_dir):
    return tlsh_digests(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("tlsh_pairs_indexed")
def tlsh_pairs_indexed(spark, sf_dir):
    """The pairs of tlsh_pairs_blocked by an index of the digests' parts."""
    return index.pairs(staged(_document_digests(spark, sf_dir), "digests"), "doc_id", "tlsh", 30)


@query("tlsh_search")
def tlsh_search(spark, sf_dir):
    """For each document whose id 20 divides, all close ones, nearest first."""
    rows = staged(_document_digests(spark, sf_dir), "digests")
    found = index.search(rows.filter("doc_id % 20 = 0"), rows, "doc_id", "tlsh", 30)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id")))


@query("tlsh_index_share")
def tlsh_index_share(spark, sf_dir):
    """How many pairs of digests the index compares."""
    return index.share_compared(staged(_document_digests(spark, sf_dir), "digests"), "tlsh", 30)


@query("site_variants")
def site_variants(spark, sf_dir):
    """Pairs of pages of one registrable domain with close digests and sizes within 15 per cent."""
    rows = table(spark, sf_dir, "pages").withColumn("site", F.nullif(urls.etld1(F.col("url")), F.lit(""))).withColumn("size", F.octet_length("html"))
    rows = staged(rows.join(tlsh_digests(rows, "page_id", "html"), "page_id").select("page_id", "site", "size", "tlsh"), "digests")
    return index.variants(rows, "page_id", "site", "tlsh", "size").withColumnRenamed("grp", "site")


@query("layered_documents", """select doc_id, 'window.x="' || text || '"' as plaintext, 'b64,reverse,b64' as steps from documents where length(text) >= 9""")
def layered_documents(spark, sf_dir):
    """Each whole document, hidden in the layers of a loader's source, as the recorded steps give it back."""
    plain = F.concat(F.lit('window.x="'), F.col("text"), F.lit('"'))
    coded = lambda c: F.regexp_replace(F.base64(c.cast("binary")), r"\s", "")  # noqa: E731  (without line ends)
    seed = coded(F.reverse(coded(plain)))
    source = F.concat(F.lit("var x='"), seed, F.lit("';x=atob(x);x=x.split('').reverse().join('');x=atob(x);"))
    found = replay(table(spark, sf_dir, "documents").select("doc_id", source.alias("source")), "doc_id", "source")
    return found.select(F.col("id").alias("doc_id"), "plaintext", F.array_join("steps", ",").alias("steps"))
