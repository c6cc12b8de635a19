"""Secret scans with corpus-wide ownership of what they find.

Patterns and long mixed tokens give candidates with their places. Hashes of the
candidates' values are counted by distinct repositories and owners over the whole
corpus: a value that many owners have is a copied example, a value that one owner has
and that looks random is live-looking. Long tokens of the second kind are reported
even where no pattern names them. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurescope.llm.common import skew_safe_join, stage

#: Kinds in the order they are listed: pattern, group that is the value, least characters of the value.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: A long run of token characters; "owned" once ownership speaks for it.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}+"
#: Words of placeholders, which no live credential holds.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|12345678|abcdefgh"


def matches(text: Column, pattern: str, group: int, order: int, least: int, live_only: bool = False) -> Column:
    """Matches from left to right as structs ord, pos, gap (code points since the last one), size, fits, value_hash, live.

    What lies between the matches is as long as the text split by the pattern says, so
    places follow from running sums of gap and size; matches that don't fit count there.
    """
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value")), lambda x: x["whole"].isNotNull())

    def one(x: Column, i: Column) -> Column:
        live, fits = live_looking(x["value"]), F.length(x["value"]) >= least
        return F.struct(
            F.lit(order).alias("ord"), i.alias("pos"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("size"),
            (live if live_only else fits).alias("fits"), F.sha2(x["value"], 256).alias("value_hash"), live.alias("live"),
        )

    return F.transform(zipped, one)


def placed(found: DataFrame) -> DataFrame:
    """Rows of matches (uid and the fields of ``matches``) that fit, with s and e, their places in the text.

    A long token that a pattern's match covers or touches is left out: the base match
    that reaches furthest of those which begin before it, and the next one to begin, tell.
    """
    sums = W.partitionBy("uid", "ord").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    at = found.withColumn("e", F.sum(F.col("gap") + F.col("size")).over(sums).cast("int")).withColumn("s", F.col("e") - F.col("size")).filter("fits")
    base = F.col("ord") < len(KINDS)
    so_far = W.partitionBy("uid").orderBy("s").rangeBetween(W.unboundedPreceding, 0)
    later = W.partitionBy("uid").orderBy(F.desc("s")).rangeBetween(W.unboundedPreceding, -1)
    at = at.withColumn("_reach", F.max(F.when(base, F.col("e"))).over(so_far)).withColumn("_next", F.min(F.when(base, F.col("s"))).over(later))
    free = (F.coalesce("_reach", F.lit(0)) <= F.col("s")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("e")))
    return at.filter(base | free).drop("gap", "size", "fits", "pos", "_reach", "_next")


def live_looking(value: Column) -> Column:
    """Twenty characters or more with digits, letters and ten different characters, and no placeholder's words."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 10
    return (F.length(value) >= 20) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & varied & ~value.rlike(PLACEHOLDER)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner: Column | None = None, max_owners: int = 1, copied_from: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id and secrets, an array by start and kind.

    Each secret has s, e (code points, e exclusive), ord (place of its kind in KINDS,
    3 for "owned"), kind, value_hash (SHA-256; the value itself is not returned),
    n_seen (occurrences), n_repos, n_owners and verdict: "example" for a value that ``copied_from``
    owners or more have, "live" for a live-looking value of at most ``max_owners``,
    else "unclear". The owner is the repository's name up to the first slash unless
    given. A null repository counts as one repository of one owner. Null and empty
    texts have no secrets; other columns are ignored; equal rows are scanned each. An empty
    table gives an empty result. A very long text is scanned whole, its matches are placed
    by sorted running sums, in time by their number.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    repo = F.coalesce(F.col(repo_col).cast("string"), F.lit(""))
    who = F.coalesce(owner if owner is not None else F.substring_index(F.col(repo_col).cast("string"), "/", 1), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), repo.alias("repo"), who.alias("owner"))
    none = F.expr("cast(array() as array<struct<ord:int,pos:int,gap:int,size:int,fits:boolean,value_hash:string,live:boolean>>)")
    found = [F.when(F.col("text").rlike(pattern), matches(F.col("text"), pattern, group, i, least)).otherwise(none) for i, (_, pattern, group, least) in enumerate(KINDS)]
    token = F.when(F.col("text").rlike(r"[A-Za-z0-9+/_=-]{20}"), matches(F.col("text"), TOKEN, 0, len(KINDS), 0, live_only=True)).otherwise(none)
    # Texts stay where they are read; what moves is numbers and hashes of their matches.
    rows = stage(slim.select("doc_id", "repo", "owner", F.concat(*found, token).alias("matches")).withColumn("uid", F.monotonically_increasing_id()), "secret-matches")
    some = rows.filter("size(matches) > 0")
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS], F.lit("owned")), F.col("ord") + 1)
    each = placed(some.select("uid", "repo", "owner", F.inline("matches"))).withColumn("kind", kind)
    each = stage(each.select("uid", "repo", "owner", "s", "e", "ord", "kind", "value_hash", "live"), "secret-spans")

    # By value and repository first, so that a value in every document is summed where it is read.
    by_doc = each.groupBy("value_hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_doc.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    stats = stage(by_owner.groupBy("value_hash").agg(F.sum("n").alias("n_seen"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners")), "secret-owners")
    total = stats.agg(F.sum("n_seen")).first()[0] or 0
    judged = skew_safe_join(each, stats, ["value_hash"], "n_seen", total)
    verdict = F.when(F.col("n_owners") >= copied_from, "example").when(F.col("live") & (F.col("n_owners") <= max_owners), "live").otherwise("unclear")
    secret = F.struct("s", "ord", "e", "kind", "value_hash", "n_seen", "n_repos", "n_owners", verdict.alias("verdict"))
    kept = judged.filter((F.col("kind") != "owned") | (F.col("n_owners") <= max_owners))
    per_doc = kept.groupBy("uid").agg(F.array_sort(F.collect_list(secret)).alias("secrets"))
    empty = F.expr("cast(array() as array<struct<s:int,ord:int,e:int,kind:string,value_hash:string,n_seen:bigint,n_repos:bigint,n_owners:bigint,verdict:string>>)")
    with_any = some.select("uid", "doc_id").join(per_doc, "uid", "left").select("doc_id", F.coalesce("secrets", empty).alias("secrets"))
    return with_any.unionByName(rows.filter("size(matches) = 0").select("doc_id", empty.alias("secrets")))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
