"""Structural polymorphism: variants of one page that share their tree of tags and differ in tokens.

A page is read as its elements in order, each with the path of open tags from the root. A
path is kept as a hash chained from its parent's, so a page takes space in proportion to its
tags however deep they nest; tag, depth and parent's hash tell it back. Which paths and form
fields all variants of a group share is counted by ``groupBy``, so no group is held by a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import suppress
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.operators.similarity import any_pair_between
from lurescope.session import small_batches

# What counts as a token made for one page, in attribute values and in whole pages.
TOKENS = [
    ("uuid", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", True),
    ("hex", r"[0-9a-f]{32,}", True),
    ("epoch", r"\d{10,13}", False),
    ("base64", r"[A-Za-z0-9+/]{40,}={0,2}", False),
]
#: Elements that are form fields, and what a token in an attribute becomes.
FIELDS, PLACEHOLDER = {"input", "select", "textarea"}, "__VAR__"
#: The parent of all paths.
ROOT = ""
ELEMENT = "at int, path string, parent string, tag string, depth int, text_hash string, field string"


def is_token(value: str, patterns=tuple(re.compile(p, re.I if fold else 0) for _, p, fold in TOKENS)) -> bool:
    return any(p.fullmatch(value) for p in patterns)


def chained(parent: str, tag: str) -> str:
    """A path's hash: that of its parent's hash and its last tag."""
    return hashlib.sha256(f"{parent}>{tag}".encode()).hexdigest()[:32]


class Elements(HTMLParser):
    """Elements of a page in order.

    Every start tag opens an element, tags without content too, and only an end tag of
    the innermost open one closes it. An element's text is the last run of text between
    tags that follows its start before the next element starts.
    """

    def __init__(self, exact: bool = False):
        super().__init__()
        self.open = [(ROOT, ROOT)]
        self.rows: list[list] = []
        self.held: list[str] = []
        self.path, self.paths = bytearray(), hashlib.sha256() if exact else None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.settle()
        parent = self.open[-1][1]
        key = chained(parent, tag)
        if self.paths is not None:
            self.paths.update(b"\n" if self.rows else b"")
            self.path += (b">" if self.path else b"") + tag.encode("utf-8", "replace")
            self.paths.update(self.path)
        self.open.append((tag, key))
        field = None
        if tag in FIELDS:
            named = {k: PLACEHOLDER if v and is_token(v) else v or "" for k, v in attrs}
            field = f"{tag}[name={named.get('name', '')},type={named.get('type', '')}]"
        self.rows.append([len(self.rows), key, parent, tag, len(self.open) - 1, None, field])

    def handle_endtag(self, tag: str) -> None:
        self.settle()
        if self.open[-1][0] == tag:
            self.open.pop()
            if self.paths is not None:
                del self.path[max(len(self.path) - len(tag.encode("utf-8", "replace")) - 1, 0) :]

    def handle_data(self, data: str) -> None:
        self.held.append(data)

    def settle(self) -> None:
        text = "".join(self.held).strip()
        self.held.clear()
        if text and self.rows:
            self.rows[-1][5] = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:16]


def read_elements(page: str, exact: bool = False) -> Elements:
    """A page's elements; what the parser can't read ends them."""
    found = Elements(exact)
    with suppress(Exception):
        found.feed(page)
    found.settle()
    return found


def elements(pages: DataFrame, id_col: str, html_col: str, group_col: str | None = None, flush: int = 20_000) -> DataFrame:
    """One row for each element of each page: id, grp, at, path, parent, tag, depth, text_hash, field. A null page has none."""
    slim = pages.select(F.col(id_col).alias("id"), (F.col(group_col) if group_col else F.lit(None).cast("string")).alias("grp"), F.col(html_col).cast("string").alias("html")).filter("html is not null")
    small_batches(pages.sparkSession)
    names = ["id", "grp", *[c.split()[0] for c in ELEMENT.split(", ")]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list] = []
            types = [batch.schema.field("id").type, batch.schema.field("grp").type, pa.int32(), *[pa.string()] * 3, pa.int32(), *[pa.string()] * 2]

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

            for key, grp, page in zip(batch["id"].to_pylist(), batch["grp"].to_pylist(), batch["html"].to_pylist()):
                for row in read_elements(page).rows:
                    held.append([key, grp, *row])
                    if len(held) >= flush:
                        yield out()
                        held = []
            if held:
                yield out()

    types = dict(slim.dtypes)
    return slim.mapInArrow(read, f"id {types['id']}, grp {types['grp']}, {ELEMENT}")


def skeletons(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Per page: id, n_elements, n_paths, skeleton_hash (of all its paths in order, 32 hex digits; null without elements), skeleton_key.

    The hash reads each path whole, which takes time by depth; the key is the hash of the
    chained hashes, equal for the same pages, in time by the number of tags.
    """

    @F.arrow_udf("struct<n_elements:int,n_paths:int,skeleton_hash:string,skeleton_key:string>")
    def read(page: pa.Array) -> pa.Array:
        out = []
        for text in page.to_pylist():
            found = read_elements(text or "", exact=True)
            keys = [r[1] for r in found.rows]
            whole = [found.paths.hexdigest()[:32], hashlib.sha256("\n".join(keys).encode()).hexdigest()[:32]] if keys else [None, None]
            out.append(dict(zip(["n_elements", "n_paths", "skeleton_hash", "skeleton_key"], [len(keys), len(set(keys)), *whole])))
        return pa.array(out, pa.struct([("n_elements", pa.int32()), ("n_paths", pa.int32()), ("skeleton_hash", pa.string()), ("skeleton_key", pa.string())]))

    got = pages.select(F.col(id_col), read(F.col(html_col).cast("string")).alias("_got"))
    return got.select(id_col, "_got.*")


def path_counts(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """grp, path, parent, tag, depth, n_pages, variants, constant, variable_text of each path of each group.

    ``sizes`` has grp and variants. A path is constant when all variants have it; its text
    varies when two elements on it, of whatever page, have different texts.
    """
    seen = found.groupBy("grp", "path", "id").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"), F.first("parent").alias("parent"), F.first("tag").alias("tag"), F.first("depth").alias("depth"))
    each = seen.groupBy("grp", "path").agg(
        F.count(F.lit(1)).alias("n_pages"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("parent").alias("parent"), F.first("tag").alias("tag"), F.first("depth").alias("depth")
    )
    constant = F.col("n_pages") == F.col("variants")
    varies = constant & F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))
    return each.join(sizes, "grp").select("grp", "path", "parent", "tag", "depth", "n_pages", "variants", constant.alias("constant"), varies.alias("variable_text"))


def field_counts(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """grp, field, n_pages, constant of each form field of each group."""
    seen = found.filter("field is not null").select("grp", "field", "id").distinct().groupBy("grp", "field").agg(F.count(F.lit(1)).alias("n_pages"))
    return seen.join(sizes, "grp").select("grp", "field", "n_pages", (F.col("n_pages") == F.col("variants")).alias("constant"))


def polymorphism(pages: DataFrame, digests: DataFrame, id_col: str, group_col: str, html_col: str, above: int = 30, most: int = 200, least: int = 2) -> DataFrame:
    """Per group of at least ``least`` pages: what its variants share, and whether they are polymorphic.

    grp, variants, n_paths, n_constant, n_stable (constant with one text), similarity (constant
    among all paths, three decimals, 0 without paths), n_fields, n_variable_fields, tokens
    (kinds found in any page), is_polymorphic (two digests more than ``above`` and at most
    ``most`` apart), confidence (0.7 of the similarity, 0.2 for tokens, 0.1 for fields that
    vary, three decimals; null where it isn't polymorphic).
    ``digests`` has ``id_col`` and tlsh; pages without a digest are variants like others.
    Pages with a null group are left out, a null page has no elements.
    """
    rows = pages.filter(F.col(group_col).isNotNull())
    kinds = [F.max(F.coalesce(F.col(html_col).rlike(("(?i)" if fold else "") + p), F.lit(False))).alias(name) for name, p, fold in TOKENS]
    sizes = rows.groupBy(F.col(group_col).alias("grp")).agg(F.count(F.lit(1)).alias("variants"), *kinds).filter(F.col("variants") >= least)
    found = elements(rows, id_col, html_col, group_col)
    paths = path_counts(found, sizes.select("grp", "variants")).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_paths"), F.sum(F.col("constant").cast("int")).alias("n_constant"), F.sum((F.col("constant") & ~F.col("variable_text")).cast("int")).alias("n_stable")
    )
    fields = field_counts(found, sizes.select("grp", "variants")).groupBy("grp").agg(F.count(F.lit(1)).alias("n_fields"), F.sum((~F.col("constant")).cast("int")).alias("n_variable_fields"))
    held = rows.select(F.col(id_col), F.col(group_col).alias("grp")).join(digests, id_col)
    small_batches(pages.sparkSession)
    between = any_pair_between(held, "grp", "tlsh", above, most).withColumn("is_polymorphic", F.lit(True))
    out = sizes.join(paths, "grp", "left").join(fields, "grp", "left").join(between, "grp", "left")
    out = out.na.fill(0, ["n_paths", "n_constant", "n_stable", "n_fields", "n_variable_fields"]).na.fill(False, ["is_polymorphic"])
    similarity = F.col("n_constant") / F.greatest("n_paths", F.lit(1))
    tokens = F.array_compact(F.array(*[F.when(F.col(name), F.lit(name)) for name, _, _ in TOKENS]))
    confidence = F.bround(F.col("similarity") * 0.7 + F.when(F.size("tokens") > 0, 0.2).otherwise(0.0) + F.when(F.col("n_variable_fields") > 0, 0.1).otherwise(0.0), 3)
    out = out.withColumn("similarity", F.bround(similarity, 3)).withColumn("tokens", tokens)
    return out.select("grp", "variants", "n_paths", "n_constant", "n_stable", "similarity", "n_fields", "n_variable_fields", "tokens", "is_polymorphic", F.when(F.col("is_polymorphic"), F.least(confidence, F.lit(1.0))).alias("confidence"))
