"""Line diffs of pairs of pages: each tag on its own line, a minimal edit script, and what kind of change each line is.

Lines are numbered by content and aligned by a longest common subsequence in bit vectors:
one whole number holds a row of the table, so a row takes a few additions whatever its
length. Only every few rows are kept and those between are made again on the way back, so
memory grows with lines times the root of lines.
"""

from __future__ import annotations

import re
from contextlib import suppress
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.operators.polymorphism import read_elements

# Elements that have no content, those that don't indent, and the classes of changed lines with their marks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo cite code em i kbd mark q s samp small span strong sub sup time u var".split())
CLASSES = [
    ("css_class", re.compile(r"class\s*=\s*[\"']", re.I)),
    ("title", re.compile(r"<(title|h[1-6])\b", re.I)),
    ("url", re.compile(r"(href|src|action)\s*=\s*[\"']", re.I)),
    ("form_id", re.compile(r"(id|name)\s*=\s*[\"']", re.I)),
]
OTHER = "other"
NAMES = [name for name, _ in CLASSES] + [OTHER]


class Lines(HTMLParser):
    """A page with a line for each tag, comment and line of text, indented by open blocks."""

    def __init__(self):
        super().__init__()
        self.lines: list[str] = []
        self.depth = 0

    def add(self, text: str) -> None:
        self.lines.append("  " * self.depth + text)

    def handle_decl(self, decl: str) -> None:
        self.add(f"<!{decl}>")

    def handle_comment(self, data: str) -> None:
        self.add(f"<!--{data}-->")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.add("<" + " ".join([tag, *(k if v is None else f'{k}="{v}"' for k, v in attrs)]) + ">")
        self.depth += tag not in VOID and tag not in INLINE

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID and tag not in INLINE:
            self.depth = max(0, self.depth - 1)
        self.add(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        for line in filter(None, map(str.strip, data.strip().splitlines())):
            self.add(line)


def page_lines(page: str) -> list[str]:
    """The page's lines; what the parser can't read ends them. A comment's or value's own line ends divide it further."""
    found = Lines()
    with suppress(Exception):
        found.feed(page)
    return "\n".join(found.lines).splitlines()


def unmatched(a: list, b: list) -> tuple[list[int], list[int]]:
    """Places of ``a`` and of ``b`` that a longest common subsequence leaves out; of several, one is taken by a fixed rule."""
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        start += 1
    while min(end_a, end_b) > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    rows, cols = a[start:end_a], b[start:end_b]
    full = (1 << len(cols)) - 1
    where: dict = {}
    for j, x in enumerate(cols):
        where[x] = where.get(x, 0) | 1 << j

    def step(held: int, x) -> int:
        # A bit that is off marks a column where the row's length grows.
        hit = held & where.get(x, 0)
        return ((held + hit) | (held - hit)) & full

    every = max(1, int(len(rows) ** 0.5))
    kept, held = {0: full}, full
    for i, x in enumerate(rows, 1):
        held = step(held, x)
        if i % every == 0:
            kept[i] = held
    from_a, from_b, i, j, near, base = [], [], len(rows), len(cols), {}, -1

    def row(i: int) -> int:
        nonlocal near, base
        if i // every != base:
            base = i // every
            near = {base * every: kept[base * every]}
            for k in range(base * every + 1, min((base + 1) * every, len(rows) + 1)):
                near[k] = step(near[k - 1], rows[k - 1])
        return near[i]

    while i and j:
        if row(i) >> (j - 1) & 1:
            j -= 1
            from_b.append(start + j)
        else:
            i -= 1
            if i and not row(i) >> (j - 1) & 1:
                from_a.append(start + i)
            else:
                j -= 1
    from_a += [start + k for k in range(i)]
    from_b += [start + k for k in range(j)]
    return sorted(from_a), sorted(from_b)


def class_of(line: str) -> str:
    """The first class whose mark the line has; patterns are searched only where their fixed characters are."""
    able = {"<": "<" in line, "=": "=" in line and ('"' in line or "'" in line)}
    if not (able["<"] or able["="]):
        return OTHER
    return next((name for name, p in CLASSES if able["<" if name == "title" else "="] and p.search(line)), OTHER)


COUNTS = ["lines_a", "lines_b", "removed", "added", *NAMES]


def diff_pages(a: str | None, b: str | None, examples: int = 5, width: int = 120) -> dict:
    """Lines, removed and added ones, changed lines by class (blank ones are of none), the first few of each class, and the paths both pages share."""
    x, y = page_lines(a or ""), page_lines(b or "")
    gone, new = unmatched(x, y)
    out: dict = dict.fromkeys(COUNTS, 0) | {"lines_a": len(x), "lines_b": len(y), "removed": len(gone), "added": len(new)}
    shown: dict[str, list[str]] = {name: [] for name in NAMES}
    for line in [x[i] for i in gone] + [y[j] for j in new]:
        if line.strip():
            name = class_of(line)
            out[name] += 1
            if len(shown[name]) < examples:
                shown[name].append(line.strip()[:width])
    one, two = ({r[1] for r in read_elements(p or "").rows} for p in (a, b))
    return out | {"paths_shared": len(one & two), "paths": len(one | two), "examples": [f"{n}: {e}" for n in NAMES for e in shown[n]]}


def compare(pages: DataFrame, pairs: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``pairs`` (a, b) with what ``diff_pages`` says of their pages, and similarity (shared among all paths, three decimals).

    Pairs of which a page is absent are left out; a null page is an empty one. Each page
    of a pair is read once for it, in batches of a bounded number of rows.
    """
    kinds = [(c, pa.int32()) for c in [*COUNTS, "paths_shared", "paths"]] + [("examples", pa.list_(pa.string()))]
    shape = ", ".join(f"{c} int" for c, _ in kinds[:-1]) + ", examples array<string>"

    @F.arrow_udf(f"struct<{shape.replace(' int', ':int').replace(' array', ':array')}>")
    def diff(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([diff_pages(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.struct(kinds))

    of = lambda side: pages.select(F.col(id_col).alias(side), F.col(html_col).cast("string").alias(f"_{side}"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    got = both.select("a", "b", diff("_a", "_b").alias("_d")).select("a", "b", "_d.*")
    return got.withColumn("similarity", F.bround(F.col("paths_shared") / F.greatest("paths", F.lit(1)), 3))
