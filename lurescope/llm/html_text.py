"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with its path of block-level tags
from the root. Text length and punctuation are summed per path, set in ratio to the
path's nodes, smoothed over neighbouring blocks and fused into one score. Paths above
a threshold are content; the smallest element that holds most of their text, or the
elements named as articles, are the region, from which faint paths are left out.
Elements that are boilerplate by their tag or role are no part of the text; class and
id names are a prior only, which strong paths overcome. All steps take linear time.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import small_batches, worker_cache

#: Elements whose content is no text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "plaintext"}
DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "option", "input", "label", "dialog", "head", "svg", "math", "canvas", "object", "video", "audio", "fieldset"} | RAW
#: Blocks of running text, in which a label is a word like others.
RUNNING = {"p", "li", "td", "th", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "figcaption", "summary"}
#: Elements that show a form to wrap more than fields.
PROSE = {"p", "article", "main", "h1", "h2", "h3", "section", "table"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that do not end a block.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements that end an open paragraph.
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section summary table ul".split())
#: Start tags that end the named open elements, and the elements that bound the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Words of class and id names that speak for boilerplate, and those that speak for content.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall"
    r"|nav|navbar|navigation|menu|menubar|breadcrumbs?|pagination|pager|toc|sidebar|side|aside|rail|widget|complementary|header|masthead|topbar|toolbar|footer|foot|bottombar|contentinfo"
    r"|share|sharing|social|related|recommend\w*|trending|popular|comments?|comment-?list|disqus|respond|replies|reply|discussion|legal|copyright|disclaimer|search|login|hidden)(?:$|[\s_-]|\d)",
    re.I,
)
CONTENT = re.compile(r"(?:^|[\s_-])(?:content|article|post|entry|story|main|body|text|page)(?:$|[\s_-]|\d)", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: A class or id of readers' comments, and how long a block outside them shows that the page has more.
READERS = re.compile(r"(?:reader|user|post|article|visitor)?[_-]?comments?(?:[_-]?(?:list|area|section|thread|body|text|content|item|wrapper|wrap|container|block|box|entry|\d+))?|disqus_thread", re.I)
OUTSIDE = 80
#: What an element is: part of the text, boilerplate, a form, or readers' comments.
PLAIN, GONE, FORM, COMMENTS = range(4)
COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.S)
CDATA = re.compile(r"<!\[CDATA\[(.*?)(?:\]\]>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: From a tag's name to its end, past quoted values.
REST = re.compile(r"[^\"'>]*+(?:(?:\"[^\"]*+\"|'[^']*+')[^\"'>]*+)*+>")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：،؟]")
#: A path is content if its score is so large a part of the best path's.
THRESHOLD = 0.2
#: Paths of the region with a smaller part than this are left out; first inside named articles, then elsewhere.
FAINT = (0.01, 0.1)
#: What class and id names that speak for boilerplate leave of a path's score.
PRIOR = 0.1


class Tree:
    """Block elements in page order (0 is the page), and the text blocks in them.

    Paths are numbers that equal sequences of tags share; an element that its names
    mark as boilerplate is a step of its own kind.
    """

    def __init__(self) -> None:
        self.parent, self.tag, self.path = [0], [""], [0]
        self.kind, self.doubted = [PLAIN], [False]
        self.steps: dict[tuple[int, str, bool], int] = {}
        self.at: list[int] = []
        self.texts: list[str] = []

    def add(self, parent: int, tag: str, kind: int, doubted: bool) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        step = (self.path[parent], tag, doubted)
        self.path.append(self.steps.setdefault(step, len(self.steps) + 1))
        self.kind.append(kind)
        self.doubted.append(doubted or self.doubted[parent])
        return len(self.tag) - 1

    def dropped(self) -> list[bool]:
        """Whether each element is no part of the text.

        A form with prose and at least half of the text outside boilerplate is a block
        like others. Readers' comments go where a block of some length is outside them.
        """
        n = len(self.tag)
        gone, readers, whole, prose, longest = [False] * n, [False] * n, [0] * n, [False] * n, 0
        for e in range(1, n):
            up = self.parent[e]
            gone[e] = gone[up] or self.kind[e] == GONE
            readers[e] = readers[up] or self.kind[e] == COMMENTS
        for e, text in zip(self.at, self.texts, strict=True):
            if not gone[e]:
                whole[e] += len(text)
                prose[e] |= self.tag[e] in PROSE
        for e in range(n - 1, 0, -1):
            whole[self.parent[e]] += whole[e]
            prose[self.parent[e]] |= prose[e] or bool(whole[e]) and self.tag[e] in PROSE
        for e in range(1, n):
            wraps = self.kind[e] == FORM and prose[e] and 2 * whole[e] >= whole[0]
            gone[e] = gone[e] or gone[self.parent[e]] or self.kind[e] == FORM and not wraps
        for e, text in zip(self.at, self.texts, strict=True):
            if not gone[e] and not readers[e]:
                longest = max(longest, len(text))
        return [g or r for g, r in zip(gone, readers, strict=True)] if longest >= OUTSIDE else gone


def _judge(tag: str, attrs: str, in_article: bool) -> tuple[int, bool]:
    """What an element is by its tag, role, names or being hidden, and whether its names speak for boilerplate."""
    if tag in DROPPED and not (tag == "header" and in_article):
        return FORM if tag == "form" else GONE, False
    doubted, kind = False, PLAIN
    for m in ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            if any(READERS.fullmatch(word) for word in value.split()):
                kind, doubted = COMMENTS, True
            elif tag != "article":
                doubted |= bool(BOILERPLATE.search(value)) and not CONTENT.search(value)
        if name == "role" and value.lower() in ROLES:
            return GONE, False
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return GONE, False
    return kind, doubted


class _Open:
    """Open elements: name, tree element (-1 for inline ones) and where each name stands."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.element: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, element: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if element >= 0:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.element.append(element)

    def cut(self, i: int) -> None:
        while len(self.names) > i:
            self.places[self.names.pop()].pop()
            if self.element.pop() >= 0:
                self.blocks.pop()

    def last(self, name: str) -> int:
        held = self.places.get(name)
        return held[-1] if held else -1

    def block(self) -> int:
        return self.element[self.blocks[-1]] if self.blocks else 0


def read_page(page: str) -> Tree:
    """The page's elements and text blocks, each byte looked at a bounded number of times."""
    tree, open_ = Tree(), _Open()
    held: list[str] = []
    quoted, last = True, page.rfind(">")

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            tree.at.append(open_.block())
            tree.texts.append(text)

    def close(i: int) -> None:
        if open_.blocks and open_.blocks[-1] >= i:
            flush()
        open_.cut(i)

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            held.append(page[at:])
            break
        held.append(page[at:lt])
        if page.startswith("<!--", lt):
            at = COMMENT.match(page, lt).end()
            continue
        if page.startswith("<![CDATA[", lt):
            m = CDATA.match(page, lt)
            held.append(html.escape(m[1]))
            at = m.end()
            continue
        if page.startswith(("<!", "<?"), lt):
            at = page.find(">", lt) + 1
            continue
        m = NAME.match(page, lt)
        if m is None:
            held.append("<")
            at = lt + 1
            continue
        rest = REST.match(page, m.end()) if quoted else None
        if rest is None:
            quoted = False  # a quote that nothing closes: from here on tags end at the next bracket
            at = page.find(">", m.end()) + 1
        else:
            at = rest.end()
        tag, attrs = m[1].lower(), page[m.end() : at - 1]
        if tag == "br":
            held.append(" ")
        if page[lt + 1] == "/":
            i = open_.last(tag)
            # An inline element that a block outlived stays as it is.
            if i >= 0 and (open_.element[i] >= 0 or not open_.blocks or open_.blocks[-1] < i):
                close(i)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if tag == "plaintext" or shut is None:
                break
            at = (page.find(">", shut.start()) + 1) or end
            continue
        if tag in INLINE or tag == "label" and open_.blocks and open_.names[open_.blocks[-1]] in RUNNING:
            open_.push(tag, -1)
            continue
        if attrs.endswith("/") and tag in ("svg", "path", "use"):
            continue
        flush()
        if tag in CLOSES_P and open_.blocks and open_.names[open_.blocks[-1]] == "p":
            open_.cut(open_.blocks[-1])
        if tag in IMPLIED:
            ends, bound = IMPLIED[tag]
            above = max((open_.last(b) for b in bound), default=-1)
            low = [places[bisect_right(places, above)] for e in ends if (places := open_.places.get(e)) and places[-1] > above]
            if low:
                open_.cut(min(low))
        within = bool(open_.places.get("article") or open_.places.get("main"))
        open_.push(tag, tree.add(open_.block(), tag, *_judge(tag, attrs, within)))
    flush()
    return tree


def path_scores(path: np.ndarray, length: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Of each block, its path's score: text and punctuation in ratio to the path's nodes, smoothed over neighbours, fused."""
    _, kind = np.unique(path, return_inverse=True)
    nodes = np.bincount(kind)
    ratio = lambda x: (np.bincount(kind, weights=x) / nodes)[kind]
    kernel = np.array([0.25, 0.5, 0.25])
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), kernel, mode="valid")
    return ratio(np.log1p(smooth(ratio(length))) * (1.0 + np.log1p(smooth(ratio(marks)))))


def main_text(page: str | None) -> str:
    """The article's blocks joined by an empty line; empty if there is none."""
    tree = read_page(page or "")
    dropped = tree.dropped()
    live = [i for i, e in enumerate(tree.at) if not dropped[e]]
    if not live:
        return ""
    at = np.array([tree.at[i] for i in live])
    length = np.array([len(tree.texts[i]) for i in live], dtype=float)
    marks = np.array([len(PUNCTUATION.findall(tree.texts[i])) for i in live], dtype=float)
    doubted = np.array(tree.doubted)[at]
    path = np.array(tree.path)[at]
    score = path_scores(path, length, marks)
    # Paths compete by their score and all the text they have.
    strong = score * np.log1p(np.bincount(path, weights=length)[path]) * np.where(doubted, PRIOR, 1.0)
    content = strong >= THRESHOLD * strong.max()

    # Sums over subtrees: elements are numbered in page order, so children come after their parents.
    n = len(tree.tag)
    weight = np.bincount(at[content], weights=length[content], minlength=n).tolist()
    last, deep, named = list(range(n)), [0] * n, [False] * n
    for e in range(1, n):
        deep[e] = deep[tree.parent[e]] + 1
    for e in range(n - 1, 0, -1):
        up = tree.parent[e]
        weight[up] += weight[e]
        last[up] = max(last[up], last[e])
    whole = weight[0]
    roots: list[int] = []
    for e in range(1, n):
        if tree.tag[e] in ("article", "main") and weight[e] >= 0.3 * whole:
            named[e] = True
            if not roots or e > last[roots[-1]]:
                roots.append(e)
    if roots and not any(tree.tag[r] == "article" for r in roots):
        inner = [e for e in range(1, n) if named[e] and tree.tag[e] == "article" and weight[e] >= 0.6 * whole]
        roots = [max(inner, key=lambda e: deep[e])] if inner else roots
    faint = FAINT[0]
    if not roots:
        faint, root = FAINT[1], max((e for e in range(n) if weight[e] >= 0.8 * whole), key=lambda e: deep[e])
        holders = set(at.tolist())
        while root in holders and root and len(live) > 1:
            root = tree.parent[root]
        roots = [root]
    inside = np.zeros(len(live), dtype=bool)
    for r in roots:
        inside |= (at >= r) & (at <= last[r])
    kept = inside & (content | (~doubted & (score >= faint * score.max())))
    return "\n\n".join(tree.texts[i] for i, k in zip(live, kept, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) per row of ``pages``.

    A null or empty html and pages without text give an empty text. Rows that repeat
    are each returned; other columns are ignored.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(page):
        worker_cache(None)
        return page.map(main_text, na_action=None)

    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("_html"))
    out = slim.withColumn("text", text("_html")).drop("_html")
    return out.withColumn("n_chars", F.length("text").cast("long"))
