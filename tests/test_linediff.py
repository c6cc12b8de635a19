"""Line diffs against a plain table of common subsequences."""

import difflib
import random
import time
from collections import Counter

from lurescope.operators import linediff as ld


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_edit_scripts_are_minimal():
    r = random.Random(1)
    for _ in range(400):
        a, b = ([r.choice("abcde"[: r.randint(1, 5)]) for _ in range(r.randint(0, 30))] for _ in range(2))
        gone, new = ld.unmatched(a, b)
        left, right = [x for i, x in enumerate(a) if i not in set(gone)], [x for i, x in enumerate(b) if i not in set(new)]
        assert left == right and len(left) == plain_lcs(a, b)
        matches = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert len(left) >= matches


def test_long_pages_take_bounded_time():
    r = random.Random(2)
    a, b = [r.randrange(5000) for _ in range(12_000)], [r.randrange(5000) for _ in range(12_000)]
    began = time.perf_counter()
    gone, new = ld.unmatched(a, b)
    assert len(a) - len(gone) == len(b) - len(new) and time.perf_counter() - began < 30


def test_classes():
    a = "<!DOCTYPE html><html><head><title>One</title></head><body><div class='x1'><a href='/a'>go</a><input name=u id=v><br>text\nmore</div><!-- c --></body></html>"
    b = a.replace("One", "Two").replace("x1", "x2").replace("'/a'", "'/b'").replace("name=u", "name=w")
    assert ld.page_lines(a)[:6] == ["<!DOCTYPE html>", "<html>", "  <head>", "    <title>", "      One", "    </title>"]
    got = ld.diff_pages(a, b)
    assert (got["removed"], got["added"]) == (4, 4) and {n: got[n] for n in ld.NAMES} == {"css_class": 2, "title": 0, "url": 2, "form_id": 2, "other": 2}
    assert got["examples"][0] == 'css_class: <div class="x1">' and got["paths_shared"] == got["paths"] > 0
    assert ld.class_of('<h1 CLASS = "a" href="x">') == "css_class" and ld.class_of("<h2>") == "title"
    same = ld.diff_pages(a, a)
    assert same["removed"] == same["added"] == 0 and same["examples"] == []
    nothing = ld.diff_pages(None, "")
    assert nothing["lines_a"] == nothing["lines_b"] == nothing["paths"] == 0


def test_pairs(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b", 0), (2, "<p>a<p>c", 0), (3, None, 0), (3, None, 0)], "page_id long, html string, a int")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 9)], "a long, b long")
    got = Counter((r["a"], r["b"], r["removed"], r["added"], r["similarity"]) for r in ld.compare(pages, pairs, "page_id", "html").collect())
    assert got == {(1, 2, 1, 1, 1.0): 1, (2, 1, 1, 1, 1.0): 1, (1, 3, 4, 0, 0.0): 2}
    assert ld.compare(pages, pairs.limit(0), "page_id", "html").count() == 0


def test_query_equals_plain_counts(spark):
    from lurescope.plans import catalog

    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    hosts = {}
    for i in sorted(pages):
        hosts.setdefault(pages[i]["url"].split("/")[2].split(":")[0].lower(), []).append(i)
    want = {(a, b) for ids in hosts.values() for a, b in zip(ids, ids[1:])}
    got = catalog.QUERIES["page_line_diff"](spark, "/root/testdata/sf0.001").collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    for r in got:
        x, y = ld.page_lines(pages[r["a"]]["html"]), ld.page_lines(pages[r["b"]]["html"])
        common = plain_lcs(x, y)
        assert (r["removed"], r["added"]) == (len(x) - common, len(y) - common)
        assert sum(r[n] for n in ld.NAMES) <= r["removed"] + r["added"]


def test_lines_without_marks_are_not_searched(monkeypatch):
    searched = []

    class Pattern:
        def __init__(self, p):
            self.p = p

        def search(self, line):
            searched.append(line)
            return self.p.search(line)

    lines = ["plain words", "a = b", "ID = 'x'", '<h2 claſs="x">', '<a href="x">', "<title>", "hrefs: 'x'", "<p>", "it's = a name='y'", ""]
    want = [next((n for n, p in ld.CLASSES if p.search(x)), ld.OTHER) for x in lines]
    monkeypatch.setattr(ld, "CLASSES", [(n, Pattern(p)) for n, p in ld.CLASSES])
    assert [ld.class_of(x) for x in lines] == want and len(set(want)) == 5
    assert not {"plain words", "a = b", "hrefs: 'x'", ""} & set(searched)
