"""Page structure against a plain version that holds every path whole."""

import hashlib
import random
import re
import time
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from lurescope.operators import polymorphism as poly
from lurescope.operators import similarity
from lurescope.plans import catalog

PATTERNS = [(n, re.compile(p, re.I if f else 0)) for n, p, f in poly.TOKENS]


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.stack, self.found, self.text = [], [], ""

    def handle_starttag(self, tag, attrs):
        self.settle()
        self.stack.append(tag)
        field = None
        if tag in ("input", "select", "textarea"):
            a = {k: "__VAR__" if v and any(p.fullmatch(v) for _, p in PATTERNS) else v or "" for k, v in attrs}
            field = f"{tag}[name={a.get('name', '')},type={a.get('type', '')}]"
        self.found.append([">".join(self.stack), None, field])

    def handle_endtag(self, tag):
        self.settle()
        if self.stack and self.stack[-1] == tag:
            self.stack.pop()

    def handle_data(self, data):
        self.text += data

    def settle(self):
        text, self.text = self.text.strip(), ""
        if text and self.found:
            self.found[-1][1] = text


def plain(page):
    p = Plain()
    p.feed(page or "")
    p.settle()
    return p.found


def chain(path):
    key = ""
    for tag in path.split(">"):
        key = poly.chained(key, tag)
    return key


def random_page(r):
    out = []
    for _ in range(r.randint(0, 25)):
        tag = r.choice(["div", "p", "br", "img", "input", "select", "form", "a", "li"])
        attrs = r.choice(["", " name=x", f" name='{r.choice(['user', 'f' * 32, '1700000000'])}' type=hidden", " name"])
        out.append(r.choice([f"<{tag}{attrs}>", f"</{tag}>", f"<{tag}{attrs}/>", r.choice(["one", " two ", "&amp;", "\n", str(10**10 + r.randint(0, 9))]), "<!-- c -->"]))
    return "".join(out)


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(4)
    base = [random_page(r) + "<form><input name=a></form>" for _ in range(6)]
    rows = [(i, f"h{i % 9}", r.choice(base) if i % 2 else random_page(r)) for i in range(90)]
    rows += [(900, "h1", None), (901, "h1", ""), (902, None, "<p>x"), (903, "alone", "<p>y"), (904, "void", "<br>" * 10_000 + "x<p>"), (905, "void", "<br>" * 9_999 + "y<p>")]
    return rows, spark.createDataFrame(rows, "page_id long, host string, html string").repartition(3)


def test_elements_and_skeletons(spark, pages):
    rows, df = pages
    got = defaultdict(list)
    for x in poly.elements(df.filter("page_id < 904"), "page_id", "html", "host", flush=7).collect():
        got[x["id"]].append((x["at"], x["path"], x["text_hash"], x["field"], x["depth"]))
    digest = lambda t: t and hashlib.sha256(t.encode()).hexdigest()[:16]
    for i, _, page in rows:
        if i < 904:
            assert [x[1:] for x in sorted(got[i])] == [(chain(p), digest(t), f, p.count(">") + 1) for p, t, f in plain(page)]
    for x in poly.skeletons(df, "page_id", "html").collect():
        paths = [p for p, _, _ in plain(dict((r[0], r[2]) for r in rows)[x["page_id"]])]
        want = hashlib.sha256("\n".join(paths).encode()).hexdigest()[:32] if paths else None
        assert (x["n_elements"], x["n_paths"], x["skeleton_hash"]) == (len(paths), len(set(paths)), want)


def test_space_is_linear_in_tags():
    began = time.perf_counter()
    found = poly.read_elements("<br>" * 200_000)
    assert len(found.rows) == 200_000 and found.rows[-1][4] == 200_000 and time.perf_counter() - began < 20


def plain_groups(rows):
    groups = defaultdict(list)
    for i, host, page in rows:
        if host is not None:
            groups[host].append((i, page, plain(page)))
    return {h: g for h, g in groups.items() if len(g) > 1}


def test_groups(spark, pages):
    rows, df = pages
    digests = similarity.tlsh_digests(df, "page_id", "html")
    of = {r["page_id"]: r["tlsh"] for r in digests.collect()}
    distance = lambda a, b: int(similarity.tlsh_distances(similarity.pd.DataFrame({"d": [a]}), similarity.pd.DataFrame({"d": [b]}))[0, 0])
    want = {}
    for host, group in plain_groups(rows).items():
        sets = [{p for p, _, _ in found} for _, _, found in group]
        union, shared = set().union(*sets), set.intersection(*sets)
        texts = defaultdict(set)
        for _, _, found in group:
            for p, t, _ in found:
                if t:
                    texts[p].add(t)
        fields = [{f for _, _, f in found if f} for _, _, found in group]
        varying = set().union(*fields) - set.intersection(*fields)
        tokens = [n for n, p in PATTERNS if any(p.search(page or "") for _, page, _ in group)]
        held = [of[i] for i, _, _ in group if i in of]
        poly_ = any(30 < distance(a, b) <= 200 for k, a in enumerate(held) for b in held[k + 1 :])
        sim = len(shared) / max(len(union), 1)
        confidence = round(min(round(sim, 3) * 0.7 + 0.2 * bool(tokens) + 0.1 * bool(varying), 1.0), 3) if poly_ else None
        want[host] = (len(group), len(union), len(shared), len([p for p in shared if len(texts[p]) < 2]), round(sim, 3), len(set().union(*fields)), len(varying), tokens, poly_, confidence)
    got = {r["grp"]: tuple(r)[1:] for r in poly.polymorphism(df, digests, "page_id", "host", "html").collect()}
    assert set(got) == set(want) and "void" in got and got["void"][1] == 10_002
    for host, w in want.items():
        assert got[host][:-1] == w[:-1] and got[host][-1] == (w[-1] if w[-1] is None else pytest.approx(w[-1])), host
    empty = df.limit(0)
    assert poly.polymorphism(empty, digests.limit(0), "page_id", "host", "html").count() == 0


def test_any_pair_between_decides_what_a_pivot_leaves_open(spark):
    r = random.Random(2)
    head = "T1000000"
    body = "".join(r.choice("0123456789ABCDEF") for _ in range(64))
    flip = lambda n: body[:-n] + "".join("0" if c != "0" else "1" for c in body[-n:]) if n else body
    rows = [("near", head + flip(k)) for k in range(4)] + [("far", head + "0" * 64), ("far", head + "F" * 64), ("far", head + "5" * 64)] + [("two", head + flip(0)), ("two", head + flip(1)), ("one", head + body)]
    df = spark.createDataFrame(rows, "g string, d string")
    frame = similarity.pd.DataFrame
    for above, most in [(0, 5), (2, 30), (30, 200), (100, 130)]:
        want = {g for g, a in rows for h, b in rows if g == h and a < b and above < similarity.tlsh_distances(frame({"d": [a]}), frame({"d": [b]}))[0, 0] <= most}
        assert {x["grp"] for x in similarity.any_pair_between(df, "g", "d", above, most).collect()} == want


def test_queries_run_over_given_pages(spark):
    got = catalog.QUERIES["page_structural_diff"](spark, "/root/testdata/sf0.001")
    one = got.groupBy("host").agg({"n_pages": "max", "variants": "max"}).collect()
    assert one and all(r["max(n_pages)"] <= r["max(variants)"] for r in one)


def test_pages_go_to_workers_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    poly.elements(spark.createDataFrame([(1, "<a>")], "page_id long, html string"), "page_id", "html")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "2m" and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1024"
