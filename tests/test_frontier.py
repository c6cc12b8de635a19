"""Frontier expansion against a plain loop: budgets, addresses seen before, roots that are links."""

import random

import pytest

from lurescope.operators import frontier


def plain(roots, links, max_depth, per_kit, budget):
    norm = lambda u: u.rstrip("/").lower()
    of = {}
    for url, target, source, position in links:
        if target and target.startswith(("http://", "https://")) and target != url and source in frontier.SOURCES:
            kept = of.setdefault(url, {})
            kept[target] = min(kept.get(target, (9, 0)), (frontier.SOURCES.index(source), position))
    out = set()
    for inv in {r[0] for r in roots}:
        seen, level = {}, sorted({norm(u): min(v for j, v in roots if j == inv and v and norm(v) == norm(u)) for i, u in roots if i == inv and u}.items())
        level = [(k, u, None, 0, None, None) for k, u in level][:budget]
        for depth in range(max_depth + 1):
            seen |= {x[0]: x for x in level}
            found = {}
            for _, url, *_ in level:
                for rank, (target, (kind, _)) in enumerate(sorted(of.get(url, {}).items(), key=lambda x: (x[1], x[0]))[:per_kit], 1):
                    if norm(target) not in seen:
                        found[norm(target)] = min(found.get(norm(target), ("~",)), (url, rank, target, frontier.SOURCES[kind]))
            level = [(k, t, p, depth + 1, s, r) for p, r, k, t, s in sorted((p, r, k, t, s) for k, (p, r, t, s) in found.items())]
            level = level[: max(0, budget - len(seen))] if budget else level
        out |= {(inv, *x[1:]) for x in seen.values() if x[3] <= max_depth}
    return out


@pytest.mark.parametrize(("depth", "per_kit", "budget"), [(3, 10, None), (4, 2, 12), (2, 3, 5), (5, 1, None)])
def test_against_a_plain_loop(spark, depth, per_kit, budget):
    r = random.Random(depth)
    page = lambda: r.choice(["http://a.x/", "http://A.x/", "https://b.y/p?q=", "ftp://c/"]) + str(r.randrange(14)) + r.choice(["", "", "/"])
    links = [(page(), r.choice([page(), None]), r.choice([*frontier.SOURCES, "script"]), r.randrange(4)) for _ in range(160)]
    roots = [(1, "http://a.x/1"), (1, "http://a.x/1/"), (2, "https://b.y/p?q=2"), (None, "http://a.x/3"), (2, None)]
    got = frontier.expand(spark.createDataFrame(roots, "investigation_id int, url string"), spark.createDataFrame(links, "url string, target string, source string, position int"), depth, per_kit, budget)
    rows = [tuple(x) for x in got.select("investigation_id", "url", "parent_url", "depth", "source", "rank").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(roots, links, depth, per_kit, budget)


def test_nothing(spark):
    roots = spark.createDataFrame([], "investigation_id int, url string")
    links = spark.createDataFrame([], "url string, target string, source string, position int")
    assert frontier.expand(roots, links, per_investigation=3).count() == 0
