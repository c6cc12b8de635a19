"""A pack's automaton against plain searches, over given tables and edge cases."""

import re

import pytest
from pyspark.sql import functions as F

from lurescope.operators import rulepack, rules
from lurescope.plans import pages

DATA = "/root/testdata/sf0.001"


def plain(data, value, fold, whole):
    low, key = (data.lower(), value.lower()) if fold else (data, value)
    at, out = low.find(key), []
    while at >= 0:
        if not whole or not re.match(rb"[0-9A-Za-z]", data[at + len(key) : at + len(key) + 1]) and not re.match(rb"[0-9A-Za-z]", data[max(at - 1, 0) : at]):
            out.append((at, len(key)))
        at = low.find(key, at + 1)
    return out


def plain_regex(data, value, fold):
    return [(i, m.end() - i) for i in range(len(data)) if (m := re.compile(value, re.I if fold else 0).match(data, i)) and m.end() > i]


@pytest.mark.parametrize(("name", "key", "text"), [("pages", "page_id", "html"), ("documents", "doc_id", "text")])
def test_offsets_equal_plain_searches(spark, name, key, text):
    pack = pages._pack()
    assert len(pack) == 10
    files = spark.read.parquet(f"{DATA}/{name}.parquet")
    got = {}
    for x in rulepack.string_matches(files, key, text, pack, flush=50).collect():
        got.setdefault((x["id"], x["rule"], x["string"]), []).append((x["offset"], x["length"], x["matched"], x["before"], x["after"]))
    assert got
    show = lambda b: b.decode("utf-8", "replace")
    for r in files.select(key, text).collect():
        data = (r[text] or "").encode()
        for rule in pack:
            for s, (kind, value, fold) in rule.strings.items():
                want = plain(data, value.encode(), fold, s in rule.whole) if kind == "text" else sorted(plain_regex(data, value.encode(), fold))
                want = [(at, n, show(data[at : at + n]), show(data[max(at - 64, 0) : at]), show(data[at + n : at + n + 64])) for at, n in want]
                assert sorted(got.get((r[key], rule.name, s), [])) == want, (rule.name, s)
    # Conditions over counts against conditions over the text.
    plainly = {r[key]: r["rules"] for r in rules.scan(files, text, pack).select(key, "rules").collect()}
    assert {r[key]: r["rules"] for r in rulepack.scan_pack(files, text, pack).select(key, "rules").collect()} == plainly and any(plainly.values())


SOURCE = r"""
rule a { strings: $x = "Ab\x43" $y = "abc" nocase $z = "bc" fullword $o = "aa" condition: any of them }
rule none { strings: $x = "never" condition: not $x }
rule many { strings: $o = "aa" condition: #o >= 3 }
rule always { condition: true }
"""


def test_edges(spark):
    pack = rules.parse_rules(SOURCE)
    rows = [(1, "AbC abc xbc bc"), (2, None), (3, ""), (4, "aaaa"), (5, "é bc é"), (5, "é bc é"), (6, "x" * 200_000 + "abc")]
    files = spark.createDataFrame([(*r, 0) for r in rows], "id long, body string, rule int")
    got = sorted((x["id"], x["rule"], x["string"], x["offset"], x["length"]) for x in rulepack.string_matches(files, "id", "body", pack).collect())
    assert [g for g in got if g[0] == 1] == [(1, "a", "$x", 0, 3), (1, "a", "$y", 0, 3), (1, "a", "$y", 4, 3), (1, "a", "$z", 12, 2)]
    assert [g[3] for g in got if g[0] == 4 and g[1] == "many"] == [0, 1, 2]
    assert [g[1:] for g in got if g[0] == 5] == [("a", "$z", 3, 2)] * 2 and [g[3] for g in got if g[0] == 6] == [200_000]
    hits = {r["id"]: r["rules"] for r in rulepack.scan_pack(files, "body", pack).collect()}
    assert hits == {1: ["a", "none", "always"], 2: ["none", "always"], 3: ["none", "always"], 4: ["a", "none", "many", "always"], 5: ["a", "none", "always"], 6: ["a", "none", "always"]}
    assert rulepack.scan_pack(files.limit(0), "body", pack).count() == 0
    assert rulepack.scan_pack(files, "body", []).filter(F.size("rules") > 0).count() == 0 and rulepack.string_matches(files, "id", "body", []).count() == 0


def test_files_with_errors_are_left_out(tmp_path):
    (tmp_path / "a.yar").write_text('rule one { strings: $a = "x" condition: $a }')
    (tmp_path / "b.yara").write_text('\n\nrule two { strings: $a = "x" condition: $b }')
    (tmp_path / "c.yar").write_text('rule one { condition: true }\nrule three { strings: $r = /a(b/ condition: $r }')
    (tmp_path / "d.yar").write_text('rule one { condition: true }\nrule four { condition: false }')
    (tmp_path / "e.txt").write_text("no rules")
    got, errors = rulepack.load_rules([str(tmp_path)])
    assert [r.name for r in got] == ["one", "four"] and got[0].strings
    assert [(e["file"], e["line"]) for e in errors] == [("b.yara", 3), ("c.yar", None)]
    assert rulepack.check_rules(" ")[0]["message"] == "empty source" and rulepack.check_rules('include "x"\nrule a { condition: true }')[0]["line"] == 1
