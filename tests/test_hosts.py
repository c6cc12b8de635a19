"""Domains and web addresses of lines against a plain version, and over whole pages."""

import random
import re

from pyspark.sql import functions as F

from lurescope.functions import hosts, urls
from lurescope.functions import lookups as lk
from lurescope.functions import text as tx
from lurescope.plans import catalog

SERVICES = ("office.com", "cdn.net")
LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?"
NAME = re.compile(rf"(?<![a-zA-Z0-9/\-_%.:])({LABEL}(?:\.{LABEL})*\.[a-zA-Z]{{2,6}})(?![/\w.])")


def root(name):
    labels = name.split(".")
    return ".".join(labels[-3:] if len(labels) > 2 and ".".join(labels[-2:]) in urls.ROOT_SUFFIXES else labels[-2:])


def plain_domains(line):
    """The gates one after another, as a person would list them."""
    known, out = set(SERVICES) | set(lk.EMAIL_EXCLUSIONS), []
    for name in dict.fromkeys(x.lower() for x in NAME.findall(line)):
        labels = name.split(".")
        if name.startswith(("2f", "3a", "3d", "26", "3f")) or "3a2f" in name or "2f2f" in name:
            continue
        if root(name) in known or any(k != name and k.endswith(name) for k in known):
            continue
        if name in lk.SCRIPT_NAMES or labels[0] in lk.SCRIPT_OBJECTS or labels[-1] not in lk.TLDS:
            continue
        if (len(labels) > 3 and set(labels) & set(lk.MESSAGE_LABELS)) or (len(labels) > 2 and set(labels) & set(lk.STATE_LABELS)):
            continue
        if len(name) < 5 or min(map(len, labels)) < 2 or "--" in name or (labels[1:] == ["is"] and "-" in labels[0]):
            continue
        if len(labels) == 2 and labels[1] in lk.SCRIPT_TLDS and "-" not in labels[0] and (not 4 <= len(labels[0]) <= 12 or labels[1] == "id"):
            continue
        out.append(name)
    return sorted(out)


def test_domains_against_plain_version(spark):
    rng = random.Random(7)
    parts = ["evil", "a", "this", "office", "ffice", "cdn", "login-box", "error", "input", "show", "x--y", "com", "co", "uk", "net", "id", "is", "me", "php", "rootfunctionvar", "2fwww", "ru", "message", "window", "top", "MX", "café"]
    seams = [" ", "@", "/", ".", "..", "'", "(", "_", "%", ":", "é", ", "]
    lines = ["", None, "see evil.com.", "see evil.com now", "a.evil.co.uk", "office.com ffice.com sub.office.com", "x" * 70 + ".com", "a." * 30_000 + "com", ("ab." * 124) + "com", "tbody.collapse.in", "vat.input.error.il", "evil.comé good-one.is"]
    for _ in range(600):
        lines.append("".join(".".join(rng.choices(parts, k=rng.randint(1, 5))) + rng.choice(seams) for _ in range(rng.randint(1, 4))))
    df = spark.createDataFrame(list(enumerate(lines)), "i int, x string")
    got = {r["i"]: sorted(r["d"] or []) for r in df.select("i", hosts.domains(F.col("x"), SERVICES).alias("d")).collect()}
    want = {i: plain_domains(x) if x and len(x) < 9999 else [] for i, x in enumerate(lines)}
    assert got == want
    assert sum(map(len, want.values())) > 50


CASES = [
    ("go https://drop.evil.com/gate.php now", [("c2_url", "https://drop.evil.com/gate.php", 85)]),
    ("src='https://drop.evil.com/gate.js';", [("domain", "drop.evil.com", 50)]),
    ("<a href=\"https://Evil.com/login\">", [("domain", "evil.com", 50)]),
    ("steal https://evil.com/login;", [("c2_url", "https://evil.com/login", 85)]),
    ("'https://evil.com/'+path", [("domain", "evil.com", 50)]),
    ("'https://evil'+'.com/path/x'", []),
    ("https://www.office.com/grab https://localhost/gate.php https://intranet/gate.php https://a.test/gate.php", []),
    ("https://api.telegram.org/bot1:a/sendMessage'", [("c2_url", "https://api.telegram.org/bot1:a/sendMessage", 95)]),
    ("https://evil.com*/*,:after,:before", []), ("https://evil.com/x?y==", []),
    ("wss://evil.com/socket'; WS://sub.lure.com/socket; ws://office.com/socket", [("c2_url", "wss://evil.com/socket", 90)]),
    ("https://sub.lure.com/gate.php", []), ("https://user:pw@evil.com:8080/a;v=1/b.js;w=2?q", [("domain", "evil.com", 50), ("domain", "evil.com", 60), ("email", "pw@evil.com", 70)]),
    ("fetch('//login.live.com/x')", [("c2_url", "https://login.live.com", 90)]),
    ("host mx.evil.com", [("domain", "mx.evil.com", 80)]), ("at evil.com", [("domain", "evil.com", 60)]),
    ("logo@2x.png user@evil.ru drop@evil.ru x@gmail.com", [("email", "drop@evil.ru", 70), ("domain", "evil.ru", 60)]),
    ("t.me/dark_admin @everyone telegram", [("telegram_handle", "@dark_admin", 70)]), (None, []), ("", []),
]


def test_indicators_with_a_source(spark):
    df = spark.createDataFrame([(i, x, "lure.com") for i, (x, _) in enumerate(CASES)], "i int, x string, r string")
    got = {r["i"]: {tuple(v) for v in r["v"]} for r in df.select("i", tx.iocs(F.col("x"), F.col("r"), SERVICES).alias("v")).collect()}
    assert got == {i: set(w) for i, (_, w) in enumerate(CASES)}


def test_sign_in_hosts_need_a_source(spark):
    df = spark.createDataFrame([("login.live.com",)] * 3, "x string").withColumn("r", F.when(F.rand(1) < 0, "x"))
    assert {r["n"] for r in df.select(F.size(hosts.shown_sign_ins(F.col("x"), F.col("r"))).alias("n")).collect()} == {0}
    assert {r["n"] for r in df.select(F.size(hosts.shown_sign_ins(F.col("x"), F.lit("live.com"))).alias("n")).collect()} == {0}


def test_whole_pages(spark, tmp_path):
    rows = [
        (1, "https://lure.com/", "a\n" + "x " * 60_000 + "at late.evil.com\nhost late.evil.com https://lure.com/own", "n"), (1, "https://lure.com/", "at late.evil.com", "n"),
        (2, None, None, None), (3, "not a url", "", "n"), (4, "https://login.live.com/", "login.live.com", None), (None, "https://b.com", "accounts.google.com", "n"),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string, type string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in catalog.QUERIES["page_indicators"](spark, str(tmp_path)).collect()}
    assert got == {(1, "domain", "late.evil.com", 80), (None, "c2_url", "https://accounts.google.com", 90)}
