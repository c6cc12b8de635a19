"""Repeated kits against a plain loop, with real digests too."""

import random

from lurescope.operators import duplicates as dup
from lurescope.operators import similarity

KIND = "kit_id long, parent_kit_id long, investigation_id long, url string, rendered boolean, sha string, digest long, created_at int"


def plain(kits, near, max_depth=5):
    by, out = {k[0]: k for k in kits}, {}
    same = lambda a, b: a is not None and a == b
    for k in kits:
        if not k[4]:
            continue
        found, at = None, k
        for depth in range(1, max_depth + 1):
            at = by.get(at[1])
            if at is None:
                break
            via = "url" if at[4] and same(k[3], at[3]) else "digest" if near(k[6], at[6]) else "sha256" if same(k[5], at[5]) else None
            if via:
                found = (at, "ancestor", via, depth)
                break
        order = sorted((x for x in kits if x[0] != k[0]), key=lambda x: (x[7], x[0]))
        for x in order if found is None and k[1] is not None else ():
            if x[1] == k[1] and x[4] and (near(k[6], x[6]) or same(k[5], x[5])):
                found = (x, "sibling", "digest" if near(k[6], x[6]) else "sha256", None)
                break
        if found is None:
            able = [x for x in order if same(k[5], x[5])]
            own = [x for x in able if k[2] is not None and x[2] == k[2]]
            if able:
                found = ((own or able)[0], "content", "sha256", None)
        if found:
            x, relation, via, depth = found
            out[k[0]] = (x[0], relation, via, depth, "correlated" if x[2] != k[2] else "stuck_at_gate" if relation == "ancestor" else "duplicate")
    return out


def shown(df):
    return {r["kit_id"]: tuple(r)[1:] for r in df.collect()}


def test_against_a_plain_loop(spark):
    r = random.Random(3)
    near = lambda a, b: a is not None and b is not None and abs(a - b) <= 3
    kits = [(k, r.choice([None, k // 4, k // 4, 9999]) if k else None, r.choice([1, 2, None]), r.choice([None, "u1", "u2"]) if r.random() < 0.2 else f"u{k}", r.random() < 0.7, r.choice([None, f"s{r.randrange(60)}"]), r.choice([None, r.randrange(4000)]), r.randrange(5)) for k in range(150)]
    kits += [(200 + i, 7, 1, f"h{i}", True, "hot", 10_000 + i // 3, 1) for i in range(40)]
    df = spark.createDataFrame(kits, KIND)
    got = shown(dup.decide(df, dup.number_closeness(3)))
    assert got == plain(kits, near) and {v[1] for v in got.values()} == {"ancestor", "sibling", "content"}
    assert dup.decide(df.limit(0), dup.number_closeness(3)).count() == 0


def test_with_real_digests(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdefghij klmnop") for _ in range(400)) for _ in range(3)]
    texts = [b[:-n] + "x" * n for b in base for n in (1, 2, 5)] + [None, "short"]
    of = {t: similarity.tlsh_digest(t.encode(), similarity.permutation()) if t else None for t in texts}
    kits = [(k, k // 3 if k else None, 1, None, True, None, of[texts[k % len(texts)]], k) for k in range(40)]
    near = lambda a, b: a is not None and b is not None and int(similarity.tlsh_distances(similarity.pd.DataFrame({"d": [a]}), similarity.pd.DataFrame({"d": [b]}))[0, 0]) <= 30
    got = shown(dup.decide(spark.createDataFrame(kits, KIND.replace("digest long", "digest string")), dup.tlsh_closeness(30)))
    assert got == plain(kits, near) and got
