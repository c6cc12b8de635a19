"""The pipeline against brute force, stage by stage, each on its own input."""

import re
from collections import Counter

import corpus_pipeline
from lurescope.llm import mixing
from tests.llm.test_operators import DOCS, brute_near, corpus, norm


def fold(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_stages(spark, tmp_path):
    rows = [r for r in corpus(3) if r[0] is not None]
    spark.createDataFrame(list(dict.fromkeys(rows)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    leak = "w1 w2 w3 secret words of the benchmark that nobody else has"
    extra = [(9000 + i, f"intro {i} {leak} end {i}", "en", "s1", 0, None, None, None, None, None) for i in range(3)] + [(9100, "1234 ... 567", "en", "s1", 0, None, None, None, None, None)]
    spark.createDataFrame(extra, DOCS).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.stage(step(spark, docs, str(tmp_path)), "test")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "mixing":
            assert docs.columns == columns and all(after[i] == before[i] for i in after)
        if name == "language_id":
            assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
        if name == "exact_dedup":
            best = {}
            for i, r in before.items():
                k = norm(r["text"])
                best[k] = min(best.get(k, (0, i)), (-len(r["text"] or ""), i))
            assert set(after) == {i for _, i in best.values()}
        if name == "near_dedup":
            assert set(after) == {i for i, _, c in brute_near([(i, r["text"]) for i, r in before.items()]) if i == c}
        if name == "decontamination":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
            w = words(leak)
            wins = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
            hit = {i for i, r in before.items() if any(tuple(x[k : k + 10]) in wins for x in [words(r["text"])] for k in range(len(x)))}
            assert hit and set(after) == set(before) - hit
        if name == "mixing":
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            total = Counter()
            for r in before.values():
                total[r["source"]] += size(r["text"])
            want = mixing.targets_of(total)
            for r in after.values():
                assert r["taken"] == r["copies"] * r["size"] > 0 and abs(r["target"] - want[r["source"]]) < 1e-6
    got = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: r["taken"] for i, r in after.items()}


def test_null_and_repeated_ids_are_rows_like_others(spark, tmp_path):
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    leak = "one secret question of the benchmark that nobody else has written"
    rows = [(1, "alpha beta gamma delta epsilon zeta", "s"), (1, "alpha beta gamma delta epsilon zeta", "s"), (1, "a different text under the same id", "s"), (None, "alpha beta gamma delta epsilon zeta", "s"),
            (None, long, "t"), (None, long + " more", "t"), (5, f"before {leak} after", "s"), (5, "kept though it shares an id", None), (None, f"x {leak}", "s"), (6, None, "s")]
    docs = spark.createDataFrame([(i, t, "en", s, 0, "k") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, _n string")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = lambda f: sorted(((r["doc_id"], r["text"]) for r in f(spark, docs, str(tmp_path)).collect()), key=repr)
    plain = sorted(((i, t) for i, t, _ in rows), key=repr)
    gone = kept(corpus_pipeline.exact)
    assert len(gone) == len(plain) - 2 and set(gone) <= set(plain) and sum("alpha" in (t or "") for _, t in gone) == 1
    gone = kept(corpus_pipeline.near)
    assert len(gone) == len(plain) - 3 and sum("worda" in (t or "") for _, t in gone) == 1
    assert kept(corpus_pipeline.decontamination) == [r for r in plain if leak not in (r[1] or "")]
    mixed = corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect()
    assert any(r["doc_id"] is None for r in mixed) and all(r["taken"] == r["copies"] * r["size"] > 0 for r in mixed)
