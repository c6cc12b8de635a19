"""Attack-flow stages: roles, comparison, clusters and alignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text and host marks of a role.
DECOY_HOSTS = ("temu.com", "dhgate.com", "aliexpress.", "mvideo.ru", "office.com", "microsoft.com", "google.com", "bing.com", "duckduckgo.com", "wikipedia.org", "example.com")
BOT_MARKS = ("verify you are human", "verifying you are human", "checking your browser", "just a moment", "cloudflare", "ddos protection", "i'm not a robot", "press and hold", "review the security", "ray id")
WAIT_MARKS = ("preparing", "please wait", "redirecting", "loading", "one moment", "securely connecting", "establishing", "processing your request")
EMAIL_MARKS = ("enter the email", "email address this", "confirm your email", "email that received", "verify your email to")
DONE_MARKS = ("thank you", "successfully", "you will be redirected", "sign-in successful", "verification complete")
# Weights of a comparison's signals by role.
WEIGHTS = {
    "bot_check": {"script_set": 0.35, "skeleton": 0.2, "tlsh_rendered": 0.2, "request_shape": 0.15, "screenshot": 0.1},
    "cred_capture": {"injected": 0.4, "request_shape": 0.25, "script_set": 0.2, "skeleton": 0.1, "screenshot": 0.05},
    "interstitial": {"skeleton": 0.3, "tlsh_rendered": 0.3, "script_set": 0.2, "screenshot": 0.2},
    "email_gate": {"skeleton": 0.3, "tlsh_rendered": 0.25, "script_set": 0.25, "screenshot": 0.2},
}
DEFAULT_WEIGHTS = {"tlsh_rendered": 0.3, "skeleton": 0.25, "script_set": 0.25, "request_shape": 0.1, "screenshot": 0.1}
OTHER_WEIGHT = 0.05
SAME, SIMILAR = 0.85, 0.45


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def role_of(seq: Column, total: Column, host: Column, text: Column, is_final: Column, dwell: Column, *, gate: Column, email_gate: Column, login: Column, form: Column) -> Column:
    """A stage's role by the first rule that speaks."""
    low, decoy = F.lower(F.coalesce(text, F.lit(""))), _any(F.lower(F.coalesce(host, F.lit(""))), DECOY_HOSTS)
    return (
        F.when(gate, "bot_check").when(email_gate, "email_gate").when(login & ~decoy, "cred_capture").when(decoy, "decoy")
        .when(_any(low, BOT_MARKS), "bot_check").when(_any(low, EMAIL_MARKS), "email_gate").when(_any(low, DONE_MARKS) & (is_final | (seq > 0)), "post_submit").when(_any(low, WAIT_MARKS), "interstitial")
        .when((seq == 0) & (total > 1), "lure").when(~is_final & (dwell < 1.5) & (F.length(F.trim(low)) < 40), "redirector").when(is_final & form, "cred_capture").otherwise("unknown")
    )


def set_signal(a: Column, b: Column) -> Column:
    """Jaccard to three places; null (unknown) if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(None).cast("double")).otherwise(F.round(F.size(F.array_intersect(a, b)) / either, 3))


def tlsh_signal(distance: Column) -> Column:
    """1 up to a distance of 30, 0 from 120, linear between."""
    return F.when(distance.isNull(), F.lit(None).cast("double")).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (distance - 30) / 90.0)), 3))


def phash_signal(bits: Column) -> Column:
    return F.when(bits.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), F.round(1.0 - bits / 32.0, 3)))


def compare(role: str | None, signals: dict[str, Column]) -> tuple[Column, Column]:
    """(score, verdict): known signals by their weights for the role."""
    weights = WEIGHTS.get(role or "", DEFAULT_WEIGHTS)
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, value in signals.items():
        w = weights.get(name, OTHER_WEIGHT)
        top, bottom = top + F.coalesce(value * w, F.lit(0.0)), bottom + F.when(value.isNull(), 0.0).otherwise(w)
    score = F.when(bottom == 0, 0.0).otherwise(F.round(top / bottom, 3))
    return score, F.when(score >= SAME, "same").when(score >= SIMILAR, "similar").otherwise("different")


def align(a: list[dict], b: list[dict], alike) -> list[tuple[int | None, int | None, float]]:
    """Global alignment: 1 + score for stages of one role, -1 otherwise and for gaps; matches before gaps in b."""
    n, m = len(a), len(b)
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    pair = [[alike(x, y) if x["role"] == y["role"] else None for y in b] for x in a]
    worth = lambda i, j: -1.0 if pair[i][j] is None else 1.0 + pair[i][j]
    for i in range(n + 1):
        for j in range(m + 1):
            if i or j:
                score[i][j] = max(
                    score[i - 1][j - 1] + worth(i - 1, j - 1) if i and j else float("-inf"),
                    score[i - 1][j] - 1.0 if i else float("-inf"),
                    score[i][j - 1] - 1.0 if j else float("-inf"),
                )
    out, i, j = [], n, m
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + worth(i - 1, j - 1):
            i, j = i - 1, j - 1
            out.append((i, j, pair[i][j] or 0.0))
        elif i and score[i][j] == score[i - 1][j] - 1.0:
            i -= 1
            out.append((i, None, 0.0))
        else:
            j -= 1
            out.append((None, j, 0.0))
    return out[::-1]


def align_flows(flows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``flows`` (kit_id, seq, role, tokens) aligned for each of ``pairs`` (a, b)."""
    flow = flows.groupBy("kit_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "tokens"))).alias("flow"))
    both = pairs.join(flow.select(F.col("kit_id").alias("a"), F.col("flow").alias("flow_a")), "a").join(flow.select(F.col("kit_id").alias("b"), F.col("flow").alias("flow_b")), "b")

    def alike(x: dict, y: dict) -> float:
        p, q = set(x["tokens"] if x["tokens"] is not None else ()), set(y["tokens"] if y["tokens"] is not None else ())
        return round(len(p & q) / len(p | q), 3) if p | q else 1.0

    def task(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                fa, fb = list(r.flow_a), list(r.flow_b)
                for step, (i, j, s) in enumerate(align(fa, fb, alike)):
                    x, y = (fa[i] if i is not None else None), (fb[j] if j is not None else None)
                    rows.append((r.a, r.b, step, None if x is None else int(x["seq"]), None if y is None else int(y["seq"]), (x or y)["role"], s))
            yield pd.DataFrame(rows, columns=["a", "b", "step", "seq_a", "seq_b", "role", "score"]).astype({"seq_a": "Int64", "seq_b": "Int64"})

    return both.select("a", "b", "flow_a", "flow_b").mapInPandas(task, "a long, b long, step int, seq_a long, seq_b long, role string, score double")
