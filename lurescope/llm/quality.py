"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its words, whose hashes
have learned embeddings, and from the shape of its text; gated attention, learned from
the documents' labels alone, weighs the passages, and the weighted representation is
scored. So one bad stretch of a long text can speak for the whole, or be outweighed.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import in_fold, shipped, small_batches
from lurescope.llm.toxicity import label_marks, labelled

#: Words of a passage.
PASSAGE = 64
#: Width of a passage's code and of the attention.
HIDDEN, ATTENTION = 16, 12
#: Cells that words are hashed to, and the width of a cell's embedding.
CELLS, EMBEDDING = 2048, 8
#: Labelled rows of each label that are learned from.
PER_LABEL = 500
ROUNDS = 150
#: Scale of the words' mean embedding beside the standardised shapes.
WORDS = 4.0

_CLASSES = 12


def _class_table() -> bytes:
    table = np.full(256, 11, dtype=np.uint8)  # control characters
    for chars, k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" ", 3), (b".!?", 4), (b",;:", 5), (b"'\"()-", 6), (b"|", 7), (b"#$%&*~^=+_<>{}[]\\/@`", 8)):
        table[list(chars)] = k
    table[128:192], table[192:] = 9, 10
    return table.tobytes()


_TABLE = _class_table()
N_FEATURES = _CLASSES + 11


def passages(text: str | None) -> np.ndarray:
    """Features of each passage of a whole text, a row each; one row for a text without words."""
    words = text.split() if text else []
    if not words:
        empty = np.zeros((1, N_FEATURES))
        empty[0, -1] = 1.0
        return empty
    out = np.zeros((-(-len(words) // PASSAGE), N_FEATURES))
    seen: set[str] = set()
    for r, i in enumerate(range(0, len(words), PASSAGE)):
        part = words[i : i + PASSAGE]
        n, own = len(part), set(part)
        body = " ".join(part).encode("utf-8", "replace")
        out[r, :_CLASSES] = np.bincount(np.frombuffer(body.translate(_TABLE), dtype=np.uint8), minlength=_CLASSES) / len(body)
        ends = [w[-1] for w in part]
        out[r, _CLASSES:] = (
            len(body) / n / 10.0, len(own) / n, len(own & seen) / len(own), sum(a == b for a, b in zip(part, part[1:], strict=False)) / n,
            sum(map(str.isupper, part)) / n, sum(map(str.istitle, part)) / n, sum(e in ".!?" for e in ends) / n, sum(not e.isalnum() for e in ends) / n,
            sum(map(str.isalpha, part)) / n, min(n, PASSAGE) / PASSAGE, 0.0,
        )
        seen |= own
    return out


def word_cells(text: str | None) -> list[Counter]:
    """Of each passage of a whole text, its words' cells with their numbers."""
    words = text.split() if text else []
    cells = {w: zlib.crc32(w.lower().encode("utf-8", "replace")) % CELLS for w in set(words)}
    return [Counter(cells[w] for w in words[i : i + PASSAGE]) for i in range(0, len(words), PASSAGE)] or [Counter()]


class Bags:
    """Passages of several documents one after another: shapes, cells with their shares, and where each begins."""

    def __init__(self, texts: list[str | None]) -> None:
        shapes, cells = [passages(t) for t in texts], [word_cells(t) for t in texts]
        self.x = np.concatenate(shapes)
        self.starts = np.cumsum([0, *map(len, shapes)])[:-1]
        # A passage without words has one cell of share 0.
        rows = [c or Counter({0: 0}) for own in cells for c in own]
        self.at = np.fromiter((k for c in rows for k in c), dtype=np.int64)
        self.share = np.concatenate([np.fromiter(c.values(), dtype=float) / max(1, c.total()) for c in rows])
        self.first = np.cumsum([0, *map(len, rows)])[:-1]


class QualityModel:
    """Encoder, gated attention and scorer."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        init = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.std = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = {"e": r.normal(0, 0.1, (CELLS, EMBEDDING)), "w1": init(N_FEATURES + EMBEDDING, HIDDEN), "b1": np.zeros(HIDDEN), "v": init(HIDDEN, ATTENTION), "u": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "c": init(HIDDEN), "d": np.zeros(1)}
        self.shift = 0.0

    def forward(self, bags: Bags) -> dict[str, np.ndarray]:
        p, x, starts = self.p, bags.x, bags.starts
        seg = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        mean = np.add.reduceat(bags.share[:, None] * p["e"][bags.at], bags.first)
        x = np.hstack([np.clip((x - self.mean) / self.std, -6, 6), mean * WORDS])
        z = np.tanh(x @ p["w1"] + p["b1"])
        t, g = np.tanh(z @ p["v"]), 1 / (1 + np.exp(-z @ p["u"]))
        raw = (t * g) @ p["w"]
        e = np.exp(raw - np.maximum.reduceat(raw, starts)[seg])
        a = e / np.add.reduceat(e, starts)[seg]
        rep = np.add.reduceat(a[:, None] * z, starts)
        prob = 1 / (1 + np.exp(-np.clip(rep @ p["c"] + p["d"] + self.shift, -30, 30)))
        return {"x": x, "z": z, "t": t, "g": g, "a": a, "rep": rep, "prob": prob, "seg": seg}

    def gradients(self, f: dict[str, np.ndarray], bags: Bags, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, z, t, g, a, seg, starts = self.p, f["z"], f["t"], f["g"], f["a"], f["seg"], bags.starts
        d_logit = (f["prob"] - y) * weight
        d_rep = d_logit[:, None] * p["c"]
        d_a = (z * d_rep[seg]).sum(axis=1)
        d_raw = a * (d_a - np.add.reduceat(a * d_a, starts)[seg])
        d_tg = d_raw[:, None] * p["w"]
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_z = (a[:, None] * d_rep[seg] + d_t @ p["v"].T + d_g @ p["u"].T) * (1 - z * z)
        d_mean = (d_z @ p["w1"][N_FEATURES:].T) * WORDS
        of_passage = np.repeat(np.arange(len(d_mean)), np.diff(np.append(bags.first, len(bags.at))))
        d_e = np.column_stack([np.bincount(bags.at, weights=bags.share * d_mean[of_passage, k], minlength=CELLS) for k in range(EMBEDDING)])
        return {"e": d_e, "w1": f["x"].T @ d_z, "b1": d_z.sum(axis=0), "v": z.T @ d_t, "u": z.T @ d_g, "w": (t * g).T @ d_raw, "c": f["rep"].T @ d_logit, "d": np.array([d_logit.sum()])}

    def fit(self, bags: Bags, y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.03, decay: float = 1e-3) -> None:
        """Full-batch Adam on the log-loss, both labels weighing the same."""
        self.mean, self.std = bags.x.mean(axis=0), bags.x.std(axis=0) + 1e-3
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, rounds + 1):
            grads = self.gradients(self.forward(bags), bags, y, weight)
            for k, g in grads.items():
                g = g + decay * self.p[k] * (k != "d") / len(self.p)
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.999**i)) + 1e-8)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for i in range(0, len(texts), 256):
            out.append(self.forward(Bags(texts[i : i + 256]))["prob"])
        return np.concatenate(out) if out else np.zeros(0)


def fit_quality(rows: DataFrame, counts: dict[int, int]) -> QualityModel:
    """Learn from ``rows`` (id, text, label; see labelled), whole texts.

    Scores are set to the labels' shares by ``counts``; with one label only, that label's.
    """
    model = QualityModel()
    texts, y = [], []
    for text, label in rows.orderBy(F.xxhash64(F.lit(3), F.col("id"))).select("text", "label").toLocalIterator():
        texts.append(text)
        y.append(int(label))
    if len(set(y)) == 2:
        model.fit(Bags(texts), np.array(y))
        model.shift = float(np.log(max(1, counts.get(1, 0)) / max(1, counts.get(0, 0))))
    else:
        model.p["c"][:] = 0.0
        model.shift = {frozenset(): 0.0, frozenset({1}): 3.0, frozenset({0}): -3.0}[frozenset(y)]
    return model


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; null, empty and blank texts are one empty passage."""
    small_batches(docs.sparkSession)
    held = shipped(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(held().scores(text.tolist()))

    return docs.drop(score_col).withColumn(score_col, score(F.col(text_col).cast("string")))


def quality(docs: DataFrame, labels: DataFrame, bar: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``.

    Null, empty and blank texts are one passage without words; rows that repeat are each
    returned with equal scores; an empty table gives an empty result. Without labels of
    both kinds all scores are equal. Other columns are ignored.
    """
    marks = label_marks(labels, "quality")
    counts = {int(r[0]): r[1] for r in marks.groupBy("label").count().collect()}
    model = fit_quality(labelled(docs, marks, PER_LABEL), counts)
    out = score_quality(docs.select("doc_id", "text", in_fold("doc_id", 4, 2).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= bar).cast("int").alias("predicted"))
