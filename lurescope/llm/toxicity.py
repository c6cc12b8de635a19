"""Toxicity by a lexicon whose misspellings are caught, and by the words around a hit.

The lexicon is learned from labelled documents, as words and as stems that many words
share, with a short list of fixed terms. Its trie is intersected with Levenshtein
automata: one automaton runs over all terms at once, its states are sets of (trie
node, errors), and states are made when a text first needs them. A hit counts by its
term's weight, its errors and the context window around it: quotation marks and words
of reporting speak against abuse, words of address for it. A logistic model over these
sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import in_fold, sample_by_class, shipped, small_batches

#: Common English terms of abuse, in the lexicon whatever the labels say.
SEEDS = ("bastard", "clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
#: Words of reporting and of address.
REPORTING = frozenset("said says wrote writes called calls quoted quote quotes reported claims claimed word words term terms phrase comment commented".split())
ADDRESS = frozenset("you your youre u ur yourself du dich dein ihr euch tu te toi vous votre ton tes tú usted ustedes vosotros eres".split())
QUOTES = frozenset("\"'“”„«»‘’‚‹›`")
#: '@' and '$' stand for letters inside words and before them.
WORD = re.compile(r"[@$]*[^\W_]+(?:[@$]+[^\W_]+)*[@$]*|[\"“”„«»‚‹›`]")
MARKS = re.compile(r"[@$]+")
#: Characters that stand for letters; fixed values.
LEET = str.maketrans("013457@$", "oieastas")
#: Words on either side of a hit that are its context.
CONTEXT = 8
#: Labelled rows of each label that are learned from.
PER_LABEL = 3000
#: The least number of documents that speak for a term.
LEAST_DOCS = 3
#: Least log-likelihood ratio of a term: about one in fifty thousand by chance.
CLEAR = 18.0
STEM_FROM, STEM_TO = 4, 9
CACHE_WORDS = 100_000
#: States of the automata that are kept; they are made anew beyond that.
MOST_STATES = 20_000
#: Share of two texts' words that makes them near copies.
NEAR = 0.75
FEATURES = 9


class Automaton:
    """Levenshtein automata of all terms over their trie, made deterministic as texts need it."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        # Nodes: children by letter, term that ends here, whether it is a stem.
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.terms = terms
        for k, (word, _) in enumerate(terms):
            node = 0
            for c in word:
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.ends.append([])
                node = self.kids[node][c]
            self.ends[node].append(k)
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.next: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.finals: list[list[tuple[int, int]]] = []
        self.stems: list[list[tuple[int, int]]] = []
        self.start = self._state({(0, 0, "")})

    @staticmethod
    def allowed(word: str) -> int:
        """Errors that a term bears: none in short ones, two in long ones."""
        return 0 if len(word) < 5 else 1 if len(word) < 9 else 2

    def _limit(self) -> int:
        return max((self.allowed(w) for w, _ in self.terms), default=0)

    def _state(self, items: set[tuple[int, int, str]]) -> int:
        """Close under letters of a term that the text leaves out; the third part is a letter awaited for a swap."""
        limit = self._limit()
        best: dict[tuple[int, str], int] = {}
        todo = list(items)
        while todo:
            node, errors, swap = todo.pop()
            if best.get((node, swap), limit + 1) <= errors:
                continue
            best[node, swap] = errors
            if not swap and errors < limit:
                todo += [(kid, errors + 1, "") for kid in self.kids[node].values()]
        key = frozenset((n, e, s) for (n, s), e in best.items())
        if key not in self.states:
            self.states[key] = len(self.next)
            self.next.append({})
            self.sets.append(key)
            ends = [(k, e) for n, e, s in key if not s for k in self.ends[n]]
            self.finals.append([(k, e) for k, e in ends if e <= self.allowed(self.terms[k][0])])
            self.stems.append([(k, e) for k, e in self.finals[-1] if self.terms[k][1]])
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        limit, out = self._limit(), set()
        for node, errors, swap in self.sets[state]:
            if swap:
                # The swapped pair's second letter: the first one of the term.
                for first, kid in self.kids[node].items():
                    if first == c and swap in self.kids[kid]:
                        out.add((self.kids[kid][swap], errors, ""))
                continue
            if (kid := self.kids[node].get(c)) is not None:
                out.add((kid, errors, ""))
            if errors < limit:
                out.add((node, errors + 1, ""))
                out |= {(kid, errors + 1, "") for kid in self.kids[node].values()}
                if any(c in self.kids[kid] for kid in self.kids[node].values()):
                    out.add((node, errors + 1, c))
        self.next[state][c] = got = self._state(out) if out else -1
        return got

    def match(self, word: str) -> tuple[int, int] | None:
        """The term that ``word`` is or begins with, and the errors: fewest errors, then the longest term."""
        if len(self.next) > MOST_STATES:
            self._forget()
        state, found = self.start, []
        for c in word:
            state = self.next[state].get(c) if c in self.next[state] else self._step(state, c)
            if state < 0:
                break
            found += self.stems[state]
        else:
            found = found + self.finals[state]
        return min(found, key=lambda x: (x[1], -len(self.terms[x[0]][0]), x[0])) if found else None


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def parts(token: str) -> list[str]:
    """What '@' and '$' divide, as in addresses and prices."""
    return [p for p in MARKS.split(token) if p] if "@" in token or "$" in token else [token]


def distinct_rows(rows: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """Rows without near copies of kept ones, which would make chance words look like terms.

    A near copy shares at least NEAR of the two sets' words. Sets that do share one of
    their rarest words, which alone are looked up; each pair met is then compared in full.
    """
    sets = [set(toks) for toks, _ in rows]
    often = Counter(t for own in sets for t in own)
    holders: dict[str, list[int]] = {}
    out, blank = [], False
    for i, own in enumerate(sets):
        if not own:
            if not blank:
                out.append(rows[i])
            blank = True
            continue
        rare = sorted(own, key=lambda t: (often[t], t))[: len(own) - math.ceil(NEAR * len(own)) + 1]
        met = {j for t in rare for j in holders.get(t, ()) if NEAR * len(own) <= len(sets[j]) <= len(own) / NEAR}
        if any(both >= NEAR * (len(own) + len(sets[j]) - both) for j in met for both in (len(own & sets[j]),)):
            continue
        out.append(rows[i])
        for t in rare:
            holders.setdefault(t, []).append(i)
    return out


def speaks(a: int, n1: int, b: int, n0: int) -> float:
    """Log-likelihood ratio (G squared) of ``a`` of ``n1`` against ``b`` of ``n0``, 0 unless the first share is larger."""
    if a * n0 <= b * n1:
        return 0.0
    total, g = (a + b) / (n1 + n0), 0.0
    for k, n in ((a, n1), (b, n0)):
        for part, want in ((k, n * total), (n - k, n * (1 - total))):
            if part:
                g += 2.0 * part * math.log(part / want)
    return g


def learn_lexicon(rows: list[tuple[list[str], int]]) -> list[tuple[str, bool, float]]:
    """(term, is a stem, weight) of words and stems that documents of label 1 have and others lack."""
    rows = distinct_rows(rows)
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    if not n1 or not n0:
        return [(w, False, 2.0) for w in SEEDS]
    words: tuple[Counter, Counter] = (Counter(), Counter())
    stems: tuple[Counter, Counter] = (Counter(), Counter())
    for toks, y in rows:
        own = {p for t in toks for p in parts(t) if p[0].isalpha()}
        words[y].update(own)
        stems[y].update({t[:k] for t in own for k in range(STEM_FROM, min(len(t), STEM_TO) + 1)})

    def odds(a: int, b: int) -> float:
        return math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))

    found = {}
    for kind in (stems, words):
        for t, a in kind[1].items():
            b = kind[0][t]
            if a >= LEAST_DOCS and odds(a, b) >= 1.5 and (g := speaks(a, n1, b, n0)) >= CLEAR:
                found[t] = max(found.get(t, (0.0, 0, 0)), (g, a, b))
    kept: dict[str, tuple[bool, float]] = {}
    # The clearest first; of terms as clear as each other the longest, so that a stem is as long as its words allow.
    for t in sorted(found, key=lambda t: (-round(found[t][0], 6), -len(t), t)):
        if any(t.startswith(k) or k.startswith(t) for k in kept):
            continue
        _, a, b = found[t]
        kept[t] = (words[1][t] < 0.7 * a, odds(a, b))
    for w in SEEDS:
        if w not in kept:
            kept[w] = (False, odds(words[1][w], words[0][w]) if words[1][w] + words[0][w] >= 5 else 2.0)
    return sorted((t, stem, w) for t, (stem, w) in kept.items() if w > 0)


class ToxicityModel:
    """A lexicon and the weights of a logistic model over the sums of hits."""

    def __init__(self, lexicon: list[tuple[str, bool, float]], rows: list[tuple[list[str], int]] = ()) -> None:
        self.lexicon, self.held = lexicon, None
        # Words that only look misspelled: documents of label 0 hold them as often.
        words = (Counter(), Counter())
        for toks, y in rows:
            words[y].update({p for t in toks for p in (t, *parts(t))})
        n1 = max(1, sum(y for _, y in rows))
        n0 = max(1, len(rows) - n1)
        own, automaton = {w for w, _, _ in lexicon}, Automaton([(w, stem) for w, stem, _ in lexicon])
        self.benign = {w for w, b in words[0].items() if w not in own and words[1][w] * n0 <= 2 * b * n1 and (got := automaton.match(w)) and got[1]}
        self.weights, self.bias = np.zeros(FEATURES), -2.0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": None}

    def features(self, text: str | None) -> np.ndarray:
        if self.held is None:
            self.held = Automaton([(w, s) for w, s, _ in self.lexicon]), {}
        automaton, known = self.held
        toks = tokens(text)
        if len(known) > CACHE_WORDS:
            known.clear()
        for t in set(toks).difference(known):
            # The word as it stands, what marks divide, and the letters that its signs stand for.
            got = [m for p in dict.fromkeys((t, *parts(t))) if p not in self.benign and (m := automaton.match(p))]
            if not got and not t.isalpha() and (m := automaton.match(t.translate(LEET))):
                got = [(m[0], m[1] + 1)]
            known[t] = min(got, key=lambda x: x[1], default=None)
        hits = [(i, *known[t]) for i, t in enumerate(toks) if known[t]]
        out = np.zeros(FEATURES)
        if not hits:
            return out
        inside = np.cumsum([t in QUOTES for t in toks]) if any(t in QUOTES for t in toks) else None
        for i, k, errors in hits:
            weight = self.lexicon[k][2] * 0.7**errors
            near = [t.strip("@$") for t in toks[max(0, i - CONTEXT) : i] + toks[i + 1 : i + 1 + CONTEXT]]
            quoted = inside is not None and inside[i] % 2 == 1 and inside[min(len(toks) - 1, i + 4 * CONTEXT)] > inside[i]
            reported = any(t in REPORTING for t in near)
            live = 0.0 if quoted and reported else 0.35 if quoted else 0.7 if reported else 1.0
            out[0] += weight * live
            out[1] = max(out[1], weight * live)
            out[2] += errors == 0 and live == 1.0
            out[3] += errors > 0
            out[4] += quoted or reported
            out[5] += any(t in ADDRESS for t in near)
        out[6] = len({k for _, k, _ in hits})
        out[7] = out[0] / math.sqrt(len(toks) + 20.0)
        out[8] = 1.0
        return np.concatenate([np.log1p(out[:7]), out[7:]])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), FEATURES)
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(a.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(rows: DataFrame) -> ToxicityModel:
    """Learn from ``rows`` (id, text, label; see labelled), whole texts.

    The lexicon comes from two thirds of them and the weights from the rest, so that
    chance terms don't count for more than they are worth.
    """
    got = [(tokens(t), t, int(y)) for t, y in rows.orderBy(F.xxhash64(F.lit(3), F.col("id"))).select("text", "label").toLocalIterator()]
    part = [i % 3 != 0 for i in range(len(got))]
    learned = lambda rows: ToxicityModel(learn_lexicon(rows), rows)
    trial = learned([(t, y) for (t, _, y), p in zip(got, part, strict=True) if p])
    model = learned([(t, y) for t, _, y in got])
    rest = [(t, y) for (_, t, y), p in zip(got, part, strict=True) if not p]
    y = np.array([y for _, y in rest])
    if len(set(y.tolist())) == 2:
        x = np.array([trial.features(t) for t, _ in rest])
        model.weights, model.bias = logistic(x, y)
    elif not len(y):
        model.weights[1] = 1.0
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; texts without a hit, null and empty ones get the score of no hits."""
    small_batches(docs.sparkSession)
    held = shipped(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(held().scores(text.tolist()))

    return docs.drop(score_col).withColumn(score_col, score(F.col(text_col).cast("string")))


def label_marks(labels: DataFrame, label_col: str) -> DataFrame:
    """doc_id, label of what may be learned from (fold 2 of 4 is held out)."""
    return labels.filter(F.col(label_col).isNotNull() & ~in_fold("doc_id", 4, 2)).select("doc_id", F.col(label_col).cast("int").alias("label"))


def labelled(docs: DataFrame, marks: DataFrame, per_label: int) -> DataFrame:
    """id, text, label of about ``per_label`` documents of each label, chosen by a hash of the id.

    The choice is made among ids, so that only few are sent to where the texts are read.
    """
    chosen = sample_by_class(marks, "label", "doc_id", per_label)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").alias("id"), "text", "label")


def toxicity(docs: DataFrame, labels: DataFrame, bar: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``.

    Null, empty and blank texts have no hit and get the score of none; rows that repeat
    are each returned with equal scores; an empty table gives an empty result. Without
    labels the fixed terms alone speak. Other columns are ignored.
    """
    model = fit_toxicity(labelled(docs, label_marks(labels, "toxic"), PER_LABEL))
    out = score_toxicity(docs.select("doc_id", "text", in_fold("doc_id", 4, 2).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= bar).cast("int").alias("predicted"))
