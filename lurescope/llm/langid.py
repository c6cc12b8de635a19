"""Language ID by unigram piece models that sum over all segmentations.

Pieces come from a public tokenizer's vocabulary, which is given by path and never
trained. For each language EM learns the pieces' probabilities from labelled words;
a word's likelihood is the sum over all its segmentations into pieces, by the forward
algorithm, and a text's is the product over its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import in_fold, sample_by_class, shipped, small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The vocabulary's mark of a word's start.
MARK = "▁"
#: Runs of letters, and of such as superscripts and number forms, which are alphanumeric but neither digits nor letters.
LETTERS = re.compile(r"[^\W\d_]+")
#: Words of so many letters are summed in plain floating point, unless that is too small, and are kept by a worker.
SHORT = 64
#: Longer runs of letters are learned from in parts of so many, whose likelihood plain floats hold; they are scored whole.
LEARNED = 32
#: Words whose likelihoods a worker keeps in each of two generations, and the least likelihood that plain floats hold well.
CACHE_WORDS, TINY = 40_000, 1e-250
#: Words of one length that are summed at once.
TOGETHER = 2048
#: Probability of a letter that no piece has, and what an unseen piece counts.
FLOOR, UNSEEN = 1e-7, 0.02


def load_pieces(path: str) -> list[str]:
    """Pieces of a SentencePiece model that are letters, with or without the mark, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p == p.lower() and p.replace(MARK, "", 1).isalpha()} | {MARK})


def build_trie(pieces: list[str]) -> dict:
    """Nested dicts by character; "" holds a piece's number."""
    root: dict = {}
    for i, p in enumerate(pieces):
        node = root
        for c in p:
            node = node.setdefault(c, {})
        node[""] = i
    return root


def lattice(trie: dict, word: str) -> list[tuple[int, int, int]]:
    """(start, end, piece) of all pieces inside a word; -1 for a character that is no piece."""
    out = []
    for i in range(len(word)):
        node, single = trie, False
        for j in range(i, len(word)):
            node = node.get(word[j])
            if node is None:
                break
            if (p := node.get("", -1)) >= 0:
                out.append((i, j + 1, p))
                single |= j == i
        if not single:
            out.append((i, i + 1, -1))
    return out


def learn(words: Counter, pieces: list[str], trie: dict, rounds: int = 4) -> np.ndarray:
    """Piece probabilities of one language by EM over the words' lattices."""
    runs: Counter = Counter()
    for w, c in words.items():
        for i in range(0, len(w), LEARNED):
            runs[w[i : i + LEARNED]] += c
    arcs = [(lattice(trie, MARK + w), len(w) + 1, c) for w, c in runs.items()]
    counts = np.zeros(len(pieces))
    for lat, _, c in arcs:
        for i, j, p in lat:
            if p >= 0:
                counts[p] += c * (j - i)
    for _ in range(rounds):
        prob = ((counts + UNSEEN) / (counts.sum() + UNSEEN * len(pieces))).tolist()
        fresh = [0.0] * len(pieces)
        for lat, n, c in arcs:
            forward = [1.0] + [0.0] * n
            for i, j, p in lat:
                forward[j] += forward[i] * (prob[p] if p >= 0 else FLOOR)
            backward = [0.0] * n + [1.0]
            for i, j, p in reversed(lat):
                b = backward[j] * (prob[p] if p >= 0 else FLOOR)
                backward[i] += b
                if p >= 0:
                    fresh[p] += c * forward[i] * b / forward[n]
        counts = np.array(fresh)
    return (counts + UNSEEN) / (counts.sum() + UNSEEN * len(pieces))


def words_of(text: str | None) -> Counter:
    """A text's runs of letters in lower case, with their numbers."""
    found = Counter(LETTERS.findall(text.lower()) if text else ())
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def word_likelihoods(word: str, trie: dict, probs: list[tuple[float, ...]], none: tuple[float, ...]) -> list[float]:
    """Log-likelihood of a word in each language, over all segmentations."""
    if len(word) > SHORT:
        return long_likelihoods(word, trie, probs)
    marked, word = word, MARK + word
    n = len(word)
    forward: list = [None] * (n + 1)
    forward[0] = none
    for i in range(n):
        at, node = forward[i], trie
        for j in range(i, n):
            node = node.get(word[j])
            if node is None:
                if j == i:
                    _reach(forward, i + 1, at, probs[-1])
                break
            p = node.get("")
            if p is not None:
                _reach(forward, j + 1, at, probs[p])
            elif j == i:
                _reach(forward, i + 1, at, probs[-1])
    return [math.log(x) for x in forward[n]] if min(forward[n], default=1.0) > TINY else long_likelihoods(marked, trie, probs)


def long_likelihoods(word: str, trie: dict, probs: list[tuple[float, ...]]) -> list[float]:
    """The same for a word of any length: columns that no piece can reach any more are dropped, and small sums are scaled up."""
    word, width = MARK + word, len(probs[-1])
    ahead: deque[list[float] | None] = deque([[1.0] * width])
    scale = [0.0] * width
    for i in range(len(word)):
        at, node = ahead.popleft(), trie
        for k, x in enumerate(at):
            if x < 1e-100:
                at[k] *= 1e100
                scale[k] -= 100 * math.log(10.0)
                for column in ahead:
                    if column is not None:
                        column[k] *= 1e100
        for j in range(i, len(word)):
            node = node.get(word[j])
            p = None if node is None else node.get("")
            q = probs[p] if p is not None else probs[-1] if j == i else None
            if q is not None:
                while len(ahead) <= j - i:
                    ahead.append(None)
                got = ahead[j - i]
                ahead[j - i] = [x * y for x, y in zip(at, q, strict=True)] if got is None else [z + x * y for z, x, y in zip(got, at, q, strict=True)]
            if node is None:
                break
    return [math.log(x) + s for x, s in zip(ahead[0], scale, strict=True)]


class Automaton:
    """The trie of pieces as a table of nodes by letters, for the likelihoods of many words at once."""

    def __init__(self, pieces: list[str]) -> None:
        # Letters with which pieces begin, and letters further on, which are fewer; 0 stands for any other.
        self.first, self.later = np.zeros(0x110000, dtype=np.int32), np.zeros(0x110000, dtype=np.int32)
        later = sorted({c for p in pieces for c in p[1:]})
        self.later[[ord(c) for c in later]] = np.arange(1, len(later) + 1)
        edges: dict[tuple[int, str], int] = {}
        ends = {}
        for i, p in enumerate(pieces):
            node = 1
            for c in p:
                node = edges.setdefault((node, c), len(edges) + 2)
            ends[node] = i
        # Node 0 is outside the trie, node 1 its root. Only nodes that go on have a row.
        self.row = np.zeros(len(edges) + 2, dtype=np.int32)
        inner = sorted({n for n, _ in edges if n > 1})
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.next = np.zeros((len(inner) + 1, len(later) + 1), dtype=np.int32)
        for (node, c), to in edges.items():
            if node == 1:
                self.first[ord(c)] = to
            else:
                self.next[self.row[node], self.later[ord(c)]] = to
        self.piece = np.full(len(edges) + 2, -1, dtype=np.int32)
        self.piece[list(ends)] = list(ends.values())

    def sums(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """The likelihoods of words of one length with their mark, a row each, as in ``word_likelihoods`` and added in its order; ``probs`` ends with the floor."""
        n, count = len(words[0]) + 1, len(words)
        points = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(count, n).T
        starts, codes = self.first[points], self.later[points]
        forward = np.zeros((n + 1, count, probs.shape[1]))
        forward[0] = 1.0
        for i in range(n):
            # A letter that is no piece counts as the floor, which is the last row.
            node = starts[i]
            forward[i + 1] += forward[i] * probs[self.piece[node]]
            alive = np.flatnonzero(self.row[node])
            node = node[alive]
            for j in range(i + 1, n):
                if not len(alive):
                    break
                node = self.next[self.row[node], codes[j, alive]]
                got = self.piece[node]
                ends = np.flatnonzero(got >= 0)
                if len(ends):
                    forward[j + 1, alive[ends]] += forward[i, alive[ends]] * probs[got[ends]]
                on = np.flatnonzero(self.row[node])
                alive, node = alive[on], node[on]
        return forward[n]


# The common width is written out; it is the inner loop.
def _reach(forward: list, j: int, at: list[float], q: tuple[float, ...]) -> None:
    got = forward[j]
    if len(q) == 4:
        a, b, c, d = at
        e, f, g, h = q
        if got is None:
            forward[j] = [a * e, b * f, c * g, d * h]
        else:
            got[0] += a * e
            got[1] += b * f
            got[2] += c * g
            got[3] += d * h
    elif got is None:
        forward[j] = [x * y for x, y in zip(at, q, strict=True)]
    else:
        forward[j] = [z + x * y for z, x, y in zip(got, at, q, strict=True)]


class LanguageModel:
    """Languages, pieces and the pieces' probabilities (the last row is the floor, for -1)."""

    def __init__(self, langs: list[str], pieces: list[str], probs: np.ndarray) -> None:
        self.langs, self.pieces = langs, pieces
        self.probs = np.vstack([probs, np.full((1, len(langs)), FLOOR)])
        self.trie: dict | None = None

    def _open(self) -> None:
        """The trie, its table, rows of probabilities that equal pieces share, and room for words: made where they are used."""
        self.trie, rows = build_trie(self.pieces), {}
        self.rows = [rows.setdefault(r, r) for r in map(tuple, self.probs.tolist())]
        self.automaton = Automaton(self.pieces)
        self.young, self.old = self._words(), self._words()

    def _words(self) -> tuple[dict[str, int], np.ndarray]:
        return {}, np.zeros((CACHE_WORDS, len(self.langs)))

    def _likelihoods(self, words: list[str]) -> np.ndarray:
        """Rows of log-likelihoods of words of up to SHORT letters, by length."""
        out, by_length = np.zeros((len(words), len(self.langs))), {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for places in by_length.values():
            for at in range(0, len(places), TOGETHER):
                part = places[at : at + TOGETHER]
                got = self.automaton.sums([words[i] for i in part], self.probs)
                low = np.flatnonzero(got.min(axis=1) <= TINY)
                got[low] = 1.0
                out[part] = np.array([*map(math.log, got.ravel().tolist())]).reshape(got.shape)
                for i in low:
                    out[part[i]] = long_likelihoods(words[part[i]], self.trie, self.rows)
        return out

    def of_words(self, words: list[str]) -> np.ndarray:
        """Rows of log-likelihoods of at most CACHE_WORDS different words; the words met last are kept."""
        at, table = self.young
        if len(at) + len(words) > CACHE_WORDS:
            self.young, self.old = self._words(), self.young
            at, table = self.young
        fresh = [w for w in words if w not in at]
        held, old = self.old
        kept = [w for w in fresh if w in held]
        new = [w for w in fresh if w not in held] if held else fresh
        n = len(at)
        table[n : n + len(kept)] = old[[held[w] for w in kept]]
        table[n + len(kept) : n + len(fresh)] = self._likelihoods(new)
        at.update(zip([*kept, *new], range(n, n + len(fresh))))
        return table[[at[w] for w in words]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if self.trie is None:
            self._open()
        langs, scores, waiting, words = [], [], [], set()
        for text in texts:
            counts = words_of(text)
            words.update(counts)
            waiting.append(counts)
            if len(words) > 20_000:
                self._judge(waiting, words, langs, scores)
                waiting, words = [], set()
        self._judge(waiting, words, langs, scores)
        return langs, scores

    def _judge(self, texts: list[Counter], known: set[str], langs: list[str], scores: list[float]) -> None:
        """Adds each text's language and score; words of all texts together are made known first, so that they are many at once."""
        long = {w for w in known if len(w) > SHORT}
        at_once = bool(self.langs) and len(known) <= CACHE_WORDS
        if at_once:
            self.of_words(list(known - long) if long else list(known))
            places, table = self.young
        for counts in texts:
            if not counts or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            words, total = list(counts), np.zeros(len(self.langs))
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                if long:
                    part = [w for w in part if len(w) <= SHORT]
                rows = table[[places[w] for w in part]] if at_once else self.of_words(part)
                total += np.array([counts[w] for w in part], dtype=float) @ rows
            for w in words if long else ():
                if len(w) > SHORT:
                    total += counts[w] * np.array(long_likelihoods(w, self.trie, self.rows))
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(float(1.0 / np.exp(np.minimum(0.0, total - total[best])).sum()))


def fit_languages(rows: DataFrame, text_col: str, lang_col: str, id_col: str, vocabulary: str = VOCABULARY, per_lang: int = 150) -> LanguageModel:
    """Learn from about ``per_lang`` rows of each language, whole texts, chosen by a hash of the id."""
    labelled = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    words: dict[str, Counter] = {}
    for lang, text in sample_by_class(labelled, "lang", "id", per_lang).select("lang", "text").toLocalIterator():
        words.setdefault(lang, Counter()).update(words_of(text))
    pieces = load_pieces(vocabulary)
    trie = build_trie(pieces)
    langs = sorted(k for k, c in words.items() if c)
    probs = np.array([learn(words[k], pieces, trie) for k in langs]).T if langs else np.zeros((len(pieces), 0))
    return LanguageModel(langs, pieces, probs)


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its share of the likelihood (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0. Ties go to the
    language first in order. Repeated rows are each returned; an empty table gives an
    empty result. Columns of ``docs`` stay, but for ones with the new names. Words of
    any length are scored whole.
    """
    small_batches(docs.sparkSession)
    held = shipped(docs.sparkSession, model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def score(text: pa.Array) -> pa.Array:
        langs, scores = held().predict(text.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    out = docs.drop(pred_col, score_col).withColumn("_got", score(F.col(text_col).cast("string")))
    return out.withColumn(pred_col, F.col("_got.lang")).withColumn(score_col, F.col("_got.score")).drop("_got")


def identify(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs``; learns from rows that are not held out.

    Without labelled rows every document is ``und``; an empty table gives an empty result.
    """
    held_out = in_fold("doc_id", 5, 0)
    model = fit_languages(docs.filter(~held_out), "text", "lang", "doc_id", vocabulary)
    slim = docs.select("doc_id", "text", held_out.alias("held_out"))
    return predict_languages(slim, model).select("doc_id", "held_out", "lang_pred", "score")
