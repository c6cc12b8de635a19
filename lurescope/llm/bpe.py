"""Byte-pair encoding and decoding: a segment tree over the ranks of adjacent pairs names the next merge.

A leaf holds the rank of the pair that begins at a token and that token's place, an inner
node the least of its two children, so the root is the leftmost pair of the lowest rank.
A merge changes three leaves and their paths to the root. Merging ends when the root
holds no rank. Words are divided as the vocabulary's file says, and each is merged whole,
whatever its length: those of up to SHORT bytes in forests, whose trees take one merge each
in step, longer ones in a tree of their own.
"""

from __future__ import annotations

import json
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm.common import shipped, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The split of byte-level vocabularies before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of at most KEPT_LENGTH characters are kept encoded, KEPT_WORDS of them at a time in a worker.
KEPT_WORDS, KEPT_LENGTH = 1 << 17, 32
#: Words of so many bytes are merged in forests of at most FOREST trees.
SHORT, FOREST = 64, 1 << 12
#: A node is rank << PLACE_BITS | place; NONE is above all of them.
PLACE_BITS, NONE = 32, 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    own, further = set(prints), iter(range(256, 512))
    return [chr(b) if b in own else chr(next(further)) for b in range(256)]


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return np.array(ids, dtype="<u4").tobytes()


class PairTree:
    """The least rank of all adjacent pairs, leftmost first."""

    def __init__(self, ranks: list[int]):
        """``ranks`` of the pairs by place, -1 for pairs that don't merge."""
        self.size = size = 1 << max(len(ranks) - 1, 0).bit_length()
        self.nodes = nodes = array("q", [NONE]) * (2 * size)
        for at, rank in enumerate(ranks):
            if rank >= 0:
                nodes[size + at] = rank << PLACE_BITS | at
        for at in range(size - 1, 0, -1):
            a, b = nodes[2 * at], nodes[2 * at + 1]
            nodes[at] = a if a < b else b

    def least(self) -> tuple[int, int] | None:
        """(rank, place) of the next merge."""
        root = self.nodes[1]
        return None if root == NONE else (root >> PLACE_BITS, root & ((1 << PLACE_BITS) - 1))

    def put(self, place: int, rank: int) -> None:
        nodes, at = self.nodes, self.size + place
        value = NONE if rank < 0 else rank << PLACE_BITS | place
        if nodes[at] == value:
            return
        nodes[at] = value
        at >>= 1
        while at:
            a, b = nodes[2 * at], nodes[2 * at + 1]
            if b < a:
                a = b
            if nodes[at] == a:
                return
            nodes[at] = a
            at >>= 1


class PairForest:
    """Trees of ``size`` leaves for many words at once."""

    def __init__(self, ranks: np.ndarray):
        """``ranks`` of the pairs by word and place, -1 for pairs that don't merge."""
        count, self.size = ranks.shape
        self.nodes = np.full((count, 2 * self.size), NONE, dtype=np.int64)
        self.nodes[:, self.size :] = self.values(ranks, np.arange(self.size))
        level = self.size // 2
        while level:
            self.nodes[:, level : 2 * level] = np.minimum(self.nodes[:, 2 * level : 4 * level : 2], self.nodes[:, 2 * level + 1 : 4 * level : 2])
            level //= 2

    @staticmethod
    def values(ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.where(ranks < 0, NONE, ranks << PLACE_BITS | places)

    def put(self, trees: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> None:
        """New ranks of leaves; where a tree gets several, all leaves are set before any path."""
        nodes, at = self.nodes, self.size + places
        nodes[trees, at] = self.values(ranks, places)
        for _ in range(self.size.bit_length() - 1):
            at = at >> 1
            nodes[trees, at] = np.minimum(nodes[trees, 2 * at], nodes[trees, 2 * at + 1])


class Vocabulary:
    """Ids of bytes, ranks of pairs, ids of merges and bytes of ids, as a vocabulary file lists them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        ids = held["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [ids[c] for c in letters]
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for pair in held["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((ids[a], ids[b]), len(self.merged))
            self.merged.append(ids[a + b])
        self.base = max(ids.values()) + 1
        keys = np.array([a * self.base + b for a, b in self.ranks], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks_of_keys = np.append(np.fromiter(self.ranks.values(), np.int64, len(keys))[order], -1)
        self.merged_ids, self.byte_array = np.array(self.merged, dtype=np.int64), np.array(self.byte_ids, dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.words = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes_of = {i: bytes(of_letter[c] for c in token) for token, i in ids.items() if token not in self.special}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        tokens = [self.byte_ids[b] for b in word]
        n, rank_of = len(tokens), self.ranks.get
        if n < 2:
            return tokens
        tree = PairTree([rank_of(pair, -1) for pair in zip(tokens, tokens[1:])])
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        while (found := tree.least()) is not None:
            rank, at = found
            gone = after[at]
            further, earlier = after[gone], before[at]
            tokens[at], tokens[gone], after[at] = self.merged[rank], -1, further
            if further < n:
                before[further] = at
                tree.put(gone, -1)
                tree.put(at, rank_of((tokens[at], tokens[further]), -1))
            else:
                tree.put(at, -1)
            if earlier >= 0:
                tree.put(earlier, rank_of((tokens[earlier], tokens[at]), -1))
        return [t for t in tokens if t >= 0]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where a pair doesn't merge or the right id is -1."""
        key = np.where(right < 0, -1, left * self.base + right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks_of_keys[at], -1)

    def merge_forest(self, words: list[bytes], size: int) -> list[bytes]:
        """Packed ids of words of 2 to ``size`` + 1 bytes."""
        length = np.array([len(w) for w in words])
        tokens = np.full((len(words), size + 2), -1, dtype=np.int64)
        tokens[np.arange(size + 2) < length[:, None]] = self.byte_array[np.frombuffer(b"".join(words), np.uint8)]
        forest = PairForest(self.ranks_of(tokens[:, :size], tokens[:, 1 : size + 1]))
        after = np.tile(np.arange(1, size + 3), (len(words), 1))
        before = after - 2
        live = np.arange(len(words))
        while True:
            root = forest.nodes[live, 1]
            live, root = live[root < NONE], root[root < NONE]
            if not len(live):
                break
            at = root & ((1 << PLACE_BITS) - 1)
            gone = after[live, at]
            further, earlier = after[live, gone], before[live, at]
            tokens[live, at], tokens[live, gone], after[live, at] = self.merged_ids[root >> PLACE_BITS], -1, further
            new = tokens[live, at]
            inner, led = further < length[live], earlier >= 0
            before[live[inner], further[inner]] = at[inner]
            forest.put(
                np.concatenate([live, live[inner], live[led]]), np.concatenate([at, gone[inner], earlier[led]]),
                np.concatenate([self.ranks_of(new, tokens[live, further]), np.full(inner.sum(), -1), self.ranks_of(tokens[live[led], earlier[led]], new[led])]),
            )
        held = tokens >= 0
        packed, ends = tokens[held].astype("<u4").tobytes(), 4 * np.cumsum(held.sum(axis=1))
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_all(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of each word."""
        out, sized = {}, {}
        for word in words:
            raw = word.encode()
            if len(raw) == 1 or len(raw) > SHORT:
                out[word] = pack(self.merge(raw))
            else:
                sized.setdefault(1 << (len(raw) - 2).bit_length(), []).append((word, raw))
        for size, group in sized.items():
            for i in range(0, len(group), FOREST):
                part = group[i : i + FOREST]
                out.update(zip([w for w, _ in part], self.merge_forest([raw for _, raw in part], size)))
        return out

    def split(self, text: str) -> list[str]:
        """Words and, where they stand in the text, strings of special tokens."""
        found, at = [], 0
        for mark in self.marks.finditer(text) if self.marks else ():
            found += self.words.findall(text, at, mark.start())
            found.append(mark.group())
            at = mark.end()
        return found + self.words.findall(text, at)

    def encode(self, texts: list[str], kept: dict[str, bytes] | None = None) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; strings of special tokens are those tokens.

        ``kept`` holds encoded words from call to call.
        """
        kept = {} if kept is None else kept
        kept.update((word, pack([i])) for word, i in self.special.items())
        divided = [self.split(t) for t in texts]
        new = self.merge_all([w for w in dict.fromkeys(w for words in divided for w in words) if w not in kept])
        out = [b"".join([new[w] if w in new else kept[w] for w in words]) for words in divided]
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
        kept.update(islice(((w, ids) for w, ids in new.items() if len(w) <= KEPT_LENGTH), KEPT_WORDS))
        return out

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; unknown ids have none, broken characters are replaced."""
        of = self.bytes_of.get
        return b"".join([of(i, b"") for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


class Codec:
    """Encodes and decodes columns of a session's DataFrames with one vocabulary, read on the driver and sent by value."""

    def __init__(self, spark: SparkSession, vocabulary: str = VOCABULARY):
        small_batches(spark)
        self.held = shipped(spark, Vocabulary(vocabulary))

    def encode(self, docs: DataFrame, text_col: str = "text", to: str = "tokens") -> DataFrame:
        """``docs`` with the packed ids (binary, little-endian unsigned 32-bit) of each whole text in ``to``.

        Null texts count as empty, which have no ids. Repeated rows are each encoded; an
        empty table gives an empty result. Further columns stay, but for one named ``to``.
        Very long texts and words are encoded whole: a word of n bytes takes n log n steps.
        """
        held = self.held

        @F.arrow_udf("binary")
        def packed(text: pa.Array) -> pa.Array:
            vocabulary = held()
            kept = vocabulary.__dict__.setdefault("kept", {})
            return pa.array(vocabulary.encode([t or "" for t in text.to_pylist()], kept), pa.binary())

        # So marked, the function isn't called again for each use of its column.
        return docs.withColumn(to, packed.asNondeterministic()(F.col(text_col).cast("string")))

    def decode(self, docs: DataFrame, tokens_col: str = "tokens", to: str = "text") -> DataFrame:
        """``docs`` with the text of the packed ids of ``tokens_col`` in ``to``; null ids count as none, ids that the vocabulary lacks have no text."""
        held = self.held

        @F.arrow_udf("string")
        def unpacked(tokens: pa.Array) -> pa.Array:
            vocabulary = held()
            return pa.array([vocabulary.decode(t) if t else "" for t in tokens.to_pylist()], pa.string())

        return docs.withColumn(to, unpacked(F.col(tokens_col)))


def encode_and_decode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens, decoded per row of ``docs``: what a text becomes and what comes back."""
    codec = Codec(docs.sparkSession, vocabulary)
    tokens = codec.encode(docs.select("doc_id", "text")).drop("text")
    return codec.decode(tokens, "tokens", "decoded")
