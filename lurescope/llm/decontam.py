"""Benchmark decontamination over a distributed positional inverted index.

Each shard of the index holds a run of documents whole: for every term of the
benchmark the sorted positions of its occurrences. Shards are rows of a table in the
shared folder, so neither building nor searching shuffles text. A window's lists are
intersected from its rarest term in the shard on, each list shifted by the term's
place in the window; what is left are the places of the exact phrase. Near its places,
within SLOP words and but for one word in ten, a window is a proximity match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import small_batches, stage, worker_cache

WINDOW = 10
#: Words that each term of a proximity match may be off its place.
SLOP = 2
#: Words in a shard of the index, about.
SHARD_WORDS = 1 << 20
#: Bytes of benchmark text that are searched for in one pass; a larger benchmark takes more passes.
BLOCK_BYTES = 32 << 20
#: A-Z become a-z; ASCII letters, digits and all bytes of non-ASCII characters are kept, the rest divides words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8."""
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(FOLD).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[list[bytes]]:
    if not words:
        return []
    return [words[i : i + window] for i in range(max(1, len(words) - window + 1))]


def build_index(docs: DataFrame, vocabulary: set[bytes], id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The positional index of ``docs`` for ``vocabulary``, a row for each shard.

    Position p of a shard is word p - starts[d] of its document d; documents stand
    WINDOW apart, so that no phrase spans two.
    """
    spark = docs.sparkSession
    ids = spark.sparkContext.broadcast({w: i for i, w in enumerate(sorted(vocabulary))})

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(None)
        get = ids.value.get
        names, lengths, parts = [], [], []
        held = 0

        def out() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64) + WINDOW)])[:-1]
            terms = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
            places = np.concatenate([p[1] + s for p, s in zip(parts, starts.tolist(), strict=True)]) if parts else np.zeros(0, np.int64)
            order = np.argsort(terms, kind="stable")
            terms, places = terms[order], places[order]
            firsts = np.flatnonzero(np.diff(terms, prepend=-1))
            arrays = [names, lengths, starts.astype(np.int64), terms[firsts], np.append(firsts, len(terms)).astype(np.int32), places.astype(np.int32)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([a], pa.list_(t)) for a, t in zip(arrays, kinds, strict=True)], ["doc_ids", "n_words", "starts", "terms", "firsts", "places"])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                words = words_of(text.as_py())
                found = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))
                at = np.flatnonzero(found >= 0)
                names.append(doc)
                lengths.append(len(words))
                parts.append((found[at], at))
                held += len(words) + WINDOW
                if held >= shard_words:
                    yield out()
                    names, lengths, parts, held = [], [], [], 0
        if names:
            yield out()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = slim.mapInArrow(shards, "doc_ids array<long>, n_words array<long>, starts array<long>, terms array<int>, firsts array<int>, places array<int>")
    return stage(index.withColumn("shard", F.monotonically_increasing_id()), "decontam-index")


def in_list(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of the values the sorted places have."""
    if not len(places):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(places, values)
    at[at == len(places)] = 0
    return places[at] == values


def near_anchors(gram: list[int], order: list[int], lists, slop: int, loose: int) -> list[tuple[int, np.ndarray]]:
    """Words of a window (their places in it) and occurrences of theirs that a proximity match may hold; ``order`` has the words, rarest first.

    All but ``loose`` words are near their places, so one of the ``loose`` + 1 rarest is:
    their occurrences are all there are to look around. Two words that are near their
    places are at most twice ``slop`` off their distance in the window, which leaves few
    occurrences after the next rarest words. Places are 32-bit throughout, as the lists
    are, since searching in a list of another type would copy it.
    """
    out, twice = [], 2 * slop
    for j in order[: loose + 1]:
        p = lists(gram[j])
        missed = np.zeros(len(p), dtype=np.int8)
        for k in order:
            if not len(p):
                break
            if k == j:
                continue
            q = lists(gram[k])
            missed += np.searchsorted(q, p + np.int32(k - j + twice), side="right") == np.searchsorted(q, p + np.int32(k - j - twice), side="left")
            keep = missed <= loose
            if not keep.all():
                p, missed = p[keep], missed[keep]
        if len(p):
            out.append((j, p))
    return out


def near_places(gram: list[int], around: list[tuple[int, np.ndarray]], lists, starts: np.ndarray, ends: np.ndarray, slop: int, loose: int) -> np.ndarray:
    """Documents of a shard with a proximity match of a window, which has one of the occurrences in ``around``."""
    span = np.arange(-slop, slop + 1, dtype=np.int32)
    base = []
    for j, p in around:
        doc = np.searchsorted(starts, p, side="right") - 1
        base.append(np.stack([(p[:, None] - np.int32(j) + span).ravel(), np.repeat(doc, len(span)).astype(np.int32)]))
    base, doc = np.unique(np.concatenate(base, axis=1), axis=1)
    first, last = starts[doc].astype(np.int32), (ends[doc] - 1).astype(np.int32)
    missed, exact = np.zeros(len(base), dtype=np.int64), np.zeros(len(base), dtype=bool)
    for j, term in enumerate(gram):
        p, at = lists(term), base + np.int32(j)
        low, high = np.maximum(at - np.int32(slop), first), np.minimum(at + np.int32(slop), last)
        missed += np.searchsorted(p, high, side="right") <= np.searchsorted(p, low, side="left")
        exact |= in_list(at, p) & (at >= first) & (at <= last)
    return np.unique(doc[exact & (missed <= loose)])


def search(index: DataFrame, items: list[tuple[str, list[bytes]]], vocabulary: set[bytes], window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Matches of the items' windows, a row for each document of the index.

    Returns shard, ord, doc_id, n_words, hits (positions of words inside an exact
    occurrence), items (ids with an exact occurrence) and near (ids of which some window
    has a proximity match; none where ``slop`` is null). A window of n words matches near
    a place if one of its words stands exactly as far from it as in the window and all
    but n // 10 of its words have an occurrence within ``slop`` words from there, in
    the same document. So an exact occurrence is a proximity match too.
    """
    spark = index.sparkSession
    ids = {w: i for i, w in enumerate(sorted(vocabulary))}
    # Windows of one length are rows of a table; equal ones are one row, with all their owners.
    lengths: dict[int, list[tuple[np.ndarray, int]]] = {}
    for k, (_, words) in enumerate(items):
        if words:
            coded = np.fromiter((ids[w] for w in words), dtype=np.int32, count=len(words))
            lengths.setdefault(min(len(words), window), []).append((coded, k))
    tables = []
    for n, held in lengths.items():
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, n) for c, _ in held])
        owner = np.concatenate([np.full(len(c) - n + 1, k, dtype=np.int32) for c, k in held])
        table, at = np.unique(rows, axis=0, return_inverse=True)
        order = np.argsort(at.ravel(), kind="stable")
        tables.append((n, table, owner[order], np.append(0, np.cumsum(np.bincount(at.ravel(), minlength=len(table))))))
    query = spark.sparkContext.broadcast((tables, [i for i, _ in items], len(ids)))

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, names, n_terms = query.value
        for batch in batches:
            for row in range(batch.num_rows):
                col = lambda c, row=row, batch=batch: batch.column(c)[row].values
                doc_ids, shard = col("doc_ids").to_pylist(), batch.column("shard")[row].as_py()
                n_words, starts, terms, firsts, places = (col(c).to_numpy() for c in ("n_words", "starts", "terms", "firsts", "places"))
                lo, length = np.zeros(n_terms, dtype=np.int64), np.zeros(n_terms, dtype=np.int64)
                lo[terms], length[terms] = firsts[:-1], np.diff(firsts)
                begin, end = lo.tolist(), (lo + length).tolist()
                lists = lambda t, begin=begin, end=end, places=places: places[begin[t] : end[t]]
                hit = np.zeros(int(starts[-1] + n_words[-1]) + window if len(starts) else 0, dtype=bool)
                exact: list[set[int]] = [set() for _ in doc_ids]
                near: list[set[int]] = [set() for _ in doc_ids]
                ends = starts + n_words
                for n, table, owner, cuts in groups:
                    sizes = length[table]
                    loose = n // WINDOW if slop is not None else 0
                    orders = np.argsort(sizes, axis=1, kind="stable").tolist()
                    for g in np.flatnonzero((sizes > 0).sum(axis=1) >= n - loose).tolist():
                        order, gram = orders[g], table[g].tolist()
                        if slop is not None:
                            around = near_anchors(gram, order, lists, slop, loose)
                            if not around:
                                continue  # no exact occurrence either
                        owners = owner[cuts[g] : cuts[g + 1]].tolist()
                        at = lists(gram[order[0]]) - np.int32(order[0])
                        for j in order[1:]:
                            if not len(at):
                                break
                            at = at[in_list(at + np.int32(j), lists(gram[j]))]
                        if len(at):
                            for j in range(n):
                                hit[at + j] = True
                            for d in np.unique(np.searchsorted(starts, at, side="right") - 1):
                                exact[d].update(owners)
                        if slop is not None:
                            for d in near_places(gram, around, lists, starts, ends, slop, loose):
                                near[d].update(owners)
                hits = [np.flatnonzero(hit[s : s + n]).astype(np.int32) for s, n in zip(starts.tolist(), n_words.tolist(), strict=True)]
                for i in range(0, len(doc_ids), 2000):
                    part = slice(i, i + 2000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard] * len(doc_ids[part]), pa.int64()),
                            pa.array(range(i, i + len(doc_ids[part])), pa.int32()),
                            pa.array(doc_ids[part], pa.int64()),
                            pa.array(n_words[part], pa.int64()),
                            pa.array(hits[part], pa.list_(pa.int32())),
                            pa.array([sorted({names[k] for k in x}) for x in exact[part]], pa.list_(pa.string())),
                            pa.array([sorted({names[k] for k in x}) for x in near[part]], pa.list_(pa.string())),
                        ],
                        ["shard", "ord", "doc_id", "n_words", "hits", "items", "near"],
                    )

    return index.mapInArrow(matches, "shard long, ord int, doc_id long, n_words long, hits array<int>, items array<string>, near array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, hits, items, near (see ``search``).

    Null and empty texts have no words and no hits; a null item text has no windows.
    Items that share an id count once. Documents that repeat are each returned. The
    benchmark is searched in blocks of ``block_bytes`` of text, so what a task is sent
    is bounded; hits of the blocks are united per document. Other columns are ignored.
    An empty benchmark leaves every document without hits.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 50)).first()[0] or 0
    n_blocks = int(size // block_bytes) + 1
    if n_blocks > 1:
        # Rows get a number once, by which the blocks' hits are united.
        rows = stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row")), "decontam-rows")
        docs, id_col, text_col = rows, "row", "text"
    found = None
    for b in range(n_blocks):
        block = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b)
        held = [("" if r[0] is None else r[0], words_of(r[1])) for r in block.collect()]
        vocabulary = {w for _, words in held for w in words}
        index = build_index(docs, vocabulary, id_col, text_col)
        part = search(index, held, vocabulary, window, slop)
        found = part if found is None else found.unionByName(part)
    if n_blocks > 1:
        united = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        found = found.groupBy(F.col("doc_id").alias("row"), "n_words").agg(united("hits"), united("items"), united("near"))
        found = rows.select("row", F.col("id").alias("doc_id")).join(found, "row").drop("row")
    return found
