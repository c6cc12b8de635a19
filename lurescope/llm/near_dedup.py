"""Near-dedup: a set similarity join by chosen paths, repeated in independent trees.

A document is the set of its word shingles, sketched by minwise tokens. In each tree a
node's documents branch by tokens that the node selects: two of them per step, so a
pair of similarity 0.75 stays together in a tree with probability 0.91, and in at
least one of four trees with 0.9999. Nodes of few documents are compared
exhaustively on sketches, larger ones branch on, and nodes that stay large after the
last step (groups of copies) are compared in parts. Pairs that sketches let pass are
confirmed on full sets.

Confirming works in two rounds, because only connections are asked for. First each
node proposes a star around the documents it saw first. Then all remaining pairs of a
node whose ends are not yet connected are confirmed, so that no link between
different components is lost, and copies are never expanded into all pairs. Documents
that are only somewhat alike would make very many such pairs, so in the second round
sketches of twelve times as many tokens decide which pairs are worth their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import key_filter, skew_safe_join, small_batches, stage, worker_cache
from lurescope.llm.graphs import components

SHINGLE = 5
#: Links have 100 * intersection >= LEAST * union.
LEAST = 75
#: Minwise tokens of a document; each tree starts from two of them, and a node selects two.
TOKENS, TREES, BRANCH, DEPTH = 64, 4, 2, 2
#: Nodes of so many documents or fewer are compared whole; parts of larger ones have about PART.
SMALL, PART = 24, 512
#: Of 64 tokens' low bytes, so many agree for all but 3 in 100,000 pairs of similarity 0.75; so many make a star's ray.
PASS, RAY = 34, 45
#: Tokens of the second round's sketches; so many low bytes agree for all but 3 in 100,000 pairs of similarity 0.75.
SHARP, SHARP_PASS = 768, 528
#: Documents compared with one side of a pair in one task.
FANOUT = 256

_RNG = np.random.default_rng(20240917)
_ODD = _RNG.integers(1, 1 << 63, SHARP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, SHARP, dtype=np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, SHINGLE + 1)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; of the whole sequence if it is shorter."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(cache) > 100_000:
        cache.clear()
    fresh = {w: xxhash.xxh64_intdigest(w) for w in set(words).difference(cache)}
    if len(fresh) <= 100_000:
        cache.update(fresh)
        fresh = cache
    else:
        fresh = {**cache, **fresh}
    h = np.fromiter((fresh[w] for w in words), dtype=np.uint64, count=len(words))
    if len(words) < SHINGLE:
        return mix64((h * _POWERS[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    n = len(words) - SHINGLE + 1
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        rolled += h[k : k + n] * _POWERS[k]
    return np.unique(mix64(rolled))


def minwise(shingles: np.ndarray, n: int = TOKENS) -> np.ndarray:
    """``n`` 32-bit minwise tokens of a set."""
    best = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = 4096 * TOKENS // n
    for i in range(0, len(shingles), step):
        best = np.minimum(best, ((shingles[i : i + step, None] ^ _XOR[:n]) * _ODD[:n]).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """The link's definition, on full sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= LEAST * (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (of equal sets), tokens (TOKENS uint32)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(None)
        cache: dict[bytes, int] = {}
        for batch in batches:
            sizes, keys, tokens = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                s = shingle_set(text.as_py(), cache)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                tokens.append(minwise(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())], ["doc_id", "n_shingles", "set_key", "tokens"])

    return docs.mapInArrow(task, "doc_id long, n_shingles long, set_key binary, tokens binary")


_ROOTS = np.random.default_rng(7).permutation(TOKENS)[: TREES * BRANCH]


def root_paths(tokens: np.ndarray) -> np.ndarray:
    """Each document's places one step below the roots of the trees, a column for each selected token."""
    return mix64((np.arange(len(_ROOTS), dtype=np.uint64) + np.uint64(1) << np.uint64(33)) + tokens[:, _ROOTS].astype(np.uint64))


def child_paths(path: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    """One step on: the paths by the two tokens that each node selects."""
    first = (mix64(path) % np.uint64(TOKENS)).astype(np.int64)
    second = (first + 1 + (mix64(path + np.uint64(1)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
    rows = np.arange(len(path))
    return [mix64(path ^ mix64((at.astype(np.uint64) << np.uint64(33)) + tokens[rows, at].astype(np.uint64))) for at in (first, second)]


def all_paths(tokens: np.ndarray) -> np.ndarray:
    """The paths of DEPTH 2 of each document: those of the first step, then those of the second."""
    one = root_paths(tokens)
    two = [p for c in range(one.shape[1]) for p in child_paths(one[:, c], tokens)]
    return np.column_stack([one, *two])


def _tokens_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("tokens").to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)


def _placed(path: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(doc, pa.int64())], ["path", "doc"])


def roots(reps: DataFrame) -> DataFrame:
    """path, doc one step below the roots."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _placed(root_paths(_tokens_of(batch)).ravel(), np.repeat(batch.column("doc").to_numpy(zero_copy_only=False), len(_ROOTS)))

    return reps.select("doc", "tokens").mapInArrow(task, "path long, doc long")


def children(rows: DataFrame) -> DataFrame:
    """``rows`` (path, doc, tokens) one step on."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for below in child_paths(batch.column("path").to_numpy().view(np.uint64), _tokens_of(batch)):
                    yield _placed(below, batch.column("doc").to_numpy(zero_copy_only=False))

    return rows.mapInArrow(task, "path long, doc long")


def build_nodes(reps: DataFrame) -> DataFrame:
    """Nodes whose documents are to be compared: path, part, cnt (of the path), doc, sketch (low bytes of the tokens)."""
    members, done = stage(roots(reps), "near-roots"), None
    tokens = reps.select("doc", "tokens")
    for depth in range(1, DEPTH + 1):
        total = members.count()
        counts = members.groupBy("path").agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1")
        shared = stage(skew_safe_join(members, counts, ["path"], "cnt", total).filter("cnt is not null"), "near-shared")
        ready = shared if depth == DEPTH else shared.filter(F.col("cnt") <= SMALL)
        parts = F.when(F.col("cnt") <= SMALL, F.lit(0)).otherwise(F.pmod(F.xxhash64("path", "doc"), F.ceil(F.col("cnt") / PART))).cast("long")
        ready = ready.select("path", parts.alias("part"), "cnt", "doc")
        done = ready if done is None else done.unionByName(ready)
        if depth < DEPTH:
            on = shared.filter(F.col("cnt") > SMALL)
            if on.isEmpty():
                break
            members = stage(children(on.select("path", "doc").join(tokens, "doc").select("path", "doc", "tokens")), "near-branches")
    return stage(done.join(reps.select("doc", "sketch"), "doc").select("path", "part", "cnt", "doc", "sketch"), "near-nodes")


def _by_node(batches: Iterator[pa.RecordBatch], key: int, names: list[str], sketch: str = "sketch", width: int = TOKENS) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Rows arrive by node (the first ``key`` columns): each node's further columns and its sketches."""
    held: list = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        sk = np.frombuffer(b"".join(batch.column(sketch).to_pylist()), dtype=np.uint8).reshape(-1, width)
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for c in cols[:key]:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.append(np.flatnonzero(new), batch.num_rows)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            node = tuple(c[lo] for c in cols[:key])
            if node != current and held:
                yield [np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)], np.concatenate([h[1] for h in held])
                held = []
            current = node
            held.append(([c[lo:hi] for c in cols[key:]], sk[lo:hi]))
    if held:
        yield [np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)], np.concatenate([h[1] for h in held])


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def stars(nodes: DataFrame) -> DataFrame:
    """First round: pairs (a < b) of each document with the most alike of those that lead its node."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for (docs,), sk in _by_node(batches, 2, ["path", "part", "doc"]):
            lead = [0]
            for i in range(1, len(docs)):
                same = (sk[lead] == sk[i]).sum(axis=1)
                best = int(same.argmax())
                if same[best] >= PASS and docs[lead[best]] != docs[i]:
                    found.append((int(docs[lead[best]]), int(docs[i])))
                if same[best] < RAY:
                    lead.append(i)
            if len(found) > 20_000:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    ordered = nodes.select("path", "part", "doc", "sketch").repartition("path", "part").sortWithinPartitions("path", "part", "doc")
    return ordered.mapInArrow(task, "a long, b long").distinct()


def open_nodes(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells of the nodes that hold several components: path, g, p, kind, doc, label, sketch.

    Documents of a node's largest component need no comparison with each other; the
    others are its guests. A node's documents are dealt into parts and its guests into
    groups, and each group meets each part in a cell of its own, so that a task gets
    one group and one part, however large the node. Kinds: 0 lives in the part and is
    of the largest component, 1 lives in the part and is a guest elsewhere, 2 visits.
    A node of one part and group is one cell without visitors.
    """
    at = nodes.join(labels.select(F.col("v").alias("doc"), "label"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    held = at.groupBy("path", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = held.groupBy("path").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"), F.max(F.struct("n", "label")).alias("top")).filter("k > 1")
    mixed = mixed.select("path", "w", F.col("top.label").alias("top"), (F.col("w") - F.col("top.n")).alias("guests"))
    here = skew_safe_join(at, mixed, ["path"], "w", nodes.count()).filter("w is not null")
    parts = F.when(F.col("cnt") <= SMALL, F.lit(1)).otherwise(F.ceil(F.col("cnt") / PART)).cast("int")
    groups = F.ceil(F.col("guests") / PART).cast("int")
    cell = lambda g, p, kind: F.struct(g.cast("int").alias("g"), p.cast("int").alias("p"), kind.cast("int").alias("kind"))
    guest = F.col("label") != F.col("top")
    lives = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: cell(g, F.col("part"), guest))
    mine = F.pmod(F.xxhash64(F.lit(1), "path", "doc"), groups)
    visits = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: cell(mine, p, F.lit(2)))
    alone = (parts == 1) & (groups == 1)
    cells = F.when(alone | ~guest, lives).otherwise(F.concat(lives, visits))
    return here.select("path", F.explode(cells).alias("c"), "doc", "label", "sketch").select("path", "c.g", "c.p", "c.kind", "doc", "label", "sketch")


def _meetings(kind: np.ndarray, docs: np.ndarray, label: np.ndarray, sk: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a cell: each guest and the rows that it may be linked with, each pair of the node once."""
    lives = np.flatnonzero(kind < 2)
    come = np.flatnonzero(kind == 2)
    here = not len(come)
    for i in np.flatnonzero(kind == 1) if here else come:
        ok = ((sk[lives] == sk[i]).sum(axis=1) >= least) & (label[lives] != label[i]) & ((kind[lives] == 0) | (docs[lives] > docs[i]))
        if ok.any():
            yield int(i), lives[ok]


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("path", "g", "p").sortWithinPartitions("path", "g", "p", "doc")


def unsettled(rows: DataFrame) -> DataFrame:
    """Ids of documents that some pair needs which sketches let pass and whose ends are not connected yet."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[int] = set()
        for (kind, docs, label), sk in _by_node(batches, 3, ["path", "g", "p", "kind", "doc", "label"]):
            for i, at in _meetings(kind, docs, label, sk, PASS):
                found.add(int(docs[i]))
                found.update(docs[at].tolist())
            if len(found) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["doc"])
                found = set()
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["doc"])

    return _by_cell(rows).mapInArrow(task, "doc long").distinct()


def sharpen(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, sharp (low bytes of SHARP tokens, then all paths) of the documents with these ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            sharp = []
            for t in batch.column("text").cast(pa.binary()):
                tokens = minwise(shingle_set(t.as_py(), cache), SHARP)
                sharp.append(tokens.astype(np.uint8).tobytes() + all_paths(tokens[None, :TOKENS]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sharp, pa.binary())], ["doc", "sharp"])

    may_be = key_filter(ids.select(F.xxhash64("doc").alias("key")))
    texts = docs.filter("text is not null and doc_id is not null").withColumn("key", F.xxhash64("doc_id")).filter(may_be("key")).select(F.col("doc_id").alias("doc"), "text")
    return texts.join(ids, "doc").select("doc", "text").mapInArrow(task, "doc long, sharp binary")


def rest(rows: DataFrame, sharp: DataFrame, tested: DataFrame) -> DataFrame:
    """Second round: all pairs of a node that both sketches let pass and that are not connected yet nor tested.

    A pair that meets in several nodes is proposed by the first of them: the paths of
    both documents tell which second steps they share, and what they share for certain
    comes before anything later.
    """
    n_roots = TREES * BRANCH
    width = SHARP + 8 * (n_roots + n_roots * BRANCH)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for (node, kind, docs, label), data in _by_node(batches, 3, ["path", "g", "p", "node", "kind", "doc", "label"], "sharp", width):
            sk = data[:, :SHARP]
            ways = np.ascontiguousarray(data[:, SHARP:]).view(np.uint64)
            below, here = ways[:, n_roots:], node[:1].astype(np.int64).view(np.uint64)[0]
            second = np.flatnonzero(below[0] == here)
            first = np.flatnonzero(ways[0, :n_roots] == here)
            for i, at in _meetings(kind, docs, label, sk, SHARP_PASS):
                same = below[at] == below[i]
                shared = np.where(same.any(axis=1), same.argmax(axis=1), n_roots * BRANCH)
                ok = shared == second[0] if len(second) else shared // BRANCH >= first[0]
                found.update((int(min(docs[i], d)), int(max(docs[i], d))) for d in docs[at[ok]])
            if len(found) > 50_000:
                yield _pairs(list(found))
                found = set()
        yield _pairs(list(found))

    rows = rows.select("path", "g", "p", F.col("path").alias("node"), "kind", "doc", "label")
    return _by_cell(rows.join(sharp, "doc")).mapInArrow(task, "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that are links on full sets. ``docs``: doc_id, text; only texts that some pair has are moved.

    Documents of many pairs are given in several copies, each to FANOUT pairs or so, on either side.
    """
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    may_be = key_filter(ends.select(F.xxhash64("id").alias("key")))
    texts = docs.filter(F.col("text").isNotNull()).withColumn("key", F.xxhash64("doc_id")).filter(may_be("key")).select("doc_id", "text")
    n = pairs.count()

    def dealt(pairs: DataFrame, end: str, other: str, salt: str) -> tuple[DataFrame, DataFrame]:
        """Pairs with a copy's number of one end's text, and those copies."""
        many = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("w"))
        copies = F.ceil(F.col("w") / FANOUT).cast("int")
        salted = skew_safe_join(pairs, many.filter(F.col("w") > FANOUT), [end], "w", n)
        salted = salted.withColumn(salt, F.coalesce(F.pmod(F.xxhash64(other), copies).cast("int"), F.lit(0))).drop("w")
        copied = many.select(F.col(end).alias("doc_id"), copies.alias("copies")).join(texts, "doc_id")
        return salted, copied.select(F.col("doc_id").alias(end), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias(salt), "text")

    pairs, hubs = dealt(pairs, "a", "b", "salt")
    pairs, rays = dealt(pairs, "b", "a", "turn")
    hub = hubs.select("a", "salt", F.lit(-1).cast("long").alias("b"), F.lit(0).alias("side"), "text")
    ray = pairs.join(rays, ["b", "turn"]).select("a", "salt", "b", F.lit(1).alias("side"), "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        hubs: list[np.ndarray] = []
        current = None
        for batch in batches:
            found = []
            texts_ = batch.column("text").cast(pa.binary())
            for i, (a, salt, b, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "side")), strict=True)):
                s = shingle_set(texts_[i].as_py(), cache)
                if (a, salt) != current:
                    current, hubs = (a, salt), []
                if side == 0:
                    hubs.append(s)
                elif any(similar(h, s) for h in hubs):
                    found.append((a, b))
            yield _pairs(found)

    both = hub.unionByName(ray).repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    return both.mapInArrow(task, "a long, b long").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts that are null, empty or white space have no shingles and are linked with
    nothing. Equal sets are one class, represented by its smallest id. Rows that share
    an id are one vertex; rows without an id stand alone. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(sketches(slim), "near-sketches")
    total = rows.count()
    classes = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("cnt"), F.first("tokens").alias("tokens"))
    low_bytes = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda i: F.substring(F.hex("tokens"), i * 8 + 1, F.lit(2))), ""))
    reps = stage(classes.withColumn("sketch", low_bytes), "near-classes")
    nodes = build_nodes(reps.select("doc", "tokens", "sketch"))
    first = stage(stars(nodes), "near-stars")
    links = stage(confirm(first, slim), "near-links")
    labels = components(links)
    rows_ = stage(open_nodes(nodes, labels), "near-open")
    ids = stage(unsettled(rows_), "near-unsettled")
    second = stage(rest(rows_, stage(sharpen(ids, slim), "near-sharp"), first), "near-rest")
    if not second.isEmpty():
        more = stage(confirm(second, slim), "near-links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    named = reps.select("set_key", "cnt", "doc").join(labels.select(F.col("v").alias("doc"), "label"), "doc", "left")
    named = stage(named.select("set_key", "cnt", F.coalesce("label", "doc").alias("component")), "near-components")
    out = skew_safe_join(rows.select("doc_id", "n_shingles", "set_key"), named, ["set_key"], "cnt", total)
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
