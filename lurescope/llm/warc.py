"""WARC archives: writing, and reading by verified chains of record boundaries.

Archives are read in splits. The magic that opens a record may also stand inside a
payload, so each place that looks like a record is only a candidate: its task emits
where it starts and where, by its Content-Length, its successor must start. Chains are
followed inside a split by its task; between splits, pointer jumping from the start of
each file doubles the step each round. Candidates that no chain from a file's start
reaches are payload. Only then are payloads read: a split follows the one chain that
enters it, so each byte is digested once, whatever its payloads pretend to be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurescope.llm.common import key_filter, key_of, new_path, skew_safe_join, small_batches, stage, worker_cache

END = "\r\n\r\n"
#: A record's magic with the byte before it. It has no part that is its own beginning, so a reader that
#: meets the end of a split or buffer inside it needs no step back (the whole blank line would).
BETWEEN = "\nWARC/1."
MAGIC = len("WARC/1.")
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages`` to a folder of WARC files, one file for each task.

    A null html is an empty payload. Of equal payloads of LEAST_REVISIT bytes or more
    the one with the smallest id is a response and the others revisit it; rows that
    repeat that id are responses too, and a null id comes last. Blanks and control
    characters in a url become %20; a null url is left out. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha2("html", 256)).withColumn("n", F.octet_length("html")).withColumn("key", key_of("sha"))
    same = stage(rows.filter(F.col("n") >= LEAST_REVISIT).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("cnt")).filter("cnt > 1"), "warc-same")
    may_repeat = key_filter(same.select(key_of("sha").alias("key")))
    # Payloads that occur once go from input to archive without a shuffle.
    rows = rows.withColumn("rep", may_repeat("key"))
    once = rows.filter("not rep").withColumn("first", F.lit(None).cast("long"))
    total = same.agg(F.sum("cnt")).first()[0] or 0
    more = skew_safe_join(rows.filter("rep"), same, ["sha"], "cnt", total).drop("cnt")
    out = once.unionByName(more)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", urn(F.col("id"))), line("WARC-Date", F.lit(date)),
        F.when(uri.isNull(), F.lit("")).otherwise(line("WARC-Target-URI", uri)), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("sha"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body,
    )
    out.select(record.alias("value")).write.option("lineSep", END).text(path)


def _number(text: str) -> int | None:
    """A length of at most 18 digits; null for anything else."""
    return int(text) if text.isascii() and text.isdigit() and len(text) <= 18 else None


class Body:
    """A record's block as its bytes come: the HTTP header, then count, digest and, if wanted, bytes of the payload."""

    def __init__(self, length: int, http: bool, keep: bool) -> None:
        self.left, self.head, self.keep, self.drop = length, bytearray() if http else None, keep, 0
        self.http_length: int | None = None
        self.size, self.sha, self.parts = 0, hashlib.sha256(), []

    def feed(self, data: bytes) -> None:
        # A block that begins with the magic: the line feed read with it still belongs to the header.
        data, self.drop = data[self.drop :], max(0, self.drop - len(data))
        data = data[: self.left]
        self.left -= len(data)
        if self.head is not None:
            seen = max(0, len(self.head) - 3)
            self.head += data
            at = self.head.find(b"\r\n\r\n", seen)
            if at < 0:
                return
            data, head, self.head = bytes(self.head[at + 4 :]), bytes(self.head[:at]), None
            self.http_length = _number(_fields(head).get("content-length", ""))
        self.size += len(data)
        self.sha.update(data)
        if self.keep:
            self.parts.append(data)

    def payload(self) -> bytes | None:
        return b"".join(self.parts) if self.keep else None


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def _header(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """Fields, length of the header and of the block, if ``piece`` (after the magic) opens a record."""
    at = piece.find(b"\r\n\r\n")
    if at < 0 or not piece[:1].isdigit() or piece[1:3] != b"\r\n":
        return None
    fields = _fields(piece[:at])
    length = _number(fields.get("content-length", ""))
    return None if length is None else (fields, at + 4, length)


META = ["warc_type", "record_id", "target_uri", "refers_to", "header_digest", "http_length", "payload_bytes", "payload_digest", "payload"]
META_TYPES = [*[pa.string()] * 5, pa.int64(), pa.int64(), pa.string(), pa.binary()]
CANDIDATE = "file string, block long, rel long, succ long, leave long, total long"
RECORD = "file string, offset long, succ long, complete boolean, warc_type string, record_id string, target_uri string, refers_to string, header_digest string, http_length long, payload_bytes long, payload_digest string, payload binary"


def _meta(fields: dict[str, str], body: Body) -> list:
    return [fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"), body.http_length, body.size, body.sha.hexdigest(), body.payload()]


def _is_http(fields: dict[str, str]) -> bool:
    return fields.get("content-type", "").lower().startswith("application/http")


def _split_candidates(file: str, block: int, heads: Iterator[tuple[bytes | None, int]]) -> list[tuple]:
    """Candidates of one split with offsets from its first piece (a magic stands before that), and a row with the split's length (rel null).

    ``heads``: of each piece what may be a header, blank line included, and the piece's bytes.
    """
    found: list[tuple[int, int]] = []
    at, first = 0, block == 0
    for head, size in heads:
        start = 0 if first else at - MAGIC
        if head is not None and first:
            head = head[MAGIC:] if head.startswith(b"WARC/1.") else None
        if head is not None and (got := _header(head)) is not None:
            found.append((start, start + MAGIC + got[1] + got[2] + 4))
        at, first = at + size + len(BETWEEN), False
    leave: dict[int, int] = {}
    out: list[tuple] = [(file, block, None, None, None, at)]
    for rel, succ in reversed(found):
        leave[rel] = leave.get(succ, succ)
        out.append((file, block, rel, succ, leave[rel], None))
    return out


def _walk_split(file: str, block: int, base: int, entry: int, pieces: Iterator[bytes], keep: bool) -> Iterator[list]:
    """The records of one split along the chain that enters it at ``entry``; one body is open at a time."""
    at, first, due = 0, block == 0, entry
    now: list | None = None

    def close() -> list:
        rel, succ, fields, body = now
        return [file, base + rel, base + succ, body.left == 0, *_meta(fields, body)]

    for raw in pieces:
        start = 0 if first else at - MAGIC
        if now is not None and now[3].left:
            if not first:
                now[3].feed(BETWEEN.encode())
            now[3].feed(raw)
        if start == due:
            piece = raw[MAGIC:] if first else raw
            if now is not None:
                yield close()
                now = None
            if (head := _header(piece) or _header(piece + b"\n")) is not None:
                fields, skip, length = head
                body = Body(length, _is_http(fields), keep)
                body.drop = max(0, skip - len(piece))
                body.feed(piece[skip:])
                due = start + MAGIC + skip + length + 4
                now = [start, due, fields, body]
        at, first = at + len(raw) + len(BETWEEN), False
    if now is not None:
        yield close()


def _text(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", BETWEEN).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _batches(rows: Iterator, n: int, kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") if isinstance(row[-1], bytes) else 0
        if len(held) >= n or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """What looks like a record in the archives, by split; only what may be headers leaves the JVM."""
    v = F.col("value")
    may_open = ((F.substring(v, 2, 2) == "\r\n") & F.substring(v, 1, 1).between("0", "9")) | ((F.col("block") == 0) & v.startswith("WARC/1."))
    # The last line feed of a header may have been read as the next magic's.
    head = F.when(F.instr(v, "\r\n\r\n") > 0, F.concat(F.substring_index(v, "\r\n\r\n", 1), F.lit("\r\n\r\n"))).when(v.endswith("\r\n\r"), F.concat(v, F.lit("\n")))
    heads = _text(spark, path).select("file", "block", F.when(may_open, head).cast("binary").alias("head"), F.octet_length(v).cast("long").alias("size"))
    names = [c.split()[0] for c in CANDIDATE.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(None)

        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("file", "block", "head", "size")), strict=True)

        for (file, block), group in groupby(rows(), key=lambda r: r[:2]):
            got = _split_candidates(file, block, ((r[2], r[3]) for r in group))
            yield from _batches(iter(got), 5000, [pa.string(), *[pa.int64()] * 5], names)

    return heads.mapInArrow(task, CANDIDATE)


def read_warc(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """The records of the archives in ``path``: file, offset, header fields, payload's bytes and digest.

    ``keep`` returns payloads too. ``complete`` is false for a record that its file
    ends within. An empty folder of archives gives no records; a length that is no
    number of at most 18 digits opens no record.
    """
    small_batches(spark)
    looks = stage(candidates(spark, path), "warc-candidates")
    ends = looks.filter("rel is null").select("file", "block", "total")
    base = (F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base")
    splits = stage(ends.select("file", "block", "total", base), "warc-splits")
    placed = looks.filter("rel is not null").drop("total").join(splits.drop("total"), ["file", "block"])
    places = stage(placed.select("file", "block", "base", "rel", (F.col("base") + F.col("rel")).alias("at"), (F.col("base") + F.col("leave")).alias("leave")), "warc-chains")

    # Only places that some chain leads to, or a file's start, can be where a split is entered.
    entries = places.select("file", F.col("leave").alias("at")).union(splits.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    jump = stage(places.join(entries, ["file", "at"]).select("file", "at", "leave"), "warc-jumps")
    reached = jump.filter("at = 0").select("file", "at")
    longest = splits.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < longest:
        ahead = jump.select("file", F.col("at").alias("leave"), F.col("leave").alias("then"))
        # A chain that leaves the jumps ends there; the last step may lead nowhere.
        reached = stage(reached.union(reached.join(jump, ["file", "at"]).select("file", F.col("leave").alias("at"))).distinct(), "warc-reached")
        jump = stage(jump.join(ahead, ["file", "leave"]).select("file", "at", F.col("then").alias("leave")), "warc-jumps")
        step *= 2
    # One row of three numbers for each split of the archives: what a chain enters, and where.
    start = reached.join(places, ["file", "at"]).select(F.xxhash64("file").alias("_f"), "block", "base", F.col("rel").alias("entry"))
    pieces = _text(spark, path).withColumn("_f", F.xxhash64("file"))
    pieces = pieces.join(F.broadcast(start), ["_f", "block"])
    pieces = pieces.select("file", "block", "base", "entry", F.col("value").cast("binary").alias("value"))
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *META_TYPES]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("file", "block", "base", "entry")), b.column("value"), strict=True)

        def records() -> Iterator[list]:
            for (file, block, base, entry), group in groupby(rows(), key=lambda r: r[:4]):
                yield from _walk_split(file, block, base, entry, (r[4].as_py() for r in group), keep)

        yield from _batches(records(), 2000, kinds, names)

    records = stage(pieces.mapInArrow(task, RECORD), "warc-records")
    open_ = records.filter("not complete").select("file", "offset", "succ")
    return records if open_.isEmpty() else _complete(spark, path, records, splits, open_, keep)


def _complete(spark: SparkSession, path: str, records: DataFrame, splits: DataFrame, open_: DataFrame, keep: bool) -> DataFrame:
    """Records that go on in later splits behind a magic of their payload; one for each split at most."""
    pieces = _text(spark, path).withColumn("value", F.col("value").cast("binary"))
    need = open_.select("file", F.col("offset").alias("from"), F.col("succ").alias("to"))
    spread = splits.join(need, "file").filter("base < to and base + total > from").select("file", "block", "base", "from", "to")
    seq = pieces.withColumn("seq", F.monotonically_increasing_id())
    # Running lengths inside a split, of splits that such a record touches only.
    near = seq.join(spread.select("file", "block", "base").distinct(), ["file", "block"])
    size = F.octet_length("value") + len(BETWEEN)
    run = F.sum(size).over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - size
    placed = near.withColumn("at", F.col("base") + run)
    mine = placed.join(spread.drop("base"), ["file", "block"]).filter(f"at + octet_length(value) >= `from` and at - {MAGIC} < `to`")

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        whole, lo = BETWEEN.encode().join(pdf["value"]), int(pdf["at"].iloc[0])
        start = max(0, key[1] + MAGIC - lo)
        fields, skip, length = _header(whole[start:])
        body = Body(length, _is_http(fields), keep)
        body.feed(whole[start + skip :])
        return pd.DataFrame([[key[0], key[1], body.left == 0, body.http_length, body.size, body.sha.hexdigest(), body.payload()]], columns=["file", "offset", "complete", "http_length", "payload_bytes", "payload_digest", "payload"])

    done = mine.select("file", F.col("from").alias("offset"), "at", "value").groupBy("file", "offset").applyInPandas(finish, "file string, offset long, complete boolean, http_length long, payload_bytes long, payload_digest string, payload binary")
    fields = records.filter("not complete").drop("complete", "http_length", "payload_bytes", "payload_digest", "payload").join(done, ["file", "offset"])
    return records.filter("complete").unionByName(fields)


def page_of(urn: Column) -> Column:
    """The id in a record's URN, null where there is none."""
    return F.regexp_extract(urn, r"urn:x-page:(-?\d+)", 1).try_cast("long")


def round_trip(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write ``pages`` as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per row of ``pages``: null and empty html have 0 bytes, rows that repeat are
    each returned, a null id stays null. An empty table gives an empty result; further
    columns are ignored. Payloads may hold anything, records of this format too.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_pages(pages, path, **columns)
    got = read_warc(spark, path)
    revisit = F.col("warc_type") == "revisit"
    return got.select(
        page_of(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.expr("substring(header_digest, 8)")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page_of(F.col("refers_to")).alias("refers_to"),
        "file", "offset",
    )
