import hashlib
import random

from pyspark.sql import functions as F

from lurescope.llm import warc

PAGES = "page_id long, url string, html string, sha string, key string"
RECORD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"


def expected(rows):
    first = {}
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        to = first.get(b)
        revisit = to is not None and to != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def tricky(seed, n=60):
    r = random.Random(seed)
    bits = ["\r\n\r\nWARC/1.1\r\n", "WARC/1.0", "\r\n", "\r\n\r\n", "\r", "é☃", "x" * 50, RECORD.format(3, "abc"), RECORD.format(100000, "abc"), "\r\n\r\n" + RECORD.format(40, "y" * 30), "HTTP/1.1 200 OK\r\n\r\n"]
    rows = [(i, f"http://a.test/{i} \r\nWARC/1.1", "".join(r.choice(bits) for _ in range(r.randint(0, 12))), "s", "k") for i in range(n)]
    rows += [(n, None, None, None, None), (n + 1, "u", "", None, None), (n + 2, "u", "WARC/1.1\r\n" * 15, None, None), (n + 3, "u", "WARC/1.1\r\n" * 15, None, None), (n + 3, "u", "WARC/1.1\r\n" * 15, None, None)]
    return rows + [(n + 4 + i, "u", "copy" * 60, None, None) for i in range(20)]


def test_round_trip_with_magic_in_payloads(spark):
    for split, seed in (("64m", 1), ("700b", 2)):
        rows = tricky(seed, 30)
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = warc.round_trip(spark.createDataFrame(rows, PAGES).coalesce(2))
            got = [tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert sorted(got, key=repr) == expected(rows), split


def test_payloads_come_back_whole(spark, tmp_path):
    rows = tricky(5, 20)
    warc.write_pages(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/a")
    got = warc.read_warc(spark, f"file://{tmp_path}/a", keep=True).filter("warc_type = 'response'")
    got = {(warc_id, bytes(p)) for warc_id, p in got.select(warc.page_of(F.col("record_id")), "payload").collect()}
    want = {(i, (h or "").encode()) for i, _, h, *_ in rows}
    assert got <= want and len(got) == sum(x[3] == "response" for x in set(expected(rows)))


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_hostile_lengths_and_many_fake_headers(spark):
    fake = "\r\n\r\nWARC/1.1\r\nContent-Length: {}\r\n\r\n"
    many = "".join(fake.format(10**9) + "z" * 20 for _ in range(4000))
    bodies = [fake.format("9" * 25), fake.format("9" * 5000), fake.format("9" * 18), fake.format("-5"), fake.format("²"), "HTTP/1.1 200 OK\r\nContent-Length: abc\r\n\r\n" * 3, many]
    rows = [(i, "u", b, None, None) for i, b in enumerate(bodies)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).coalesce(1))
    got = [tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == expected(rows)


def test_foreign_records_with_bad_inner_lengths():
    for inner in (b"abc", b"9" * 5000, b""):
        body = warc.Body(39 + len(inner), True, True)
        body.feed(b"HTTP/1.1 200 OK\r\nContent-Length: " + inner + b"\r\n\r\nxyz")
        assert body.http_length is None and body.payload() == b"xy" and not body.left


def test_fake_headers_cost_linear_time():
    import time

    def took(n):
        pieces = [b"1\r\nContent-Length: 900000000\r\n\r\n" + b"q" * 50] * n
        began = time.perf_counter()
        out = list(warc._walk_split("f", 5, 0, -warc.MAGIC, iter(pieces), False))
        assert len(out) == 1 and not out[0][3]
        assert len(warc._split_candidates("f", 5, ((p[: p.find(b"q")], len(p)) for p in pieces))) == n + 1
        return time.perf_counter() - began

    took(100)
    assert took(40_000) < 40 * max(took(4_000), 0.01)
