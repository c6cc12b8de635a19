"""Captured artifacts as rows: e-mails, archives, network logs, stage manifests, threat-sharing objects."""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from email import policy
from email.parser import BytesParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.functions import hosts, lookups, urls

MOST_FILES, MOST_FILE, MOST_TOTAL = 10_000, 50 << 20, 500 << 20
# Headers of an e-mail that are kept.
HEADERS = ("From", "To", "Subject", "Date", "Message-ID", "Reply-To", "Return-Path", "X-Mailer", "X-Originating-IP", "Received", "Authentication-Results", "DKIM-Signature")
EML = "headers map<string,string>, received array<string>, text string, html string, links array<string>, attachments array<struct<name:string,type:string,size:long>>, nested int, error string"


def parse_eml(raw: bytes) -> dict:
    """An e-mail's headers, bodies, links in order and attachments; attached e-mails are counted, not opened."""
    import re

    out: dict = {"headers": {}, "received": [], "text": None, "html": None, "links": [], "attachments": [], "nested": 0, "error": None}
    try:
        m = BytesParser(policy=policy.default).parsebytes(raw)
        out["headers"] = {h: str(m[h]) for h in HEADERS if m[h] is not None}
        out["received"] = [str(x) for x in m.get_all("Received", [])]
        parts = [m]
        while parts:
            p = parts.pop(0)
            kind = p.get_content_type()
            if kind == "message/rfc822":
                out["nested"] += 1
            elif p.is_multipart():
                parts[:0] = list(p.iter_parts())
            elif p.get_filename() or p.get_content_disposition() == "attachment":
                body = p.get_payload(decode=True) or b""
                out["attachments"].append({"name": p.get_filename() or "", "type": kind, "size": len(body)})
            elif kind in ("text/plain", "text/html"):
                key = "text" if kind == "text/plain" else "html"
                body = (p.get_payload(decode=True) or b"").decode(p.get_content_charset() or "utf-8", "replace")
                out[key] = body if out[key] is None else out[key] + "\n" + body
        found = re.findall(r"https?://[^\s<>\"']+", f"{out['html'] or ''}\n{out['text'] or ''}")
        out["links"] = list(dict.fromkeys(found))
    except (LookupError, ValueError) as e:
        out["error"] = str(e)
    return out


def read_eml(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with an e-mail's parts for a column of its bytes."""

    @F.pandas_udf("struct<" + ",".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in _fields(EML))) + ">")
    def parse(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_eml(b or b"") for b in raw])

    return files.withColumn("eml", parse(F.col(content)))


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def archive_members(name: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of a zip or tar archive within the caps; names that leave the archive are passed over."""
    total = n = 0

    def fits(path: str, size: int) -> bool:
        parts = path.replace("\\", "/").split("/")
        return not path.startswith("/") and ".." not in parts and size <= MOST_FILE and total + size <= MOST_TOTAL and n < MOST_FILES

    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for i in z.infolist():
                if not i.is_dir() and not i.flag_bits & 1 and fits(i.filename, i.file_size):
                    with z.open(i) as f:
                        body = f.read(MOST_FILE + 1)
                    if len(body) <= MOST_FILE:
                        total, n = total + len(body), n + 1
                        yield i.filename, body
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for i in t:
                if i.isfile() and fits(i.name, i.size):
                    body = t.extractfile(i).read()
                    total, n = total + len(body), n + 1
                    yield i.name, body
    except tarfile.TarError:
        return


def read_archives(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per file of each archive: archive, name, size, content."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["p"], pdf["c"], strict=True):
                try:
                    for member, body in archive_members(name, bytes(raw)):
                        yield pd.DataFrame({"archive": [name], "name": [member], "size": [len(body)], "content": [body]})
                except (zipfile.BadZipFile, EOFError, OSError):
                    continue

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(task, "archive string, name string, size long, content binary")


LOG = "array<struct<index:int,url:string,method:string,resource_type:string,status:int,content_type:string,timestamp:double,doc_seq:int>>"


def network_log(files: DataFrame, text: str = "text") -> DataFrame:
    """Rows of request logs given as JSON text, one per request; malformed logs give none."""
    return files.withColumn("_log", F.from_json(text, LOG)).select(*files.columns, F.inline("_log")).drop(text)


def network_iocs(log: DataFrame, key: str, source_url: str, services: Sequence[str] = lookups.SERVICES) -> DataFrame:
    """Hosts (domain, 85) and sending endpoints (c2_url: 90 for sockets, 80 for POST, PUT, PATCH) outside the page's own root and known services."""
    h = urls.host(F.col("url"))
    other = log.filter(h.isNotNull() & ~urls.root_domain(h).eqNullSafe(urls.root_domain(urls.host(F.col(source_url)))) & ~hosts.among(urls.root_domain(h), services))
    seen = other.select(key, F.lit("domain").alias("type"), h.alias("value"), F.lit(85).alias("confidence")).distinct()
    socket = F.col("url").rlike("(?i)^wss?://") | (F.col("resource_type") == "websocket")
    sends = other.filter(socket | F.upper("method").isin("POST", "PUT", "PATCH"))
    ends = sends.select(key, F.lit("c2_url").alias("type"), F.col("url").alias("value"), F.when(socket, 90).otherwise(80).alias("confidence")).distinct()
    return seen.unionByName(ends)


def stage_bounds(stages: DataFrame, key: str) -> DataFrame:
    """Each stage's [lo, hi): up to the next one's start, the last without end."""
    from pyspark.sql import Window

    after = F.lead("started_ts").over(Window.partitionBy(key).orderBy("seq"))
    return stages.withColumn("lo", F.col("started_ts")).withColumn("hi", F.greatest("lo", F.coalesce(after, F.lit(float("inf")))))


# Sharing patterns by indicator type.
STIX = {
    "email": "[email-addr:value = '{}']", "ip": "[ipv4-addr:value = '{}']", "domain": "[domain-name:value = '{}']", "c2_url": "[url:value = '{}']", "source_url": "[url:value = '{}']",
    "telegram_bot_token": "[x-telegram:bot_token = '{}']", "phone": "[x-phone:value = '{}']", "crypto_wallet": "[x-crypto-wallet:address = '{}']",
}


def stix_indicator(kind: Column, value: Column, confidence: Column, created: Column) -> Column:
    """An indicator object of STIX 2.1 as JSON; the id follows from type and value, so exports repeat."""
    quoted = F.regexp_replace(value, r"(['\\])", r"\\$1")
    pattern = F.lit(None).cast("string")
    for k, p in STIX.items():
        left, right = p.split("{}")
        pattern = F.when(kind == k, F.concat(F.lit(left), quoted, F.lit(right))).otherwise(pattern)
    digest = F.sha1(F.concat_ws("|", F.lit(str(uuid.NAMESPACE_URL)), kind, value))
    sid = F.concat(F.lit("indicator--"), F.regexp_replace(F.substring(digest, 1, 32), r"^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5"))
    at = F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.to_json(F.struct(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), sid.alias("id"), at.alias("created"), at.alias("modified"), at.alias("valid_from"), pattern.alias("pattern"), F.lit("stix").alias("pattern_type"), confidence.alias("confidence")))
