"""Operator 5: WARC archives and transaction assembly.

``write_archives`` writes a request, a response (or revisit) and a metadata
record for every page; ``read_records`` parses archives; ``assemble`` joins
records through their concurrent-to identifiers into one nested row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Records end with two line ends; the sink writes them as its line separator.
BETWEEN = CRLF + CRLF

RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
          "content_type string, http_status int, payload_digest string, payload_bytes long, payload binary, "
          "fields map<string,string>")


def _uuid(*parts: Column | str) -> Column:
    """A record identifier made from the md5 of ``parts``."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) if isinstance(p, Column) else F.lit(p)
                                    for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in (
        (1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Text of one record, without the line ends that close it; headers of null
    value are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{CRLF}{k}: "), v)) for k, v in headers]
    return F.concat(F.lit("WARC/1.1"), *[F.coalesce(x, F.lit("")) for x in lines],
                    F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(BETWEEN), block)


def roles(pages: DataFrame, least: int = 100) -> DataFrame:
    """``(page_id, digest, first)`` of the pages that revisit another: payloads
    of ``least`` bytes or more, first seen at the smaller page_id ``first``."""
    meta = pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n"))
    meta = meta.where((F.col("n") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = meta.groupBy("digest").agg(F.min("page_id").alias("first"))
    return meta.join(first, "digest").where("page_id != first").distinct()


def write_archives(pages: DataFrame, path: str, least: int = 100, archive_bytes: int = 16 << 20,
                   date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> None:
    """Write the pages as gzip archives of about ``archive_bytes`` (before
    compression) under ``path``.

    The payload is the html in UTF-8.  Of equal payloads of at least ``least``
    bytes, the one of the smallest id is a response, the others are revisits
    that refer to it and carry no payload.  Rows are dealt to archives by a hash
    of id and digest, the only shuffle of payloads; a payload that a third of
    the pages share only meets itself as a pre-aggregated digest.

    A null html is an empty payload.  A null url gives no target URI.  Rows of a
    null id are responses and are not referred to.  Rows repeated with equal id
    and payload are stored each; if theirs is the smallest id, each is a
    response.  Other columns are not read; an empty table writes no record.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                     F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    total = p.agg(F.sum(F.octet_length("payload").cast("long") + 1500)).first()[0] or 0
    n = max(1, math.ceil(total / archive_bytes))
    own = p.withColumn("digest", F.sha2("payload", 256)).repartition(n, "page_id", "digest")
    revisits = roles(p, least).repartition(n, "page_id", "digest")
    p = own.join(revisits, (own["page_id"] == revisits["page_id"]) & (own["digest"] == revisits["digest"]),
                 "left").select(own["page_id"], "url", "payload", own["digest"], "first")
    seen, digest, when = F.col("first").isNotNull(), F.concat(F.lit("sha256:"), F.col("digest")), F.lit(date)
    response_id = _uuid("capture", F.col("page_id"), F.col("digest"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(BETWEEN))
    body = F.when(seen, F.lit("")).otherwise(F.col("payload").cast("string"))
    uri = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    response = _record([
        ("WARC-Type", F.when(seen, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", response_id),
        ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest),
        ("WARC-Profile", F.when(seen, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(seen, _uuid("capture", F.col("first"), F.col("digest")))),
        ("Content-Type", F.lit("application/http;msgtype=response"))], F.concat(head, body))
    request = _record([
        ("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid("request", F.col("page_id"), F.col("digest"))),
        ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", response_id),
        ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{BETWEEN}")))
    metadata = _record([
        ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid("metadata", F.col("page_id"), F.col("digest"))),
        ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", response_id),
        ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")))
    p.select(F.concat_ws(BETWEEN, request, response, metadata)).write.option("lineSep", BETWEEN).option(
        "compression", "gzip").text(path)


def _parse(data: bytes, with_payload: bool) -> Iterator[tuple]:
    """Records of one archive, block lengths taken from Content-Length."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin, size = end + 4, int(h["content-length"])
        if begin + size > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        block, at = view[begin:begin + size], begin + size + 4
        status, payload, fields, kind = None, block, {}, h.get("content-type", "")
        if kind.startswith("application/http"):
            cut = data.find(b"\r\n\r\n", begin, begin + size)
            payload = view[cut + 4:begin + size] if cut >= 0 else view[begin:begin]
            words = bytes(block[:64]).split(b"\r\n", 1)[0].split(b" ")
            status = int(words[1]) if words[0].startswith(b"HTTP/") and len(words) > 1 else None
        elif kind.startswith("application/warc-fields"):
            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in bytes(block).decode().split(CRLF) if x)}
        kind_of = h["warc-type"]
        digest, n = h.get("warc-payload-digest"), None
        if kind_of == "response":
            n, digest = len(payload), "sha256:" + hashlib.sha256(payload).hexdigest()
            if h.get("warc-payload-digest", digest) != digest and h["warc-payload-digest"].startswith("sha256:"):
                raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
        yield (h["warc-record-id"], kind_of, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"),
               h.get("warc-date"), h.get("content-type"), status, digest, n,
               bytes(payload) if with_payload and kind_of == "response" else None, fields)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives under ``path`` (gzip or plain, each
    within a task's memory: the writer bounds them).  Payload lengths and
    digests of responses are computed from the bytes read and checked."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows: list[tuple] = []
                for r in _parse(data, with_payload):
                    rows.append(r)
                    if len(rows) == 1000:
                        yield _frame(rows, names)
                        rows = []
                yield _frame(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(parse, RECORD)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=names)
    return f.astype({"http_status": "Int32", "payload_bytes": "Int64"})


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``(capture_id, copies, response, request,
    metadata)``.

    A capture is a response or revisit record.  A request or metadata record
    belongs to it when either one names the other in its concurrent-to; of
    several, the one of the smallest record id is taken.  A revisit gets its
    payload's length from the response it refers to (null if that is missing).
    Records that name no capture are left out; captures without request or
    metadata have null there.  Records stored more than once are one row with
    their number in ``copies``.  An empty table gives no rows.

    All joins are on record identifiers, each side unique on it.
    """
    def one(df: DataFrame, *keys: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        low = F.min_by(F.struct(*rest), F.col("record_id")) if "record_id" in rest else F.first(F.struct(*rest))
        return df.groupBy(*keys).agg(low.alias("r"), F.count(F.lit(1)).alias("copies"))

    keep = ["type", "concurrent_to", "refers_to", "target_uri", "date", "content_type", "http_status",
            "payload_digest", "payload_bytes", "payload"]
    captures = one(records.where("type in ('response', 'revisit')").select("record_id", *keep), "record_id")
    captures = captures.select(F.col("record_id").alias("capture_id"), "copies", "r.*")
    names = captures.where("concurrent_to is not null").select("capture_id", F.col("concurrent_to").alias("record_id"))

    def beside(kind: str, block: list[str]) -> DataFrame:
        own = records.where(F.col("type") == kind).select("record_id", "concurrent_to", "target_uri", "date", *block)
        body = F.struct("target_uri", "date", *block).alias("body")
        by_own = own.select(F.col("concurrent_to").alias("capture_id"), "record_id", body)
        by_capture = own.select("record_id", body).join(names, "record_id").select("capture_id", "record_id", "body")
        both = one(by_own.where("capture_id is not null").unionByName(by_capture), "capture_id")
        return both.select("capture_id", F.struct("r.record_id", "r.body.*").alias(kind))

    first = captures.where("type = 'response'").select(F.col("capture_id").alias("refers_to"),
                                                       F.col("payload_bytes").alias("first_bytes"))
    out = captures.join(first, "refers_to", "left").withColumn(
        "payload_bytes", F.coalesce("payload_bytes", "first_bytes"))
    out = out.select("capture_id", "copies", F.struct(*keep).alias("response"))
    return out.join(beside("request", ["content_type"]), "capture_id", "left").join(
        beside("metadata", ["fields"]), "capture_id", "left")
