"""WARC captures: records read from and written to WARC files, and not-modified revisits resolved.

A revisit that says "not modified" holds headers but no body. It is resolved by an as-of join: the latest earlier
full response of the same canonical URL, if its validators agree, gives the body, and the response's headers are
updated by those of the revisit that may replace them.

Scale. The join moves captures without bodies. They are range-partitioned by URL, time and record id, so that a URL with a
third of all captures lies in many parts, in order; within a part a window finds the latest response, and a table with the
last response of each URL and part gives what comes from the parts before.

Files are read record by record from what is decompressed as it is needed. A record whose length is missing or no number is passed
over up to the next line that begins a record; what is cut off at a file's end, or follows damage in its compression, is left out.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import bounded_batches, stored

#: Fixed values, by RFC 9111 4.3.4 and RFC 9110: a 304's fields replace the stored ones, but not those that describe the body
#: as sent or the connection.
NOT_MERGED = ("content-length", "content-encoding", "content-type", "content-range", "content-md5", "content-digest", "transfer-encoding", "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "upgrade", "set-cookie")
#: Query parameters that do not name another resource.
TRACKING = r"(utm_[a-z]+|fbclid|gclid|ref|sessionid|phpsessionid)"
CAPTURE = "record_id string, type string, url string, ts timestamp, status int, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Scheme and www. go, host in lower case without default ports, no fragment, no tracking parameters, the others in order,
    no / at the end. Null stays null."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    plain = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    head, query = F.regexp_extract(plain, r"^([^?]*)", 1), F.regexp_extract(plain, r"^[^?]*\?(.*)$", 1)
    host, path = F.lower(F.regexp_extract(head, "^([^/]*)", 1)), F.regexp_replace(F.regexp_extract(head, "^[^/]*(.*)$", 1), "/+$", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^{TRACKING}(=|$)")))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _plain_tag(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(captures: DataFrame, parts: int | None = None) -> DataFrame:
    """captures: record_id, url, ts, type (response, revisit or any other), status, headers (map, lower-case names); more columns
    are left out. Returns a row for each capture: record_id, canonical, ts, type, resolution, refers_to, headers.

    A full response is a response of status 200; a revisit is one of type revisit or status 304. Earlier means a smaller
    (ts, record_id), nulls first. resolution: full; resolved (refers_to is the response's record_id, headers are merged);
    validator_mismatch (the latest earlier response has another ETag or, where an ETag is missing, another
    Last-Modified; refers_to says which); no_validator (nothing to compare); no_earlier; other (neither full nor revisit).
    Null URLs are never joined. Repeated records each get a row.
    """
    narrow = captures.select("record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "type", "status", "headers")
    full = (F.col("type") == "response") & (F.coalesce(F.col("status"), F.lit(200)) == 200)
    revisit = (F.col("type") == "revisit") | (F.col("status") == 304)
    narrow = narrow.withColumn("kind", F.when(F.col("canonical").isNull(), "other").when(revisit, "revisit").when(full, "full").otherwise("other"))
    order = ["canonical", "ts", "record_id"]
    dealt = narrow.repartitionByRange(parts, *order) if parts else narrow.repartitionByRange(*order)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()), "captures")
    response = F.when(F.col("kind") == "full", F.struct("record_id", "headers"))
    within = Window.partitionBy("canonical", "part").orderBy("ts", "record_id")
    last = dealt.where("kind = 'full'").groupBy("canonical", "part").agg(F.max_by(F.struct("record_id", "headers"), F.struct("ts", "record_id")).alias("last"))
    spread = dealt.groupBy("canonical").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    # only URLs in several parts: one row for each part they are in
    held = dealt.join(spread.select("canonical"), "canonical", "left_semi").select("canonical", "part").distinct().join(last, ["canonical", "part"], "left")
    carry = held.withColumn("carried", F.last("last", ignorenulls=True).over(Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("carried is not null")
    carry = stored(carry.select("canonical", "part", "carried"), "carry")
    own = dealt.withColumn("base", F.last(response, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    found = own.join(carry, ["canonical", "part"], "left").withColumn("base", F.coalesce("base", "carried"))
    tag, base_tag = _plain_tag(F.col("headers")["etag"]), _plain_tag(F.col("base.headers")["etag"])
    time, base_time = F.trim(F.col("headers")["last-modified"]), F.trim(F.col("base.headers")["last-modified"])
    agrees = F.coalesce(tag == base_tag, time == base_time)
    resolution = F.when(F.col("kind") != "revisit", F.col("kind")).when(F.col("base").isNull(), "no_earlier").when(agrees.isNull(), "no_validator").when(agrees, "resolved").otherwise("validator_mismatch")
    may = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*NOT_MERGED))
    stays = F.map_filter(F.coalesce("base.headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(may, k))
    out = found.withColumn("resolution", resolution)
    return out.select("record_id", "canonical", "ts", "type", "resolution", F.when(F.col("resolution").isin("resolved", "validator_mismatch"), F.col("base.record_id")).alias("refers_to"), F.when(F.col("resolution") == "resolved", F.map_concat(stays, may)).otherwise(F.col("headers")).alias("headers"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Captures as a crawl of the pages table would have made them: each page's full response, and a conditional request for the
    same URL three hours later that the server answers with 304. Times follow page_id. Its ETag is that of this page, so it does not fit where another page of the same canonical URL came between."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.lit('"'))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.col("page_id"), F.lit(0)) * 60)
    # as text without a time zone, so the session's does not matter
    date = lambda later: (F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_interval(secs=F.lit(1_700_000_000 + later) + F.coalesce(F.col("page_id"), F.lit(0)) * 60)).cast("string")
    kind = lambda name, status, shift, headers: F.struct(F.concat(F.lit(f"{name}-"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"), F.lit(name).alias("type"), (at + F.make_interval(secs=F.lit(shift))).alias("ts"), F.lit(status).alias("status"), headers.alias("headers"))
    first = kind("response", 200, 0, F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), date(0)))
    second = kind("revisit", 304, 10800, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("content-type"), F.lit("text/plain"), F.lit("date"), date(10800)))
    return pages.select("url", F.explode(F.array(first, second)).alias("c")).select("c.*", "url")


def write_record(record_type: str, url: str, date: str, headers: list[tuple[str, str]], block: bytes, record_id: str) -> bytes:
    """One gzip member with a WARC/1.1 record."""
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", url), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", mtime=0)


#: Bytes that are decompressed at once, and bytes of records that a task holds before it gives them away.
CHUNK, HELD = 1 << 15, 8 << 20


class _Member(io.RawIOBase):
    """One gzip member of a file's bytes, decompressed as it is read. `at` is then where the next one begins."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.unzip, self.ready, self.damaged = data, at, zlib.decompressobj(31), memoryview(b""), False

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not len(self.ready):
            if self.unzip.eof or self.damaged:
                return 0
            piece = self.data[self.at : self.at + CHUNK]
            try:
                self.ready = memoryview(self.unzip.decompress(piece))
            except zlib.error:
                self.damaged = True
            self.damaged |= not len(piece)
            self.at += len(piece) - len(self.unzip.unused_data)
        n = min(len(out), len(self.ready))
        out[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of a WARC file, plain or gzipped (a record lies in one member)."""
    if data[:2] != b"\x1f\x8b":
        yield from _records(io.BytesIO(data))
        return
    at, whole = 0, memoryview(data)
    while at < len(whole):
        member = _Member(whole, at)
        stream = io.BufferedReader(member, CHUNK)
        yield from _records(stream)
        while stream.read(CHUNK):
            pass
        if member.damaged:
            return
        at = member.at


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline(CHUNK):
        if not line.startswith(b"WARC/"):
            continue
        fields = dict(reversed(_fields(stream)))  # of repeated ones the first
        size = fields.get("content-length", "")
        if not re.fullmatch("[0-9]{1,15}", size):
            continue
        parts, left = [], int(size)
        while left and (part := stream.read(min(left, CHUNK))):
            parts.append(part)
            left -= len(part)
        if not left:
            yield fields, b"".join(parts)


def _fields(stream) -> list[tuple[str, str]]:
    """(lower-case name, value) in order; a line that begins with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    while (line := stream.readline(CHUNK)) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def combined(fields: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """One field for each name: values of repeated ones joined by a comma (RFC 9110 5.3), those of set-cookie, which may not
    be, by a line feed."""
    out: dict[str, list[str]] = {}
    for name, value in fields:
        out.setdefault(name, []).append(value)
    return [(name, ("\n" if name == "set-cookie" else ", ").join(values)) for name, values in out.items()]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The CAPTURE rows of WARC files (one task reads a file, whose bytes it holds; files are split by who writes them, at about
    1 GB). HTTP headers have lower-case names, repeated ones are combined; payload is the HTTP body as sent."""

    def parse(batches):
        kinds = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for fields, block in records_of(content.as_py()):
                    status, headers, body = None, [], block
                    if block.startswith(b"HTTP/"):
                        stream = io.BytesIO(block)
                        m = re.match(rb"HTTP/\S+\s+(\d{3})", stream.readline())
                        status, headers = int(m[1]) if m else None, combined(_fields(stream))
                        body = stream.read()
                    rows.append({"record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "url": fields.get("warc-target-uri", "").strip("<>") or None, "date": fields.get("warc-date"), "status": status, "headers": headers, "payload": body})
                    held += len(body)
                    if held > HELD:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    bounded_batches(spark)
    raw = spark.read.format("binaryFile").load(path).select("content")
    return raw.mapInArrow(parse, "record_id string, type string, url string, date string, status int, headers map<string,string>, payload binary").withColumn("ts", F.try_to_timestamp("date")).select("record_id", "type", "url", "ts", "status", "headers", "payload")
