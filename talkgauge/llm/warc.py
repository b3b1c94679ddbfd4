"""Web archive records: resolving not-modified revisits.

A revisit with status 304 holds no body: it says that a URL has not changed since an earlier capture. It is
resolved to the latest full response with the same canonical URL that is strictly earlier. The validators
decide whether the two belong together (ETag by weak comparison, else Last-Modified), and the response's
headers are updated by those of the revisit that RFC 9111 (section 3.2) lets a 304 update.

The as-of join is two-level, so that a URL with very many captures is not one task's work: its times, once
records of one time are counted together on the map side, are cut
into buckets; the latest response before a bucket comes from the buckets' aggregates, and the latest
one inside it from a window over the bucket's times. Bodies never travel; only their digests do.

Null URLs and null times resolve to nothing. Records of one time are not earlier than each other; of several responses
with the latest time, the one with the greatest record id is taken. Null headers count as none. Rows that repeat a
record are resolved each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgauge.llm.common import mapped

#: Seconds in a time bucket.
BUCKET = 3600

# Headers that describe the stored body or one connection, and that a 304 must not update.
KEPT_HEADERS = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authentication-info",
    "proxy-authorization",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
# Query parameters that name a visitor or a campaign, not a page.
IDLE_PARAMETERS = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid|sid|phpsessid|jsessionid)(=|$)"

HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Scheme, user, www., default port and fragment dropped; host in lower case; idle parameters dropped, others sorted; no slash at the end."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(plain, r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www[0-9]*\.)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(IDLE_PARAMETERS))
    return F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(asked), "&"))).otherwise(""))


def header(headers: Column, name: str) -> Column:
    """The first value of a header; names are in lower case."""
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers, with those replaced or added that the update may change; by name."""
    allowed = F.filter(update, lambda h: ~h["name"].isin(*KEPT_HEADERS))
    names = F.transform(allowed, lambda h: h["name"])
    return F.array_sort(F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"])), allowed))


def resolve_revisits(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per revisit (status 304) of ``records``: record_id, canonical_url, ts, refers_to, refers_ts, digest, validator, headers.

    ``records`` has record_id (long), url, ts (timestamp), status (int), digest and headers (array of lower-cased
    name and value). validator is etag or last-modified if these agree, mismatch if they don't, absent if the
    two records share none, and unresolved if there is no earlier full response; headers and digest are those
    of the resolved capture, and null for a mismatch or an unresolved revisit (whose own headers are not a page's).
    """
    rows = records.filter(F.col("status").isin(200, 304)).select(
        "record_id",
        canonical_url(F.col("url")).alias("canonical_url"),
        F.unix_micros("ts").alias("at"),
        (F.col("status") == 200).alias("full"),
        "digest",
        F.coalesce(F.col("headers"), F.array().cast(HEADERS)).cast(HEADERS).alias("headers"),
    )
    capture = F.when(F.col("full"), F.struct("at", "record_id", "digest", "headers"))
    placed = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    times = rows.filter(placed).groupBy("canonical_url", "at").agg(F.max(capture).alias("latest"), F.bool_or(~F.col("full")).alias("asked"))
    times = times.withColumn("bucket", F.floor(F.col("at") / (bucket * 1_000_000)))
    inside = F.max("latest").over(W.partitionBy("canonical_url", "bucket").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    times = times.withColumn("inside", inside)
    per_bucket = times.groupBy("canonical_url", "bucket").agg(F.max("latest").alias("latest"))
    earlier = F.max("latest").over(W.partitionBy("canonical_url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    before = per_bucket.select(F.col("canonical_url").alias("of"), F.col("bucket").alias("in"), earlier.alias("before"))
    found = times.filter("asked").join(before, (F.col("canonical_url") == F.col("of")) & (F.col("bucket") == F.col("in")))
    found = found.select(F.col("canonical_url").alias("of"), F.col("at").alias("then"), F.coalesce("inside", "before").alias("source"))
    asked = rows.filter(~F.col("full"))
    joined = asked.join(found, (F.col("canonical_url") == F.col("of")) & (F.col("at") == F.col("then")), "left")
    tag = lambda h: F.regexp_replace(header(h, "etag"), "^W/", "")
    old, new = F.col("source.headers"), F.col("headers")
    etags = tag(old).isNotNull() & tag(new).isNotNull()
    dates = header(old, "last-modified").isNotNull() & header(new, "last-modified").isNotNull()
    validator = (
        F.when(F.col("source").isNull(), "unresolved")
        .when(etags, F.when(tag(old) == tag(new), "etag").otherwise("mismatch"))
        .when(dates, F.when(header(old, "last-modified") == header(new, "last-modified"), "last-modified").otherwise("mismatch"))
        .otherwise("absent")
    )
    joined = joined.withColumn("validator", validator)
    good = F.col("validator").isin("etag", "last-modified", "absent")
    return joined.select(
        "record_id",
        "canonical_url",
        F.timestamp_micros("at").alias("ts"),
        F.col("source.record_id").alias("refers_to"),
        F.timestamp_micros("source.at").alias("refers_ts"),
        F.when(good, F.col("source.digest")).alias("digest"),
        "validator",
        F.when(good, merged_headers(old, new)).alias("headers"),
    )


def _http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """(status, headers with lower-cased names, body) of an HTTP response; no status if it is none."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    status = first.split(" ", 2)[1:2] if first.startswith("HTTP/") else []
    pairs = [line.partition(":") for line in lines if ":" in line]
    return int(status[0]) if status and status[0].isdigit() else None, [(k.strip().lower(), v.strip()) for k, _, v in pairs], body


def _unpacked(content: bytes) -> bytes:
    """The members of a gzip file one after the other, as far as they go; plain bytes as they are."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, at, view, member = [], 0, memoryview(content), zlib.decompressobj(31)
    try:
        while at < len(view):
            chunk = view[at : at + (1 << 16)]
            out.append(member.decompress(chunk))
            at += len(chunk) - len(member.unused_data)
            if member.eof:
                member = zlib.decompressobj(31)
    except zlib.error:
        pass
    return b"".join(out)


def parse_warc(content: bytes):
    """(id, url, date, status, digest, headers) of the responses and revisits in a WARC file, plain or compressed record by record.

    A file that breaks off yields the records before.
    """
    raw = _unpacked(content)
    at = 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            return
        named = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]))
        size = int(named["content-length"]) if named.get("content-length", "").isdigit() else 0
        block, at = raw[end + 4 : end + 4 + size], end + 4 + size
        if len(block) < size:
            return
        kind = named.get("warc-type")
        if kind in ("response", "revisit"):
            status, headers, body = _http(block)
            revisit = kind == "revisit" and (status == 304 or named.get("warc-profile", "").endswith("server-not-modified"))
            digest = named.get("warc-payload-digest") or f"sha1:{hashlib.sha1(body).hexdigest()}"
            yield named.get("warc-record-id"), named.get("warc-target-uri", "").strip("<>") or None, named.get("warc-date"), 304 if revisit else status, None if revisit else digest, headers


def read_warc(spark, path: str) -> DataFrame:
    """The records of WARC files (a folder, file or pattern) as ``resolve_revisits`` takes them; record_id is a hash of the record's own id.

    A file is one task's work and is held in memory, as its records are compressed one after the other; it may have 2 GB.
    """
    columns = "id string, url string, date string, status int, digest string, headers " + HEADERS

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))]
        for b in batches:
            for content in b.column(0):
                rows = []
                for *plain, headers in parse_warc(content.as_py()):
                    rows.append((*plain, [{"name": k, "value": v} for k, v in headers]))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in columns.split(", ")])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in columns.split(", ")])

    found = mapped(spark.read.format("binaryFile").load(path).select("content"), run, columns)
    return found.select(F.xxhash64("id").alias("record_id"), "url", F.try_to_timestamp("date").alias("ts"), "status", "digest", "headers")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two records per page: its capture, and a revisit twelve hours later that names the page's own validator.

    Pages are captured a minute apart in the order of their ids, so a URL's later revisit can follow another
    capture of the same URL. The 304 carries a new date and caching rule, and a length that must not be merged.
    """
    pages = pages.withColumn("html", F.coalesce("html", F.lit("")))
    begin = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 60)
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    size = F.octet_length("html")
    first = F.struct(
        (F.col("page_id") * 2).alias("record_id"),
        begin.alias("ts"),
        F.lit(200).alias("status"),
        F.sha1("html").alias("digest"),
        F.array(pair("cache-control", F.lit("max-age=60")), pair("content-length", size), pair("content-type", F.lit("text/html; charset=utf-8")), pair("etag", tag)).alias("headers"),
    )
    again = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        (begin + F.expr("INTERVAL 12 HOURS")).alias("ts"),
        F.lit(304).alias("status"),
        F.lit(None).cast("string").alias("digest"),
        F.array(pair("age", F.lit("0")), pair("cache-control", F.lit("max-age=3600")), pair("content-length", F.lit("0")), pair("etag", F.concat(F.lit("W/"), tag))).alias("headers"),
    )
    return pages.select("url", F.inline(F.array(first, again)))
