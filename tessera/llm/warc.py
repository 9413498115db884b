"""WARC records: parsing, writing, and resolving not-modified revisits.

A revisit record says that a page had not changed since an earlier capture and carries no body. Resolution
is an as-of join: the revisit's canonical URL is looked up among the full responses, and the latest one before
the revisit's time is taken (of equal times the one with the larger record id). Its validators are checked
against the revisit's (ETag first, then Last-Modified, then the payload digest; weak ETags compare without
their ``W/``). If they agree, the revisit takes over the response's status and body, and the headers of both
are merged: fields that a 304 answer may update come from the revisit, all others from the response.

The as-of join scales with one URL that holds any share of the captures: time is cut into slices of a bounded
number of captures for each URL; each slice's last response is found by aggregation and carried forward over
slices, so that no window runs over all captures of a URL.

Nulls: records without a URL or a time are returned unresolved. An unparsable URL is its own canonical form.
Rows that repeat a record id are resolved one by one. Extra columns are kept by resolve_revisits(), but
those named as one that it adds. An empty table gives no rows. WARC files that end early give
their whole records only; a record's body is held whole, a file never.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Captures of one URL in a time slice, at most about.
SLICE = 1000
#: Bytes read at once, and inflated at once; records and bytes of bodies in a frame.
CHUNK, INFLATED, ROWS, BYTES = 1 << 16, 1 << 22, 1000, 1 << 25
#: Header fields that a not-modified answer may update (fixed list).
UPDATABLE = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning"]
#: Query parameters that do not identify a page (fixed pattern).
TRACKING = r"(?i)(?<=[?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*(?:&|$)"

RECORD = "record_id string, record_type string, url string, captured_at timestamp, status int, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Scheme and ``www.`` dropped, host in lower case without default port, no fragment, no tracking parameters, no slash or ``.html`` at the end."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    split = r"^(?i)(?:https?://)(?:[^/?@]*@)?(?:www\.)?([^/?:]+)(?::(?:80|443)(?=[/?]|$))?(.*)$"
    host, rest = F.lower(F.regexp_extract(bare, split, 1)), F.regexp_extract(bare, split, 2)
    clean = F.regexp_replace(F.regexp_replace(rest, TRACKING, ""), r"[?&]+$", "")
    path, query = F.regexp_extract(clean, r"^([^?]*)", 1), F.regexp_extract(clean, r"(\?.*)$", 1)
    return F.when(host == "", bare).otherwise(F.concat(host, F.regexp_replace(path, r"(?:\.html?|/)+$", ""), query))


def _inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, or of a plain file, chunk by chunk; a broken member ends it."""
    chunks, start = iter(chunks), b""
    while len(start) < 2 and (raw := next(chunks, None)) is not None:
        start += raw
    if start[:2] != b"\x1f\x8b":
        yield start
        yield from chunks
        return
    member = zlib.decompressobj(31)
    for raw in chain([start], chunks):
        while raw:
            if member.eof:
                member = zlib.decompressobj(31)
            try:
                # No more than INFLATED comes out of a step, whatever a member holds.
                yield member.decompress(raw, INFLATED)
            except zlib.error:
                return
            raw = member.unconsumed_tail or member.unused_data
    if not member.eof:
        yield member.flush()


class _Reader:
    """Reads from chunks of bytes, holding no more than was asked for and the chunk it ended in."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at = chunks, bytearray(), 0

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        del self.held[: self.at]
        self.at = 0
        self.held += chunk
        return True

    def until(self, mark: bytes) -> bytes | None:
        """All up to ``mark``, which is skipped; None if it does not come."""
        seen = 0
        while (end := self.held.find(mark, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.held[self.at : end])
        self.at = end + len(mark)
        return out

    def exactly(self, size: int) -> bytes | None:
        if size <= len(self.held) - self.at:
            out = bytes(self.held[self.at : self.at + size])
            self.at += size
            return out
        parts, missing = [bytes(self.held[self.at :])], size - (len(self.held) - self.at)
        self.at = len(self.held)
        while missing > 0:
            if not self._more():
                return None
            parts.append(bytes(self.held[:missing]))
            self.at = len(parts[-1])
            missing -= self.at
        return b"".join(parts)


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in block.split(b"\r\n") if b":" in line)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, v in pairs}


def parse(chunks: Iterable[bytes]) -> Iterator[tuple]:
    """The records of a WARC file, given as bytes or chunk by chunk, as rows of RECORD."""
    reader = _Reader(_inflated([chunks] if isinstance(chunks, bytes) else chunks))
    while reader.until(b"WARC/") is not None and (block := reader.until(b"\r\n\r\n")) is not None:
        head = _fields(block)
        length = head.get("content-length", "")
        body = reader.exactly(int(length) if length.isdigit() else 0)
        if body is None:
            return
        status, headers, payload = None, {}, body
        if body[:5] == b"HTTP/":
            http, _, payload = body.partition(b"\r\n\r\n")
            line, _, rest = http.partition(b"\r\n")
            word = line.split(b" ")
            status, headers = (int(word[1]) if len(word) > 1 and word[1].isdigit() else None), _fields(rest)
        yield head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), _instant(head.get("warc-date")), status, headers, payload


def _instant(text: str | None) -> datetime | None:
    try:
        when = datetime.fromisoformat(text or "")
    except ValueError:
        return None
    return when.astimezone(UTC).replace(tzinfo=None) if when.tzinfo else when


def _rows(records: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Frames of records, each closed at ROWS records or BYTES of bodies."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"status": "Int32", "captured_at": "datetime64[us]"})
    held, size = [], 0
    for row in records:
        held.append(row)
        size += len(row[-1])
        if len(held) >= ROWS or size >= BYTES:
            yield frame(held)
            held, size = [], 0
    if held:
        yield frame(held)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files under a path, one file a task; compressed or not.

    A file that pyarrow's filesystems reach (local folders, HDFS, S3, GCS) is opened in its task and streamed, so that
    neither it nor its content is ever held whole. Other filesystems are read by Spark, one whole file at a time.
    """
    listed = spark.read.format("binaryFile").load(path).select("path")  # the path alone: no content is read
    names = [r["path"] for r in listed.collect()]  # one row a file
    streamed = all(re.match(r"(?:file|hdfs|s3|s3a|gs):", n) for n in names)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for name in batch["path"]:
                system, inner = fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "file:///", name)))
                with system.open_input_stream(inner, compression=None) as file:
                    yield from _rows(parse(iter(lambda: file.read(CHUNK), b"")))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                yield from _rows(parse(memoryview(raw)[at : at + CHUNK].tobytes() for at in range(0, len(raw), CHUNK)))

    if streamed and names:
        files = spark.createDataFrame([(n,) for n in names], "path string").repartition(len(names), "path")
        return files.mapInPandas(stream, RECORD)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(whole, RECORD)


def record_bytes(record_id: str, record_type: str, url: str, date: str, status: int | None, headers: dict, payload: bytes) -> bytes:
    """One gzip member; what parse() reads back."""
    http = f"HTTP/1.1 {status or 0} -\r\n" + "".join(f"{k}: {v}\r\n" for k, v in sorted(headers.items())) + "\r\n"
    body = http.encode("latin-1", "replace") + (payload or b"")
    head = f"WARC/1.1\r\nWARC-Type: {record_type}\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", mtime=0)


def latest_before(captures: DataFrame, scratch: Scratch, slice_size: int = SLICE) -> DataFrame:
    """``captures`` with ``prior``: the row_id-carrying struct of the latest earlier full response of the same ``key``.

    ``captures`` has key, at (long), tie, full (boolean) and info (a struct). Slices of a key are equal parts of
    its time span, as many as its captures need.
    """
    spans = captures.groupBy("key").agg(F.min("at").alias("from"), F.max("at").alias("to"), F.ceil(F.count(F.lit(1)) / slice_size).alias("n_slices"))
    spans = scratch.keep(spans.where("n_slices > 1"), "spans")  # most keys are one slice and need no row here
    width = F.greatest(F.ceil((F.col("to") - F.col("from") + 1) / F.col("n_slices")), F.lit(1))
    sliced = captures.join(spans, "key", "left").withColumn("slice", F.coalesce(F.floor((F.col("at") - F.col("from")) / width), F.lit(0)).cast("long")).drop("from", "to", "n_slices")
    sliced = scratch.keep(sliced, "sliced")
    full = F.when(F.col("full"), F.struct("at", "tie", "info"))
    in_slice = Window.partitionBy("key", "slice").orderBy("at", F.col("full").cast("int"), "tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = sliced.withColumn("inside", F.last(F.when(F.col("full"), F.struct("at", "tie", "info")), ignorenulls=True).over(in_slice))
    ends = sliced.groupBy("key", "slice").agg(F.max(full).alias("end")).join(spans.select("key"), "key", "left_semi")
    over_slices = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = scratch.keep(ends.select("key", "slice", F.last("end", ignorenulls=True).over(over_slices).alias("carried")), "carried")
    return inside.join(carried, ["key", "slice"], "left").withColumn("prior", F.coalesce("inside", "carried")).drop("inside", "carried", "slice")


def _etag(headers: str) -> Column:
    return F.regexp_replace(F.element_at(headers, F.lit("etag")), r"^W/", "")


def validators_agree(mine: str, prior: str, my_digest: Column, prior_digest: Column) -> Column:
    """The first validator that both sides carry decides; without any there is no agreement."""
    modified = lambda h: F.element_at(h, F.lit("last-modified"))
    return F.coalesce(_etag(mine) == _etag(prior), modified(mine) == modified(prior), my_digest == prior_digest, F.lit(False))


def merged_headers(mine: str, prior: str) -> Column:
    updates = F.map_filter(mine, lambda k, v: k.isin(UPDATABLE))
    rest = F.map_filter(prior, lambda k, v: ~F.map_contains_key(updates, k))
    return F.map_concat(rest, updates)


#: What resolution adds.
RESOLVED = ["canonical_url", "resolution", "source_id", "final_status", "final_headers", "final_digest"]


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` (RECORD columns without the payload, and ``payload_digest``) with canonical_url, resolution, source_id, final_status, final_headers, final_digest.

    resolution: ``response`` (a full response), ``resolved``, ``mismatch`` (validators differ) or ``orphan``
    (no earlier response). A response's own status, headers and digest are final.
    """
    scratch = Scratch(records.sparkSession, "warc")
    empty = F.expr("cast(map() as map<string,string>)")
    core = ["record_id", "record_type", "url", "captured_at", "status", "headers", "payload_digest"]
    extra = [c for c in records.columns if c not in (*core, *RESOLVED)]
    carried = F.struct(*extra) if extra else F.lit(None)
    keyed = records.select(*core, carried.alias("extra")).withColumn("canonical_url", canonical_url(F.col("url"))).withColumn("headers", F.coalesce("headers", empty))
    keyed = keyed.withColumns({"key": F.col("canonical_url"), "at": F.unix_micros("captured_at"), "tie": F.col("record_id"), "full": F.coalesce(F.col("record_type") == "response", F.lit(False))})
    usable = F.col("key").isNotNull() & F.col("at").isNotNull()
    # A map cannot be compared, so the struct that is carried holds its sorted entries.
    entries = F.array_sort(F.map_entries("headers"))
    keyed = keyed.withColumn("info", F.struct("record_id", "status", entries.alias("entries"), "payload_digest"))
    found = latest_before(keyed.where(usable), scratch).unionByName(keyed.where(~usable), allowMissingColumns=True)
    prior = F.map_from_entries("prior.info.entries")
    found = found.withColumn("prior_headers", F.coalesce(prior, empty))
    agree = validators_agree("headers", "prior_headers", F.col("payload_digest"), F.col("prior.info.payload_digest"))
    state = F.when(F.col("full"), "response").when(F.col("prior").isNull(), "orphan").when(agree, "resolved").otherwise("mismatch")
    found = found.withColumn("resolution", state)
    taken = F.col("resolution") == "resolved"
    return found.withColumns({
        "source_id": F.when(taken, F.col("prior.info.record_id")),
        "final_status": F.when(taken, F.col("prior.info.status")).otherwise(F.col("status")),
        "final_headers": F.when(taken, merged_headers("headers", "prior_headers")).otherwise(F.col("headers")),
        "final_digest": F.when(taken, F.col("prior.info.payload_digest")).otherwise(F.col("payload_digest")),
    }).select(*core, *RESOLVED, *(["extra.*"] if extra else []))


def with_payloads(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """``resolved`` with each record's final body, joined by the record it comes from."""
    bodies = records.select(F.col("record_id").alias("_source"), F.col("payload").alias("final_payload"))
    return resolved.join(bodies, F.coalesce("source_id", "record_id") == F.col("_source"), "left").drop("_source")


def page_captures(pages: DataFrame) -> DataFrame:
    """A crawl log over ``pages``: every page is captured twice by the rules below, without its body.

    Page p is a full response at second 2p with its html's digest as ETag. A second visit follows: at second
    2p + 1 by the URL with a tracking parameter and fragment, answered "not modified". It repeats the ETag in
    weak form; where p is divisible by 7 the server has changed the ETag meanwhile, and where p is divisible by
    11 it sends none and only the digest tells. Where p is divisible by 13 the first response failed to be
    stored, so its revisit has at best an older capture of the same canonical URL.
    """
    p, html = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(p.alias("page_id"), "url", F.sha2(html, 256).alias("payload_digest"), F.md5(html).alias("tag"), F.length(html).cast("string").alias("n"))
    first = base.where((p % 13 != 0) | p.isNull()).select(
        F.concat(F.lit("r"), p.cast("string")).alias("record_id"), F.lit("response").alias("record_type"), "url", F.timestamp_seconds(2 * p).alias("captured_at"), F.lit(200).alias("status"),
        F.create_map(F.lit("etag"), F.concat(F.lit('"'), F.col("tag"), F.lit('"')), F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("n"), F.lit("date"), (2 * p).cast("string")).alias("headers"), "payload_digest",
    )
    tag = F.when(p % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit('W/"'), F.col("tag"), F.lit('"')))
    rest = F.create_map(F.lit("date"), (2 * p + 1).cast("string"), F.lit("content-length"), F.lit("0"))
    headers = F.when(p % 11 == 0, rest).otherwise(F.map_concat(rest, F.create_map(F.lit("etag"), tag)))
    again = F.concat(F.regexp_replace(F.col("url"), "#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=again#seen"))
    second = base.select(F.concat(F.lit("v"), p.cast("string")).alias("record_id"), F.lit("revisit").alias("record_type"), again.alias("url"), F.timestamp_seconds(2 * p + 1).alias("captured_at"), F.lit(304).alias("status"), headers.alias("headers"), "payload_digest")
    return first.unionByName(second)


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_revisits(page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    merged = F.array_join(F.transform(F.array_sort(F.map_entries("final_headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return resolved.select("record_id", "canonical_url", "resolution", "source_id", "final_status", merged.alias("merged_headers"), "final_digest")


OP4_SQL = r"""
WITH base AS (
  SELECT page_id p, url, sha256(coalesce(html, '')) digest, md5(coalesce(html, '')) tag, CAST(length(coalesce(html, '')) AS VARCHAR) n FROM pages),
first AS (
  SELECT 'r' || p record_id, TRUE AS is_full, url, 2 * p AS sec, '"' || tag || '"' etag, n clen, 'text/html' ctype, digest FROM base WHERE p % 13 <> 0),
second AS (
  SELECT 'v' || p record_id, FALSE AS is_full, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=again#seen' url,
         2 * p + 1 AS sec, CASE WHEN p % 11 = 0 THEN NULL WHEN p % 7 = 0 THEN '"changed"' ELSE 'W/"' || tag || '"' END etag, '0' clen, NULL ctype, digest FROM base),
records AS (SELECT * FROM first UNION ALL SELECT * FROM second),
bare AS (SELECT *, regexp_replace(trim(url), '#.*$', '') b FROM records),
parts AS (
  SELECT *, lower(regexp_extract(b, '^(?i:https?://)(?:[^/?@]*@)?(?:www\.)?([^/?:]+)(.*)$', 1)) host,
         regexp_replace(regexp_extract(b, '^(?i:https?://)(?:[^/?@]*@)?(?:www\.)?([^/?:]+)(.*)$', 2), '^:(80|443)', '') rest FROM bare),
cleaned AS (
  SELECT *, regexp_extract(rest, '^([^?]*)', 1) path,
         array_to_string(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:utm_[a-z]+|ref|fbclid|gclid)=')), '&') query FROM parts),
keyed AS (
  SELECT *, CASE WHEN host = '' THEN b ELSE host || regexp_replace(path, '(?:\.html?|/)+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END END canonical_url FROM cleaned),
joined AS (
  SELECT k.*, f.record_id prior_id, f.etag prior_etag, f.clen prior_clen, f.digest prior_digest, f.sec prior_sec
  FROM keyed k ASOF LEFT JOIN (SELECT * FROM keyed WHERE is_full) f ON k.canonical_url = f.canonical_url AND k.sec > f.sec),
decided AS (
  SELECT *, CASE WHEN is_full THEN 'response' WHEN prior_id IS NULL THEN 'orphan'
    WHEN coalesce(regexp_replace(etag, '^W/', '') = prior_etag, digest = prior_digest) THEN 'resolved' ELSE 'mismatch' END resolution FROM joined)
SELECT record_id, canonical_url, resolution, CASE WHEN resolution = 'resolved' THEN prior_id END source_id,
  CAST(CASE WHEN is_full OR resolution = 'resolved' THEN 200 ELSE 304 END AS INTEGER) final_status,
  CASE WHEN resolution = 'resolved' THEN 'content-length=' || prior_clen || ';content-type=text/html;date=' || sec || ';etag=' || coalesce(etag, prior_etag)
       ELSE 'content-length=' || clen || CASE WHEN ctype IS NULL THEN '' ELSE ';content-type=' || ctype END || ';date=' || sec || CASE WHEN etag IS NULL THEN '' ELSE ';etag=' || etag END END merged_headers,
  CASE WHEN resolution = 'resolved' THEN prior_digest ELSE digest END final_digest
FROM decided
"""
