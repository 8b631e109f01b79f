"""WARC archives with revisit resolution.

Headers (page id, payload bytes, digest) are grouped by payload digest; of equal
payloads of at least ``min_bytes`` the record with the largest page id is the
response and the others revisit it.  Only headers are shuffled and joined: revisit
records are made from headers alone, and a page finds that it is a response by bitmaps
of fixed size, so its payload stays in the task that read it.  Archives are written by
Spark's text writer, whose record separator is the CRLF CRLF that ends a WARC record,
so a write commits atomically on any Hadoop file system and survives lost executors.
Each file is one gzip stream; payloads are written by size class, each with its bound
of records, so that a file stays below 512 MB of payloads, or holds one.  Reading
parses the files by Content-Length and resolves revisits by payload digest.

Defined results: a null html is an empty payload; a null url is written as
``about:blank``; records shorter than ``min_bytes`` are all responses; rows that
repeat the largest page id with the same payload are all responses; a null page
id is written as ``null``, read back as null, and never chosen over another; a
group whose ids are all null is all responses.  An empty table gives no rows.
Extra columns are not read.  A record's id is a UUID drawn from page id, digest and
url, so rows that repeat all three share it.

Headers are fresh: WARC-Date is the time of writing, unless given, and a revisit
names the original's record, target and date.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _path, bounded_join, materialize, release, shared_path

MIN_BYTES = 1000
#: Upper bound of payload bytes of a size class, and records of that class in a file: none holds more than about 512 MB.
SIZE_CLASSES = ((1 << 17, 4096), (1 << 21, 256), (1 << 25, 16), (None, 1))
#: Groups of equal payloads up to which their table is broadcast to the headers (about 100 bytes each).
BROADCAST_GROUPS = 100_000
#: Bits of a table of marks, which is broadcast: 8 MB at every size of the input.
MARK_BITS = 1 << 26
#: Bytes of a gzip stream, below which it holds no record: an empty one has 20, a record's id and digest alone have more.
EMPTY_FILE = 64
_RECORD_END = "\r\n\r\n"
_PAGE = "X-Page-Id"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_heads(pages: DataFrame, id_col: str, html_col: str, target) -> DataFrame:
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).alias("page_id"), target.alias("url"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("digest"))


def resolve(heads: DataFrame, min_bytes: int, label: str = "warc-heads") -> DataFrame:
    """The headers, written, with original and original_url of those that revisit a record; null for responses."""
    large = F.col("bytes") >= min_bytes
    first = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    groups = heads.where(large).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = materialize(groups.select("digest", "first"), "warc-groups")
    joined = bounded_join(heads, groups, "digest", BROADCAST_GROUPS, "left")
    first = F.when(large & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first"))
    decided = materialize(joined.withColumn("first", first).select(*heads.columns, F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url")), label)
    release(groups)
    return decided


def _slot(seed: int):
    """Number, from 1, of the mark of a header or a row."""
    return F.pmod(F.xxhash64("page_id", "digest", F.lit(seed)), F.lit(MARK_BITS)) + 1


def _marks(rows: DataFrame, seed: int) -> DataFrame:
    """Table (part, bits) of the marks of rows: MARK_BITS bits in parts of 4 KB, however many rows there are."""
    return rows.select(_slot(seed).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))


def _with_mark(rows: DataFrame, marks: DataFrame, seed: int, name: str) -> DataFrame:
    """rows with a boolean column: is the row's mark set."""
    rows = rows.withColumn("_slot", _slot(seed)).withColumn("part", F.bitmap_bucket_number("_slot")).join(F.broadcast(marks), "part", "left")
    at = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.withColumn(name, F.coalesce(F.call_function("getbit", byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("part", "bits", "_slot")


def mark_tables(decided: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The marks of the revisits, and (page_id, digest) of the responses that lie under one of these marks."""
    marks = materialize(_marks(decided.where("original is not null"), 0), "warc-marks")
    responses = decided.where((F.col("bytes") >= min_bytes) & F.col("original").isNull())
    return marks, materialize(_with_mark(responses, marks, 0, "_marked").where("_marked").select("page_id", "digest").distinct(), "warc-doubtful")


def response_rows(rows: DataFrame, marks: DataFrame, doubtful: DataFrame, min_bytes: int) -> DataFrame:
    """The rows that are no revisits, exactly, with payloads left where they lie.

    A row whose mark no revisit has set is a response.  Of the others, those whose second mark no doubtful response has
    set are revisits.  The few under both are joined with the doubtful responses by page and digest.
    """
    large = F.col("bytes") >= min_bytes
    rows = _with_mark(rows, marks, 0, "_marked")
    clear = rows.where(~large | ~F.col("_marked")).drop("_marked")
    if doubtful.isEmpty():
        return clear
    both = _with_mark(rows.where(large & F.col("_marked")), _marks(doubtful, 1), 1, "_both").where("_both").drop("_marked", "_both")
    same = both["page_id"].eqNullSafe(doubtful["page_id"]) & (both["digest"] == doubtful["digest"])
    return clear.unionByName(both.join(doubtful, same, "left_semi"))


def _text(column):
    return F.coalesce(column.cast("string"), F.lit("null"))


def _record_id(page, digest, url):
    drawn = F.sha2(F.concat_ws("\n", _text(page), digest, url), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(drawn, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: str, date: str, more, payload):
    """Text of a record of the columns page_id, url, digest and bytes: headers, those of more, and the payload."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "),
        _record_id(F.col("page_id"), F.col("digest"), F.col("url")),
        F.lit(f"\r\n{_PAGE}: "),
        _text(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        more,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(payload)).cast("string"),
        F.lit("\r\n\r\n"),
        http,
        payload,
    ).alias("value")


def _drop_empty(spark: SparkSession, path: str) -> None:
    """Deletes the files of tasks without a row."""
    files, folder = _path(spark, path)
    for status in files.listStatus(folder):
        if status.getPath().getName().endswith(".gz") and status.getLen() < EMPTY_FILE:
            files.delete(status.getPath(), False)


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, records_per_file: int | None = None, date: str | None = None) -> None:
    """Writes one WARC record per row of pages below path; records_per_file lowers the bounds of SIZE_CLASSES."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    target = F.coalesce(F.col(url_col), F.lit("about:blank"))
    target = F.replace(F.replace(target, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    decided = resolve(payload_heads(pages, id_col, html_col, target), min_bytes)
    refers = F.concat(
        F.lit("\r\nWARC-Refers-To: "),
        _record_id(F.col("original"), F.col("digest"), F.col("original_url")),
        F.lit(f"\r\n{_PAGE}-Of-Original: "),
        _text(F.col("original")),
        F.lit("\r\nWARC-Refers-To-Target-URI: "),
        F.col("original_url"),
        F.lit(f"\r\nWARC-Refers-To-Date: {date}\r\nWARC-Profile: {_PROFILE}"),
    )
    revisits = decided.where("original is not null").select(_record("revisit", date, refers, F.lit("")))
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), target.alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("bytes"))
    largest = decided.where("original is null").agg(F.max("bytes")).first()[0]
    marks, doubtful = mark_tables(decided, min_bytes)
    least = -1
    for most, records in SIZE_CLASSES:
        if least >= 0 and (largest is None or largest <= least):
            break
        inside = (F.col("bytes") > least) & (F.lit(True) if most is None else F.col("bytes") <= most)
        some = rows.where(inside).withColumn("digest", F.sha1(F.col("html").cast("binary")))
        out = response_rows(some, marks, doubtful, min_bytes).select(_record("response", date, F.lit(""), F.col("html")))
        out = out.unionByName(revisits) if least < 0 else out  # revisits are headers only: they go with the smallest
        out.write.mode("append").option("lineSep", _RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", min(records, records_per_file or records)).text(path)
        least = most
    _drop_empty(pages.sparkSession, path)
    release(decided, marks, doubtful)


def parse_records(stream):
    """Yields (headers with lower-case names, block) of each record of a binary stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("a WARC record is cut short")
        yield headers, block


def _page(value: str | None) -> str | None:
    return None if value == "null" else value


_READ = "page_id string, record_type string, digest string, bytes long, refers_to string, warc_url string"


def _parse(batches):
    """Record rows of archive files; a response's digest and size come from its payload as read."""
    for batch in batches:
        for content in batch.column(0):
            raw = io.BytesIO(content.as_buffer().to_pybytes())
            rows = []
            for headers, block in parse_records(gzip.open(raw)):
                kind, digest, size = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:"), None
                if kind == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    size, found = len(payload), hashlib.sha1(payload).hexdigest()
                    if found != digest:
                        raise ValueError(f"payload digest differs: {headers['warc-record-id']}")
                rows.append((_page(headers[_PAGE.lower()]), kind, digest, size, _page(headers.get(f"{_PAGE}-of-original".lower())), headers["warc-target-uri"]))
            if rows:
                kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "record_type", "digest", "bytes", "refers_to", "warc_url"])


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A revisit record holds no payload; its size is that of the original that its digest leads to.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    records = materialize(files.mapInArrow(_parse, _READ), "warc-records")
    originals = (
        records.groupBy("digest")
        .agg(F.max(F.when(F.col("record_type") == "response", F.col("bytes"))).alias("original_bytes"), F.max(F.col("record_type") == "revisit").alias("visited"))
        .where("visited")
        .select("digest", "original_bytes")
    )
    originals = materialize(originals, "warc-originals")
    shape = lambda df, size: df.select(
        F.col("page_id").cast(id_type).alias("page_id"), size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(id_type).alias("refers_to"), F.col("warc_url").alias("url")
    )
    revisits = bounded_join(records.where("record_type = 'revisit'"), originals, "digest", BROADCAST_GROUPS, "left")
    return shape(records.where("record_type <> 'revisit'"), F.col("bytes")).unionByName(shape(revisits, F.col("original_bytes")))


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract's columns: writes the archives to the shared folder and reads them back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS m FROM p WHERE b >= 1000 GROUP BY d)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN b >= 1000 AND page_id IS DISTINCT FROM m AND m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 1000 AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM p LEFT JOIN g USING (d)
"""
