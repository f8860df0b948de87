"""WARC archives with revisit records, written by Spark's text writer and read back whole.

Records with equal payload digests form a group; the one with the largest id is a
`response`, the others are `revisit` records that name it. A null payload counts as an
empty one. Rows that repeat the largest id are all responses; a row with a null id
revisits the largest id of its group, and is a response where there is none. A null URL
is written as an empty one. An empty table gives archives without records. Other columns
than those named aren't read, so they can't clash.

Each record is one row of the text writer and ends with the writer's line separator,
CRLF CRLF, so that a retried task replaces its whole file and no record is lost or twice
there. Reading goes by Content-Length, so that payloads may hold anything. Records are
dealt evenly to files of about FILE_BYTES, which a reading task holds one at a time; a
very long payload makes its file as much longer.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table, written

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The digits of base 32 as conv() writes them and as RFC 4648 does.
CONV_DIGITS, RFC_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_A_FILE = 20_000
#: Bytes of a file, and of a record beside its payload, about.
FILE_BYTES, HEADER_BYTES = 32 << 20, 640
READ_SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
ROWS = 512


def sha1_base32(value: Column) -> Column:
    """Upper-case base-32 SHA-1 of a string's or binary's bytes; 40 bits at a time."""
    digits = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(digits, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), CONV_DIGITS, RFC_DIGITS)


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(
        F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(url_col, F.lit("")), r"[\x00-\x20\x7F]", "").alias("url"), payload.alias("payload"), sha1_base32(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes")
    )


def revisits_of(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """id, digest, origin, origin_url of the records that are revisits, from headers (id, url, digest, bytes) alone."""
    counted = headers.where(F.col("bytes") >= min_bytes)
    origins = counted.groupBy("digest").agg(F.max("id").alias("origin"), F.max_by("url", "id").alias("origin_url"), F.count(F.lit(1)).alias("n")).where("n > 1 AND origin IS NOT NULL").drop("n")
    joined = counted.select("id", "digest").join(written(origins, "warc-origins"), "digest").where(~F.col("id").eqNullSafe(F.col("origin")))
    return joined.groupBy("id", "digest").agg(F.first("origin").alias("origin"), F.first("origin_url").alias("origin_url"))


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Id, URL, payload, digest, length, record type and the response a revisit names, dealt to as many tasks as there are files to be written.

    Headers alone are written and shuffled by digest to find each digest's response; what
    is found comes back to the payloads by id and digest, of which no value is frequent,
    and these are moved once to the tasks that write them.
    """
    records = _records(pages, id_col, url_col, payload_col)
    headers = written(records.select("id", "url", "digest", "bytes"), "warc-headers")
    revisits = written(revisits_of(headers, min_bytes), "warc-revisits").select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "origin", "origin_url")
    total = headers.agg(F.sum(F.col("bytes") + HEADER_BYTES)).head()[0] or 0
    joined = records.join(revisits, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    revisit = F.col("__digest").isNotNull()
    found = joined.select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "bytes", F.when(revisit, "revisit").otherwise("response").alias("type"), "origin", "origin_url")
    return found.repartition(max(1, -(-total // file_bytes)), "id", "digest")


def record_id(value: Column) -> Column:
    return F.concat(F.lit("<urn:x-record:"), F.coalesce(value.cast("string"), F.lit("")), F.lit(">"))


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", records_a_file: int = RECORDS_A_FILE) -> None:
    """Writes what ``resolve_revisits`` returns as WARC 1.1 files under ``path``."""
    revisit = F.col("type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF))

    refers = F.when(revisit, F.concat(line("WARC-Profile", REVISIT_PROFILE), line("WARC-Refers-To", record_id(F.col("origin"))), line("WARC-Refers-To-Target-URI", F.coalesce("origin_url", F.lit(""))))).otherwise("")
    value = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("type")), line("WARC-Record-ID", record_id(F.col("id"))), line("WARC-Date", date), line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        refers, line("Content-Type", "application/http; msgtype=response"), line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF), "block",
    )
    records.withColumn("block", block).select(value.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_a_file).text(path)


def parse_archive(content: bytes):
    """(headers with lower-case names, block) of each record."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, size = end + 4, int(headers["content-length"])
        if content[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has no end at {start + size}")
        yield headers, content[start : start + size]
        at = start + size + 4


def _bare(uri: str | None) -> str | None:
    return uri[len("<urn:x-record:") : -1] if uri else None


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] == "response":
        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        if headers["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError(f"the payload of {headers['warc-record-id']} doesn't have its digest")
    else:
        digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(head.rpartition(b"Content-Length:")[2])
    return (_bare(headers["warc-record-id"]), headers["warc-type"], headers["warc-target-uri"], digest, size, _bare(headers.get("warc-refers-to")), payload if payloads and headers["warc-type"] == "response" else None)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row a record; lengths and digests of responses are those of the bytes read."""
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse_archive(content.as_py()):
                    rows.append(_row(headers, block, payloads))
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, READ_SCHEMA)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(resolve_revisits(table(spark, sf_dir, "pages")), path)
    found = read_archives(spark, path, payloads=False)
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS origin FROM p),
bit AS (SELECT page_id, i, b, (strpos('0123456789abcdef', substr(hex, (i * 5 + b) // 4 + 1, 1)) - 1) // CAST(pow(2, 3 - (i * 5 + b) % 4) AS BIGINT) % 2 AS v
  FROM d, range(0, 32) AS x(i), range(0, 5) AS y(b)),
digit AS (SELECT page_id, i, sum(v * CAST(pow(2, 4 - b) AS BIGINT)) AS v FROM bit GROUP BY page_id, i),
digest AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v AS BIGINT) + 1, 1), '' ORDER BY i) AS payload_digest FROM digit GROUP BY page_id)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = origin THEN NULL ELSE origin END AS refers_to
FROM d JOIN digest USING (page_id)
"""
