"""Content-addressed WARC archive: payloads stored once by digest, exact headers beside them.

``write_archive`` lays two tables into a folder: ``payloads`` (one row per distinct payload: its
SHA-256 key, byte count and bytes) and ``headers`` (one row per record: the exact WARC and HTTP
header block and the key of its payload). A record whose payload another record holds is a
``revisit`` of the one with the largest id. ``read_archive`` joins them back into records and checks
each payload against its key and each header against its payload, and raises if either differs.
``write_warc`` / ``read_warc`` turn records into WARC files and back.

A payload is addressed by SHA-256 and length; SHA-1 (base32) is what WARC headers state. Copies are
found by key, with map-side combining, so a payload that a third of all pages share is one row per
task before the shuffle; the join that hands each record its response runs on keys only, between two
scans, so that adaptive execution may split a hot key.

Defined results: a null payload is stored as an empty one; payloads under ``min_bytes`` are never
revisited; repeated rows of the largest id are all responses; a null id is below every other, and a
payload known only under null ids has responses only; a null URL gives no WARC-Target-URI; control
characters and blanks of URLs are percent-encoded in headers. Only ``page_id``, ``url`` and ``html``
are read, so other columns cannot clash. Empty tables give an empty archive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm.common import read
from visitlens.session import shared_dir

CRLF = "\r\n"
#: RFC 4648 base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Capture time in every header, for inputs that have none.
CAPTURED = "1970-01-01T00:00:00Z"
PAYLOADS, HEADERS = "payloads", "headers"
HEADER_SCHEMA = "page_id bigint, refers_to bigint, record_type string, header string, key string, payload_bytes bigint"
PAYLOAD_SCHEMA = "key string, payload_bytes bigint, payload binary"
RECORDS_PER_FILE = 20_000


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hex string of 40 digits: four runs of 40 bits, eight letters each."""
    letters = []
    for run in range(4):
        bits = F.conv(F.substring(hex_digest, 10 * run + 1, 10), 16, 10).cast("long")
        for shift in range(35, -1, -5):
            at = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substr(F.lit(BASE32), at.cast("int"), F.lit(1)))
    return F.concat(*letters)


def _uri(url: Column) -> Column:
    for char, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def headers(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Unfinished headers, one per page, with the payload's key, digest and byte count; no payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", F.sha2("payload", 256).alias("key"), base32(F.sha1("payload")).alias("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    ).withColumn("shared", F.col("payload_bytes") >= min_bytes)


def _finished(rows: DataFrame) -> DataFrame:
    revisit = F.col("shared") & F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
                    _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    stored = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    block = F.concat(
        F.lit("WARC/1.1" + CRLF), _line("WARC-Type", kind), _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        F.coalesce(_line("WARC-Target-URI", _uri(F.col("url"))), F.lit("")), F.lit(f"WARC-Date: {CAPTURED}{CRLF}"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF),
                                 _line("WARC-Refers-To", _record_id(F.col("last_id"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response" + CRLF),
        _line("Content-Length", stored.cast("string")), F.lit(CRLF), http,
    )
    return rows.select("page_id", F.when(revisit, F.col("last_id")).alias("refers_to"), kind.alias("record_type"),
                       block.alias("header"), "key", "payload_bytes")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archive ``pages`` (``page_id``, ``url``, ``html``) into the folder ``path``."""
    spark = pages.sparkSession
    h = headers(pages, min_bytes)
    h.groupBy("key").agg(F.max("page_id").alias("last_id")).write.parquet(f"{path}/last")
    last = spark.read.parquet(f"{path}/last").withColumnRenamed("key", "last_key")
    joined = h.join(last, F.col("key") == F.col("last_key")).drop("last_key")
    _finished(joined).write.parquet(f"{path}/{HEADERS}")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    bytes_of = pages.select(payload.alias("payload")).select(
        F.sha2("payload", 256).alias("key"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")
    # Equal keys are equal bytes, so any row of a group will do; copies go before the shuffle.
    bytes_of.groupBy("key", "payload_bytes").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/{PAYLOADS}")


def _checked(ok: Column, what: str, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"archive: {what} of "), F.col("key"))))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records as written: ``page_id, record_type, refers_to, header, payload_bytes, payload_digest, payload``.

    The payload of a revisit is that of the record it refers to. Headers and payloads meet in a join
    on the key, between two scans.
    """
    h = spark.read.schema(HEADER_SCHEMA).parquet(f"{path}/{HEADERS}")
    p = spark.read.schema(PAYLOAD_SCHEMA).parquet(f"{path}/{PAYLOADS}").select(F.col("key").alias("p_key"), "payload")
    # Checked once per stored payload, before the join repeats it.
    sound = F.sha2("payload", 256) == F.col("p_key")
    p = p.select("p_key", F.when(sound, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("archive: damaged payload "), F.col("p_key")))).alias("payload"))
    # Length and digest are those of the checked payload, so a query that drops the payload still checks it.
    p = p.select("p_key", "payload", base32(F.sha1("payload")).alias("p_digest"), F.octet_length("payload").cast("long").alias("p_bytes"))
    rows = h.join(p, F.col("key") == F.col("p_key"), "left")
    digest = F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]+)\r\n", 1)
    kind = F.regexp_extract("header", r"\r\nWARC-Type: (\w+)\r\n", 1)
    refers = F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>\r\n", 1)
    size = F.regexp_extract("header", r"\r\n\r\n(?s:.*)\r\nContent-Length: (\d+)\r\n\r\n$", 1).cast("long")
    return rows.select(
        "page_id", kind.alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"),
        "header", _checked(size.eqNullSafe(F.col("p_bytes")), "length", size).alias("payload_bytes"),
        _checked(digest.eqNullSafe(F.col("p_digest")), "digest", digest).alias("payload_digest"), "payload")


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Gzip WARC files with the records of ``read_archive``; payloads must be UTF-8."""
    body = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    record = records.select(F.concat("header", body).alias("value"))
    (record.write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def _parsed(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zlib

    for frame in files:
        for content in frame["content"]:
            data, at, out = zlib.decompress(content, 47), 0, []
            while at < len(data):
                end = data.index(b"\r\n\r\n", at) + 4
                fields = dict(x.split(": ", 1) for x in data[at:end].decode().split(CRLF)[1:] if x)
                stop = end + int(fields["Content-Length"])
                http = data.index(b"\r\n\r\n", end) + 4
                page = fields["WARC-Record-ID"][len("<urn:page:"):-1]
                refers = fields.get("WARC-Refers-To", "")[len("<urn:page:"):-1]
                out.append((int(page) if page != "none" else None, fields["WARC-Type"], int(refers) if refers else None,
                            data[at:http].decode(), fields["WARC-Payload-Digest"][5:], data[http:stop]))
                at = stop + 4
            yield pd.DataFrame(out, columns=["page_id", "record_type", "refers_to", "header", "payload_digest", "payload"]
                               ).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files in ``path``, a file at a time; a revisit's payload is empty."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(_parsed, "page_id bigint, record_type string, refers_to bigint, header string, "
                                      "payload_digest string, payload binary")


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archive back and list its records."""
    path = shared_dir(spark, "llm", "warc")
    write_archive(read(spark, sf_dir, "pages"), path)
    records = read_archive(spark, path)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex, sha256(coalesce(html, '')) AS key
  FROM pages
), named AS (
  SELECT *, max(page_id) OVER (PARTITION BY key) AS last_id,
         array_to_string(list_transform(range(0, 32), lambda i:
           substr('{BASE32}', 1 + ((('0x' || substr(hex, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id <> last_id OR (page_id IS NULL AND last_id IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> last_id OR (page_id IS NULL AND last_id IS NOT NULL) THEN last_id END AS refers_to
FROM named
"""
