import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from visitlens.llm import warc

ROWS = [(1, "http://a/x", "<p>one"), (2, "http://a/y", "<p>two"), (3, None, "<p>one"), (4, "http://a b\r\nX: y/", "<p>one"), (5, "u", None), (6, "u", ""),
        (7, "u", "é" * 40_000), (7, "u", "é" * 40_000), (None, "u", "<p>two"), (None, "u", "only null ids"), (9, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, key string, payload string")


def brute(rows, min_bytes=0):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == data and j is not None]
        last = max(same) if same and len(data) >= min_bytes else i
        again = i != last
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 7])
def test_archive_round_trip(spark, scratch, min_bytes):
    warc.write_archive(pages(spark).repartition(3), scratch, min_bytes)
    got = warc.read_archive(spark, scratch)
    rows = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, rows), key=str) == brute(ROWS, min_bytes)
    assert sorted((str(r["page_id"]), bytes(r["payload"])) for r in got.collect()) == sorted((str(i), (h or "").encode()) for i, _, h in ROWS)
    stored = spark.read.parquet(f"{scratch}/payloads")
    assert stored.count() == len({h or "" for _, _, h in ROWS})
    for r in got.collect():
        assert r["header"].startswith("WARC/1.1\r\nWARC-Type: ") and r["header"].count("\r\n\r\n") == 2
        assert "X: y" not in r["header"].split("\r\n")


def test_damage_is_found(spark, scratch):
    warc.write_archive(pages(spark), scratch)
    bad = spark.read.parquet(f"{scratch}/payloads").withColumn("payload", F.encode(F.lit("other"), "UTF-8"))
    bad.write.parquet(f"{scratch}-bad/payloads")
    spark.read.parquet(f"{scratch}/headers").write.parquet(f"{scratch}-bad/headers")
    with pytest.raises(Exception, match="archive: "):
        warc.read_archive(spark, f"{scratch}-bad").collect()
    spark.read.parquet(f"{scratch}/payloads").limit(1).write.parquet(f"{scratch}-gone/payloads")
    spark.read.parquet(f"{scratch}/headers").write.parquet(f"{scratch}-gone/headers")
    with pytest.raises(Exception, match="archive: "):
        warc.read_archive(spark, f"{scratch}-gone").collect()


def test_the_query_checks_the_strong_digest(spark, scratch):
    """Its columns alone make Spark compute SHA-256 of every payload that is read back."""
    from tests.conftest import SF_SMALL
    out = warc.op1_warc_archive(spark, SF_SMALL)
    assert "sha2(" in out._jdf.queryExecution().optimizedPlan().toString()
    warc.write_archive(pages(spark), scratch)
    for table in ("headers", "payloads"):  # keys that no longer are the payloads' digests, all else being sound
        t = spark.read.parquet(f"{scratch}/{table}")
        t.withColumn("key", F.reverse("key")).select(t.columns).write.parquet(f"{scratch}-keys/{table}")
    with pytest.raises(Exception, match="archive: damaged payload"):
        warc.read_archive(spark, f"{scratch}-keys").select(out.columns).collect()


def test_warc_files(spark, scratch):
    warc.write_archive(pages(spark), scratch)
    records = warc.read_archive(spark, scratch)
    warc.write_warc(records, f"{scratch}/files", records_per_file=2)
    back = {(r["page_id"], r["header"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in warc.read_warc(spark, f"{scratch}/files").collect()}
    want = {(r["page_id"], r["header"], r["payload_digest"], r["record_type"], r["refers_to"], b"" if r["record_type"] == "revisit" else bytes(r["payload"]))
            for r in records.collect()}
    assert back == want


def test_empty(spark, scratch):
    warc.write_archive(pages(spark).limit(0), scratch)
    assert warc.read_archive(spark, scratch).count() == 0
