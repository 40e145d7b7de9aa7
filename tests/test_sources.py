import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from visitlens import schemas as S
from visitlens.sources import adslog
from visitlens.sources.sinks import jdbc_append, jdbc_insert_row, jdbc_read, overwrite_table, with_task_id
from visitlens.sources.tables import preview, read_table, typed


def _parse(spark, lines, failfast=False):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return adslog.parse_lines(df, failfast=failfast)


def test_parse_accept_reject(spark):
    p = _parse(spark, ["x a b 1 2", "1 a b", "1 a b 1 2 z", "1550275200123 North C_1 3 5"])
    ok = sorted(map(tuple, adslog.accepted(p).collect()))
    assert ok == [(1, "a", "b", "1", "2", "1970-01-01"),
                  (1550275200123, "North", "C_1", "3", "5", "2019-02-16")]
    assert sorted(r.value for r in adslog.rejected(p).collect()) == ["1 a b", "x a b 1 2"]


def test_parse_never_raises(spark):
    lines = ["9999999999999999999 N C u a", "999999999999999999 N C u a", "     ", "", "253402300799999 N C u a", "253402300800000 N C u a"]
    df = spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string")
    p = adslog.parse_lines(df)
    assert [r.day for r in p.collect() if r.valid] == ["9999-12-31"]
    assert adslog.rejected(p).count() == 6 and adslog.accepted(p).count() == 1


def test_parse_failfast_raises(spark):
    with pytest.raises(Exception):
        adslog.accepted(_parse(spark, ["x a b 1 2"], failfast=True)).collect()


def test_format_parse_round_trip(spark):
    rows = [(1550275200123, "North", "C_1", "3", "5"), (1, "S", "C_2", "4", "6")]
    df = spark.createDataFrame(rows, S.ADS_LOG)
    back = adslog.accepted(adslog.parse_lines(adslog.format_lines(df))).drop("day")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_kafka_source_needs_connector(spark):
    # No Kafka connector jar in this image: building the source must fail loudly, not silently.
    with pytest.raises(Exception):
        adslog.kafka_lines(spark, "localhost:9", "ads_log")


def test_typed_scan_and_preview(spark, scratch):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "product_id int, product_name string, extend_info string")
    t = typed(df.withColumn("extra", F.lit(1)), S.PRODUCT_INFO)
    assert t.schema == S.PRODUCT_INFO
    t.write.parquet(f"{scratch}/p")
    assert read_table(spark, f"{scratch}/p").count() == 2
    assert preview(spark, f"{scratch}/p", 1).count() == 1


def test_overwrite_table(spark, scratch):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    overwrite_table(df, "visitlens_t1", path=f"{scratch}/t1")
    overwrite_table(df.union(df), "visitlens_t1", path=f"{scratch}/t1")
    assert spark.table("visitlens_t1").count() == 2
    spark.sql("DROP TABLE visitlens_t1")


def test_jdbc_round_trip_in_process(spark, scratch):
    """Embedded Derby lives inside this JVM (no server, no port): local-mode test only."""
    url = f"jdbc:derby:{scratch.replace('file:', '')}/derby;create=true"
    try:
        out = with_task_id(spark.createDataFrame([("1", 5, 2, 0)], "category_id string, click_count long, "
                                                 "order_count long, pay_count long"), "t-1")
        jdbc_append(out, url, "category_top10", batch_size=10)
        jdbc_insert_row(spark, url, "category_top10", ("t-2", "2", 1, 1, 1), S.CATEGORY_TOP10)
    except PySparkException as e:  # pragma: no cover - depends on Derby on the classpath
        pytest.skip(f"no embedded JDBC driver: {e}")
    back = sorted(map(tuple, jdbc_read(spark, url, "category_top10").collect()))
    assert back == [("t-1", "1", 5, 2, 0), ("t-2", "2", 1, 1, 1)]
