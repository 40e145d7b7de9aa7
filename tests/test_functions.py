from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.functions.text import ads_json, epoch_ms_to_day, half_up_tenths, java_split, pct_text


def _split(spark, values, sep=","):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(java_split("s", sep)).collect()]


def test_java_split_rules(spark):
    got = _split(spark, ["1,2,,", ",", ",1", "1,,2", "", None, "4,4"])
    assert got == [["1", "2"], [], ["", "1"], ["1", "", "2"], [""], None, ["4", "4"]]


def test_java_split_space(spark):
    assert _split(spark, ["1 a b 1 2 ", "a  b"], " ") == [["1", "a", "b", "1", "2"], ["a", "", "b"]]


def test_half_up_and_text(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 1), (1, 2000), (1, 8)], "c long, t long")
    out = df.select(pct_text(F.lit("A"), half_up_tenths(F.col("c").cast("double") / F.col("t")))).collect()
    assert [r[0] for r in out] == ["A:33.3%", "A:66.7%", "A:100.0%", "A:0.1%", "A:12.5%"]


def test_epoch_day_utc(spark):
    df = spark.createDataFrame([(1550275200123,), (1550361599999,)], "ts long")
    assert [r[0] for r in df.select(epoch_ms_to_day("ts")).collect()] == ["2019-02-16", "2019-02-16"]


def test_ads_json(spark):
    schema = T.StructType([T.StructField("ads", T.ArrayType(T.StructType([
        T.StructField("ads_id", T.StringType()), T.StructField("count", T.LongType())])))])
    df = spark.createDataFrame([([("3", 120), ("1", 99)],)], schema)
    assert df.select(ads_json("ads")).first()[0] == '[{"3":120},{"1":99}]'
