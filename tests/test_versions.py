"""Versioned tables and co-located visits: one-step replacement, joins without an exchange, hot users."""

import pytest
from pyspark.sql import functions as F

from visitlens import schemas as S
from visitlens.operators.colocated import DAY, filter_placed, place
from visitlens.operators.joins import SALT
from visitlens.operators.visits import filter_visits
from visitlens.sources.params import VisitFilter
from visitlens.sources.versions import Layout, current, current_version, drop_superseded, replace_tables

from .test_reports import users_df, visit, visits_df

FILTERS = [VisitFilter("", "", "", ""), VisitFilter("2019-01-03", "2019-01-05", "20", "29"),
           VisitFilter("", "2019-01-05", "", ""), VisitFilter("2019-01-20", "", "", "40"), VisitFilter("2030-01-01", "", "", "")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def shuffled(spark):
    """No broadcasts: both sides of a join must be placed."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def skewed(spark):
    """User 1 holds a third of all visits, half of them equal rows; a ninth has no user."""
    out = []
    for i in range(5400):
        user = 1 if i % 3 == 0 else None if i % 9 == 1 else 2 + i % 900
        date = "2019-01-01" if i % 6 == 0 else "2019-01-%02d" % (1 + i % 28)
        out.append(visit(date, user, "s" if i % 6 == 0 else f"s{i}", click_category_id=1 if i % 6 == 0 else i % 20))
    out += [(None, *out[0][1:]), ("", *out[0][1:])]
    return visits_df(spark, out), users_df(spark, [(u, u % 60) for u in range(1, 800)] + [(1, 25), (7, 7), (None, 30)])


def test_same_rows_as_the_join_and_no_exchange(spark, scratch, shuffled):
    v, u = skewed(spark)
    v.write.parquet(scratch + "/v")
    place(spark.read.schema(v.schema).parquet(scratch + "/v"), u, "vl_placed", buckets=8, root=scratch + "/t")
    for flt in FILTERS:
        got = filter_placed(spark, "vl_placed", flt)
        assert rows(got) == rows(filter_visits(v, u, flt))
        plan = plan_of(got)
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert got.columns == v.columns
    assert "Exchange" in plan_of(filter_visits(v, u, FILTERS[0]))
    days = {f.split(f"{DAY}=")[1].split("/")[0] for f in filter_placed(spark, "vl_placed", FILTERS[1]).inputFiles() if DAY in f}
    assert days <= {"2019-01-03", "2019-01-04", "2019-01-05", "__HIVE_DEFAULT_PARTITION__"}, days


def test_buckets_of_hot_users_and_of_no_user_are_even(spark, scratch):
    v, u = skewed(spark)
    place(v.coalesce(1), u, "vl_even", buckets=8, root=scratch)
    stored, known = current(spark, "vl_even", "visits", "users")
    dealt = stored.groupBy(F.expr(f"pmod(hash(user_id, {SALT}), 8)").alias("b")).count().collect()
    assert max(r["count"] for r in dealt) < 2 * 5402 / 8
    files = [f.rsplit("/", 1) for f in stored.inputFiles()]
    assert len({(d, f.split("_")[1].split(".")[0]) for d, f in files}) == len(files), "a bucket is one file a folder"
    assert known.where("user_id = 1").count() == 64 and known.where("user_id = 7").count() == 2


def test_empty_tables_and_clashing_columns(spark, scratch):
    v, u = skewed(spark)
    place(v.limit(0), u, "vl_none", buckets=4, root=scratch)
    assert rows(filter_placed(spark, "vl_none", FILTERS[0])) == []
    place(v, u.limit(0), "vl_none", buckets=4, root=scratch)
    assert rows(filter_placed(spark, "vl_none", FILTERS[1])) == []
    wide = v.withColumn("age", F.lit(1)).withColumn("salt", F.lit(2)).withColumn("day", F.lit("x"))
    place(wide, u.withColumn("city_id", F.lit(9)), "vl_none", buckets=4, root=scratch)
    assert rows(filter_placed(spark, "vl_none", FILTERS[1])) == rows(filter_visits(wide, u, FILTERS[1]))
    with pytest.raises(ValueError):
        place(v.withColumn(SALT, F.lit(0)), u, "vl_none", root=scratch)


def test_a_failed_replacement_leaves_the_old_version(spark, scratch):
    one = spark.range(5).toDF("x")
    replace_tables(spark, "vl_swap", {"a": (one, Layout()), "b": (one, Layout())}, scratch)
    before = current_version(spark, "vl_swap")
    broken = one.select(F.expr("IF(x = 3, raise_error('broken'), x)").cast("bigint").alias("x"))
    with pytest.raises(Exception, match="broken"):
        replace_tables(spark, "vl_swap", {"a": (one.where("x > 1"), Layout()), "b": (broken, Layout())}, scratch)
    assert current_version(spark, "vl_swap") == before and spark.table("vl_swap").count() == 5
    assert spark.sql("SHOW TABLES LIKE 'vl_swap__*'").count() == 2, "nothing of the failed version is listed"
    a, b = current(spark, "vl_swap", "a", "b")
    replace_tables(spark, "vl_swap", {"a": (one.where("x > 2"), Layout()), "b": (one.where("x > 3"), Layout())}, scratch)
    assert [d.count() for d in current(spark, "vl_swap", "a", "b")] == [2, 1]
    assert spark.table("vl_swap").count() == 2
    assert a.count() == b.count() == 5, "an opened version stays readable"


def test_readers_always_meet_a_table(spark):
    """While a replacement is written the old version answers; superseded versions go when asked to."""
    import threading
    replace_tables(spark, "vl_live", {"a": (spark.range(3).toDF("x"), Layout())})
    stop, seen, errors = threading.Event(), set(), []

    def reader():
        while not stop.is_set():
            try:
                seen.add(spark.table("vl_live").count())
            except Exception as e:  # any failure of a reader fails the test
                errors.append(e)
    t = threading.Thread(target=reader)
    t.start()
    for n in (4, 5, 6):
        replace_tables(spark, "vl_live", {"a": (spark.range(n).toDF("x"), Layout(bucket_by=("x",), buckets=2))})
    stop.set()
    t.join()
    assert not errors and seen <= {3, 4, 5, 6}
    assert len(drop_superseded(spark, "vl_live", keep=1)) == 2
    assert drop_superseded(spark, "vl_live", keep=1) == [] and spark.table("vl_live").count() == 6
    assert len(drop_superseded(spark, "vl_live", keep=0)) == 1
    spark.sql("DROP VIEW vl_live")


def test_a_plain_table_is_never_taken_over(spark, scratch):
    spark.range(2).write.option("path", scratch + "/plain").mode("overwrite").saveAsTable("vl_plain")
    with pytest.raises(ValueError):
        replace_tables(spark, "vl_plain", {"a": (spark.range(3), Layout())}, scratch)
    with pytest.raises(ValueError):
        current(spark, "vl_plain", "a")
    with pytest.raises(ValueError):
        replace_tables(spark, "vl_new", {}, scratch)
    assert spark.table("vl_plain").count() == 2
    spark.sql("DROP TABLE vl_plain")
