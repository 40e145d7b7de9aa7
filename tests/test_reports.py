

from visitlens import schemas as S
from visitlens.operators.city_ratio import city_ratio, city_ratio_sql
from visitlens.operators.visits import filter_visits
from visitlens.plans import offline as O
from visitlens.sources.params import VisitFilter


def visit(date="2019-02-16", user_id=1, session_id="s1", click_category_id=-1, click_product_id=-1,
          order_category_ids=None, pay_category_ids=None, city_id=1):
    return (date, user_id, session_id, 1, date + " 00:00:00", None, click_category_id,
            click_product_id, order_category_ids, None, pay_category_ids, None, city_id)


def visits_df(spark, rows):
    return spark.createDataFrame(rows, S.USER_VISIT_ACTION)


def users_df(spark, rows):
    return spark.createDataFrame([(u, "n", "n", a, "p", "M") for u, a in rows], S.USER_INFO)


def test_bounds_inclusive_and_empty_off(spark):
    v = visits_df(spark, [visit("2019-01-01", 1), visit("2019-01-02", 2), visit("2019-01-03", 3)])
    u = users_df(spark, [(1, 20), (2, 30), (3, 50)])
    f = VisitFilter("2019-01-02", "2019-01-03", "30", "50")
    assert sorted(r.user_id for r in filter_visits(v, u, f).collect()) == [2, 3]
    assert filter_visits(v, u, VisitFilter("", "", "", "")).count() == 3
    assert filter_visits(v, u, VisitFilter("2019-01-03", "2019-01-03", "", "")).count() == 1


def test_params_from_lenient_json(spark):
    f = VisitFilter.from_json(spark, '{startDate:"2018-11-01", endDate:"2019-12-28", startAge: "20", '
                                     'endAge: "50", professionals: "", targetPageFlow:"1,2,3"}')
    assert f == VisitFilter("2018-11-01", "2019-12-28", "20", "50")
    g = VisitFilter.from_json(spark, '{startDate:"", endDate:""}')
    assert g.date_predicate() is None and g.age_predicate() is None
    import pytest
    with pytest.raises(ValueError):
        VisitFilter.from_json(spark, '{startDate:"2019-01-01", oops')


def test_join_fan_out_counts_twice(spark):
    v = visits_df(spark, [visit(user_id=7, click_category_id=3)])
    u = users_df(spark, [(7, 30), (7, 31)])
    top = O.category_top10(v, u, VisitFilter()).collect()
    assert [(r.category_id, r.click_count) for r in top] == [("3", 2)]
    s = O.category_session_top10(v, u, VisitFilter()).collect()
    assert [(r.category_id, r.session_id, r.click_count) for r in s] == [(3, "s1", 2)]


def test_session_cut_ten_smallest_ids(spark):
    rows = [visit(session_id=f"s{i:02d}", click_category_id=4) for i in range(12)]
    u = users_df(spark, [(1, 30)])
    s = O.category_session_top10(visits_df(spark, rows), u, VisitFilter()).collect()
    assert sorted(r.session_id for r in s) == [f"s{i:02d}" for i in range(10)]


def test_session_id_with_underscore_kept_whole(spark):
    rows = [visit(session_id="a_b_c", click_category_id=4)]
    s = O.category_session_top10(visits_df(spark, rows), users_df(spark, [(1, 30)]), VisitFilter())
    assert [r.session_id for r in s.collect()] == ["a_b_c"]


def _ratio(spark, cities):
    rows = [("X", 1, c) for c in cities]
    df = spark.createDataFrame(rows, "area string, click_product_id long, city_name string")
    a = city_ratio(df, ["area", "click_product_id"]).first()
    df.createOrReplaceTempView("ratio_in")
    b = city_ratio_sql(spark, "ratio_in", ["area", "click_product_id"]).first()
    assert (a.clickcount, a.city_remark) == (b.clickcount, b.city_remark)
    return a.city_remark


def test_city_ratio_cases(spark):
    assert _ratio(spark, ["A"] * 4) == "A:100.0%"
    assert _ratio(spark, ["A", "A", "B"]) == "A:66.7%,B:33.3%"
    assert _ratio(spark, ["A"] * 1999 + ["B"]) == "A:100.0%,B:0.1%"
    assert _ratio(spark, ["A", "A", "B", "C"]) == "A:50.0%,B:25.0%,其他:25.0%"
    assert _ratio(spark, ["A", "B", "C"]) == "A:33.3%,B:33.3%,其他:33.4%"
    assert _ratio(spark, ["A", None, None]) == "null:66.7%,A:33.3%"
    # exactly two cities: no remainder part, and both shares may round up (sum 100.1)
    assert _ratio(spark, ["A"] * 9 + ["B"] * 7) == "A:56.3%,B:43.8%"
    assert _ratio(spark, ["A"] * 1 + ["B"] * 7 + ["C"] * 1992) == "C:99.6%,B:0.4%,其他:0.0%"


def test_city_summary_of_a_group_with_a_million_cities(spark):
    """No task sorts or holds a group: each sends its two largest cities and one total."""
    from pyspark.sql import functions as F
    n = 1_000_000
    city = F.when(F.col("id") % 10 == 0, "big").when(F.col("id") % 10 == 1, "next").otherwise(F.concat(F.lit("c"), "id"))
    clicks = spark.range(n).select(F.lit(None).cast("string").alias("area"), F.lit(7).alias("p"), city.alias("city_name"))
    clicks = clicks.union(spark.range(3).select(F.lit("X"), F.lit(7), F.lit(None).cast("string")))
    df = city_ratio(clicks, ["area", "p"])
    assert sorted(map(tuple, df.collect()), key=str) == [
        ("X", 7, 3, "null:100.0%"), (None, 7, n, "big:10.0%,next:10.0%,其他:80.0%")]
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("Exchange hashpartitioning(area") <= 4  # the counts are shuffled once
    assert "row_number(), 2, Partial" in plan and plan.count("Window [") == 1
    few = clicks.where("city_name IN ('big', 'next') OR length(city_name) < 5 OR city_name IS NULL")
    few.createOrReplaceTempView("vl_few_cities")
    twin = city_ratio_sql(spark, "vl_few_cities", ["area", "p"])
    assert sorted(map(tuple, city_ratio(few, ["area", "p"]).collect()), key=str) == sorted(map(tuple, twin.collect()), key=str)
    assert city_ratio(clicks.limit(0), ["area", "p"]).collect() == []


def _area_clicks(spark, counts):
    rows = [("X", "c1", pid) for pid, n in counts for _ in range(n)]
    return spark.createDataFrame(rows, "area string, city_name string, click_product_id long")


def test_rank_ties_kept(spark):
    clicks = _area_clicks(spark, [(1, 9), (2, 7), (3, 7), (4, 7), (5, 5)])
    ranked = O.area_product_rank(O.area_product_summary(clicks)).collect()
    assert sorted((r.click_product_id, r.rk) for r in ranked) == [(1, 1), (2, 2), (3, 2), (4, 2)]


def test_missing_product_name_dropped_no_refill(spark):
    clicks = _area_clicks(spark, [(1, 9), (2, 7), (3, 6), (4, 5)])
    products = spark.createDataFrame([(2, "two", ""), (3, "three", ""), (4, "four", "")], S.PRODUCT_INFO)
    out = O.area_product_top3(clicks, products).collect()
    assert sorted(r.product_name for r in out) == ["three", "two"]


def test_area_report_positive_products_only(spark):
    v = visits_df(spark, [visit(click_product_id=0, city_id=1), visit(click_product_id=5, city_id=1),
                          visit(click_product_id=-1, city_id=1)])
    c = spark.createDataFrame([(1, "C_1", "North")], S.CITY_INFO)
    p = spark.createDataFrame([(5, "five", ""), (0, "zero", "")], S.PRODUCT_INFO)
    out = O.area_report(v, c, p).collect()
    assert [(r.area, r.product_name, r.clickcount, r.city_remark) for r in out] == [
        ("North", "five", 1, "C_1:100.0%")]


def test_invariant_to_shuffle_partitions(spark):
    from visitlens.plans.registry import QUERIES
    from tests.conftest import SF_SMALL
    names = ["category_top10", "category_session_top10", "area_product_top3", "area_top3_ads"]
    before = {n: sorted(map(tuple, QUERIES[n](spark, SF_SMALL).collect())) for n in names}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        after = {n: sorted(map(tuple, QUERIES[n](spark, SF_SMALL).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert before == after



def test_sql_visit_filter_binds_parameters(spark):
    from visitlens.plans.sql_reports import visit_filter_sql
    v = visits_df(spark, [visit("2019-01-01", 1), visit("2019-01-02", 2), visit("2019-01-03", 3)])
    u = users_df(spark, [(1, 20), (2, 30), (3, 50)])
    v.createOrReplaceTempView("t_visits")
    u.createOrReplaceTempView("t_users")
    got = visit_filter_sql(spark, "t_visits", "t_users", VisitFilter("2019-01-02", "", "", "40"))
    assert sorted(r.user_id for r in got.collect()) == [2]
    # a bound is a value, never SQL: this text matches no date instead of widening the filter
    evil = VisitFilter("9999' OR '1'='1", "", "", "")
    assert visit_filter_sql(spark, "t_visits", "t_users", evil).count() == 0
    assert visit_filter_sql(spark, "t_visits", "t_users", VisitFilter()).count() == 3


def test_reports_on_empty_inputs(spark):
    from visitlens.operators import guard as G
    v = visits_df(spark, [])
    u = users_df(spark, [])
    c = spark.createDataFrame([], S.CITY_INFO)
    p = spark.createDataFrame([], S.PRODUCT_INFO)
    ads = spark.createDataFrame([], "batch_id long, ts long, area string, city string, user_id string, ads_id string")
    assert O.category_top10(v, u, VisitFilter("2019-01-01", "", "20", "")).count() == 0
    assert O.category_session_top10(v, u, VisitFilter()).count() == 0
    assert O.area_report(v, c, p).count() == 0
    assert G.blocked_users(ads, 2).count() == 0
    assert G.admitted_clicks(ads, 2).count() == 0
    q5 = G.area_city_ads_count(G.admitted_counts(ads, 2))
    assert q5.count() == 0 and G.area_top3_ads(q5).count() == 0
    assert G.area_top3_ads_by_day(G.area_top3_ads(q5)).count() == 0
