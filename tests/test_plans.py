"""Plan-shape checks: the properties the reports rely on at scale."""
import pytest

from tests.conftest import SF_SMALL
from visitlens import schemas as S
from visitlens.operators.visits import filter_visits
from visitlens.plans import offline as O
from visitlens.plans.registry import QUERIES
from visitlens.sources.params import VisitFilter
from visitlens.sources.tables import typed


def formatted(df) -> str:
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    text = formatted(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["category_session_top10", "area_product_top3", "area_top3_ads",
                                  "area_product_top3_sql"])
def test_topk_per_group_cuts_before_shuffle(spark, name):
    text = formatted(QUERIES[name](spark, SF_SMALL))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_global_top10_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in formatted(QUERIES["category_top10"](spark, SF_SMALL))


@pytest.mark.parametrize("name", ["category_top10", "area_product_counts", "area_city_ads_count",
                                  "blacklist_users"])
def test_partial_aggregation_before_exchange(spark, name):
    text = formatted(QUERIES[name](spark, SF_SMALL))
    assert "partial_" in text


def test_only_bounded_explicit_broadcast():
    """The only broadcast hint in batch code is the 10-row top-category list."""
    import inspect

    import visitlens.operators.guard as G
    import visitlens.operators.joins as J
    import visitlens.operators.visits as V
    import visitlens.plans.offline as OFF
    for mod in (G, J, V, OFF):
        src = inspect.getsource(mod)
        assert src.count("F.broadcast(") == src.count("F.broadcast(_top_ids(")
    assert "F.broadcast(_top_ids(top10))" in inspect.getsource(OFF)


@pytest.mark.parametrize("name", ["visit_filter", "category_top10", "visit_filter_sql"])
def test_date_bound_is_a_range_at_the_scan(spark, name):
    text = formatted(QUERIES[name](spark, SF_SMALL))
    assert "GreaterThanOrEqual(ts,2024-01-03T00:00" in text and "LessThan(ts,2024-01-28T00:00" in text


def test_lineitem_is_shuffled_once(spark):
    """Joins of lineitem rows: one, on the order key, with broadcasts off."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        text = formatted(QUERIES["area_product_top3_lineitem"](spark, SF_SMALL))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    tree = text.split("\n\n")[0]
    lines = tree.splitlines()
    scan = next(i for i, x in enumerate(lines) if "Scan parquet" in x)  # lineitem is the left-most leaf
    depth = lambda x: len(x) - len(x.lstrip(" :|+-"))
    above, d = [], depth(lines[scan])
    for x in reversed(lines[:scan]):
        if depth(x) < d:
            above.append(x)
            d = depth(x)
    joins = [x for x in above if "Join" in x]
    assert len(joins) == 2  # places, then product names after the cut
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text


def test_session_report_scans_events_once(spark):
    from visitlens.plans.registry import PARAMS_JSON
    from visitlens.sources import adapters as A
    flt = VisitFilter.from_json(spark, PARAMS_JSON)
    seen = []
    real = O.persisted
    try:
        O.persisted = lambda df, name: (seen.append(formatted(df)), real(df, name))[1]
        q1, q2 = O.category_reports(A.user_visit_action(spark, SF_SMALL, flt), A.user_info(spark, SF_SMALL), flt)
    finally:
        O.persisted = real
    assert sum(x.count("events.parquet") for x in seen) == 1
    assert "events.parquet" not in formatted(q1) + formatted(q2)


def test_bounds_pushed_to_scan_on_typed_tables(spark, scratch):
    visits = spark.createDataFrame([("2019-01-0%d" % d, d, "s", 1, "t", None, d, d, None, None, None, None, 1)
                                    for d in range(1, 6)], S.USER_VISIT_ACTION)
    users = spark.createDataFrame([(d, "n", "n", 20 + d, "p", "M") for d in range(1, 6)], S.USER_INFO)
    visits.write.parquet(f"{scratch}/v")
    users.write.parquet(f"{scratch}/u")
    v = typed(spark.read.parquet(f"{scratch}/v"), S.USER_VISIT_ACTION)
    u = typed(spark.read.parquet(f"{scratch}/u"), S.USER_INFO)
    flt = VisitFilter("2019-01-02", "2019-01-04", "22", "24")
    df = filter_visits(v, u, flt)
    text = formatted(df)
    assert "GreaterThanOrEqual(date,2019-01-02)" in text and "LessThanOrEqual(date,2019-01-04)" in text
    assert "GreaterThanOrEqual(age,22)" in text and "LessThanOrEqual(age,24)" in text
    assert sorted(r.user_id for r in df.collect()) == [2, 3, 4]
    # column pruning: the category report reads only the columns it uses
    text = formatted(O.category_top10(v, u, flt))
    assert "ReadSchema: struct<date:string,user_id:bigint,click_category_id:bigint," \
           "order_category_ids:string,pay_category_ids:string>" in text


def test_date_partitioned_visits_prune_folders(spark, scratch):
    from visitlens.sources.sinks import overwrite_table
    visits = spark.createDataFrame([("2019-01-0%d" % d, d, "s", 1, "t", None, d, d, None, None, None, None, 1)
                                    for d in range(1, 6)], S.USER_VISIT_ACTION)
    overwrite_table(visits, "visitlens_visits_by_date", path=f"{scratch}/vd", partition_by=["date"])
    users = spark.createDataFrame([(d, "n", "n", 30, "p", "M") for d in range(1, 6)], S.USER_INFO)
    v = typed(spark.table("visitlens_visits_by_date"), S.USER_VISIT_ACTION)
    df = filter_visits(v, users, VisitFilter("2019-01-02", "2019-01-03", "", ""))
    text = formatted(df)
    assert "PartitionFilters: [isnotnull(date" in text and "(date" in text.split("PartitionFilters:")[1][:200]
    assert sorted(r.user_id for r in df.collect()) == [2, 3]
    spark.sql("DROP TABLE visitlens_visits_by_date")
