"""Hot keys: one user holds a third of all visits / clicks.

Broadcasts are switched off and AQE's skew thresholds lowered so the joins run as
sort-merge joins whose hot partition AQE must split; results must equal brute force.
"""
import contextlib
import io
from collections import Counter

import pytest

from visitlens import schemas as S
from visitlens.operators import guard as G
from visitlens.operators.visits import filter_visits
from visitlens.plans import offline as O
from visitlens.sources.params import VisitFilter

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _final_plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue().split("Initial Plan")[0]


def _visits(spark):
    rows = []
    for i in range(6000):
        user = 1 if i % 3 == 0 else 2 + i % 97          # user 1: a third of all visits
        cat = i % 7 + 1
        rows.append(("2019-01-%02d" % (1 + i % 28), user, f"s{user}_{i % 5}", 1, "t", None,
                     cat if i % 2 == 0 else -1, i % 50 if i % 2 == 0 else -1,
                     None if i % 2 == 0 else f"{cat},{(cat + 1) % 7 + 1},", None, None, None, 1 + i % 5))
    return rows


def test_only_hot_keys_are_salted(spark):
    from pyspark.sql import functions as F

    from visitlens.operators.joins import hot_key_join, hot_keys
    big = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 3000)).alias("k"), "id")
    big = big.union(spark.createDataFrame([(None, -1)], "k string, id bigint"))
    small = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(1500)], "k string, v int")
    assert hot_keys(big, "k") == ["hot"]
    out = hot_key_join(big, small, "k", "left")
    assert out.columns == ["k", "id", "v"] and out.count() == 9001
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, big.join(small, "k", "left").collect()), key=str)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "explode" in plan
    salted = [x for x in plan.splitlines() if "Generate explode" in x]
    assert len(salted) == 1 and "CASE WHEN" in salted[0]  # one copy but for the hot key


def test_no_exchange_of_counts_by_user_alone(spark, skew_conf):
    """The guard's running totals are dealt by (day, user, ad), never by user alone."""
    import re

    from tests.test_guard import ads_df
    rows = [(i % 60, 0, "hot" if i % 3 == 0 else f"u{i % 40}", str(i % 4)) for i in range(900)]
    df = ads_df(spark, rows)
    out = G.blocked_users(df, 30)
    out.collect()
    plan = _final_plan(out)
    for keys, rest in re.findall(r"Exchange hashpartitioning\(([^)]*)\)(.*(?:\n.*){3})", plan):
        cols = [c.strip().split("#")[0] for c in keys.split(",")][:-1]
        assert cols != ["user_id"] or "partial_min" in rest  # only the combined minimum per user


def test_hot_user_join_is_split_and_exact(spark, skew_conf):
    rows = _visits(spark)
    v = spark.createDataFrame(rows, S.USER_VISIT_ACTION).repartition(8)
    u = spark.createDataFrame([(k, "n", "n", 30, "p", "M") for k in range(1, 100)], S.USER_INFO)
    df = filter_visits(v, u, VisitFilter("2019-01-03", "", "", ""))
    got = df.count()
    assert got == sum(1 for r in rows if r[0] >= "2019-01-03")
    df = filter_visits(v, u, VisitFilter("2019-01-03", "", "", ""))
    df.collect()
    plan = _final_plan(df)
    assert "SortMergeJoin(skew=true)" in plan or "isSkewJoin=true" in plan or "skew" in plan.lower()


def test_hot_keys_are_found_in_one_job_on_any_shape(spark):
    import random

    from visitlens.operators.joins import HOT_SHARE, hot_keys
    rng = random.Random(3)
    shapes = {
        "skewed": [0 if i % 3 == 0 else rng.randrange(1, 50_000) for i in range(60_000)],
        "zipf": [min(int(rng.paretovariate(0.7)), 10**9) for _ in range(60_000)],
        "uniform": [i for i in range(60_000)],
        "few": [i % 150 for i in range(60_000)]}
    for name, keys in shapes.items():
        df = spark.createDataFrame([(k,) for k in keys] + [(None,)] * 30_000, "k bigint").repartition(6)
        total, counts = len(keys), Counter(keys)
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"hot-{name}", name)
        got = hot_keys(df, "k")
        jobs = tracker.getJobIdsForGroup(f"hot-{name}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert {k for k, n in counts.items() if n * HOT_SHARE > total} <= set(got), name
        assert len(got) <= 2 * HOT_SHARE and all(counts[k] * HOT_SHARE * 1.2 > total for k in got), name
        assert len(jobs) <= 3, name  # AQE runs the stages of one aggregate as jobs of their own


def test_users_outside_the_bounds_are_filtered_before_the_shuffle(spark, skew_conf):
    """Spark's runtime Bloom filter on the visits side of the visit filter."""
    conf = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true"}
    from visitlens.session import shared_dir
    root = shared_dir(spark, "bloom")
    rows = _visits(spark)
    spark.createDataFrame(rows, S.USER_VISIT_ACTION).write.parquet(f"{root}/v")
    spark.createDataFrame([(k, "n", "n", k, "p", "M") for k in range(1, 100)], S.USER_INFO).write.parquet(f"{root}/u")
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = filter_visits(spark.read.parquet(f"{root}/v"), spark.read.parquet(f"{root}/u"), VisitFilter("", "", "20", "29"))
        assert df.count() == sum(1 for r in rows if 20 <= r[1] <= 29)
        df.collect()
        assert "might_contain" in _final_plan(df)
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_jobs_before_the_action(spark):
    """Building a report runs its input at most once (AQE runs each stage of a query as a job of its own)."""
    from tests.conftest import SF_SMALL
    from visitlens.plans.registry import QUERIES
    tracker = spark.sparkContext.statusTracker()
    for name, most in (("visit_filter", 4), ("admitted_clicks", 12)):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        QUERIES[name](spark, SF_SMALL)
        started = tracker.getJobIdsForGroup(f"build-{name}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(started) <= most, (name, len(started))


def test_hot_user_reports_match_brute_force(spark, skew_conf):
    rows = _visits(spark)
    v = spark.createDataFrame(rows, S.USER_VISIT_ACTION).repartition(8)
    u = spark.createDataFrame([(k, "n", "n", 30, "p", "M") for k in range(1, 100)], S.USER_INFO)
    top = {r.category_id: (r.click_count, r.order_count) for r in
           O.category_top10(v, u, VisitFilter()).collect()}
    clicks, orders = Counter(), Counter()
    for r in rows:
        if r[6] != -1:
            clicks[str(r[6])] += 1
        elif r[8]:
            for c in r[8].rstrip(",").split(","):
                orders[c] += 1
    cats = set(clicks) | set(orders)
    assert top == {c: (clicks[c], orders[c]) for c in cats}


def test_hot_user_guard_matches_brute_force(spark, skew_conf):
    from tests.test_guard import ads_df, simulate
    rows = [(i % 6, 0, "hot" if i % 3 == 0 else f"u{i % 40}", str(i % 4)) for i in range(900)]
    df = ads_df(spark, rows).repartition(8)
    adm, blk = simulate(rows, 30)
    assert {r.user_id for r in G.blocked_users(df, 30).collect()} == blk
    assert G.admitted_clicks(df, 30).count() == len(adm)
    assert sum(r.click_count for r in G.area_city_ads_count(G.admitted_counts(df, 30)).collect()) == len(adm)


def test_row_level_admission_join_is_salted(spark, skew_conf):
    """With the block table too big to broadcast, both join sides shuffle on (user, salt)."""
    import re
    from tests.test_guard import ads_df, simulate
    rows = [(i % 6, 0, "hot" if i % 3 == 0 else f"u{i % 40}", str(i % 4)) for i in range(3000)]
    df = ads_df(spark, rows).repartition(8)
    out = G.admitted_clicks(df, 30)
    assert out.count() == len(simulate(rows, 30)[0])
    out.collect()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", _final_plan(out))
    salted = [k for k in keys if "__salt" in k and "user_id" in k]
    assert len(salted) == 2 and "SortMergeJoin" in _final_plan(out)


def test_hot_user_session_counts_salted_and_exact(spark, skew_conf):
    import re
    rows = []
    for i in range(3000):
        user = 1 if i % 3 == 0 else 2 + i % 50
        rows.append(("2019-01-05", user, f"s{user}_{i % 400}", 1, "t", None, 1 + i % 3, 5, None, None, None, None, 1))
    v = spark.createDataFrame(rows, S.USER_VISIT_ACTION).repartition(8)
    u = spark.createDataFrame([(k, "n", "n", 30, "p", "M") for k in range(1, 60)], S.USER_INFO)
    out = O.category_session_counts(v, u, VisitFilter(), O.category_top10(v, u, VisitFilter()))
    got = {(r.category_id, r.session_id): r.click_count for r in out.collect()}
    want = Counter((r[6], r[2]) for r in rows)
    assert got == dict(want)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", _final_plan(out))
    assert sum(1 for k in keys if "__salt" in k) == 2
