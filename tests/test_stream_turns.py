"""Micro-batches that take several numbered batches: the guard's edges are those of the numbers."""
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.test_guard import COLS, _expected, _tables, ads_df
from visitlens.sources import adslog
from visitlens.streaming import app, guard, registry
from visitlens.streaming.registry import LEAST, ROWS, TRIGGERS, folded, read_batches, read_line_batches, span_of, triggers_of, write_batches


def clicks(spark, n=700, batches=30):
    rng = random.Random(3)
    rows = [(rng.randrange(batches), rng.randrange(2), f"u{min(rng.randrange(60), rng.randrange(60))}", str(rng.randrange(4))) for _ in range(n)]
    return ads_df(spark, rows)


@pytest.mark.parametrize("span", [4, 30])
def test_turns_equal_the_batch_replay(spark, scratch, span):
    df = clicks(spark)
    n = write_batches(df.select(*COLS), f"{scratch}/src", span=span)
    assert n == -(-30 // span)
    app.start(read_batches(spark, f"{scratch}/src"), f"{scratch}/sink", f"{scratch}/ck", threshold=3, trigger={"availableNow": True}).awaitTermination()
    got = _tables(spark, f"{scratch}/sink")
    assert got == _expected(df, 3)
    assert app.Store(spark, f"{scratch}/sink").last() == n - 1
    again = {t: sorted(map(tuple, x.select(sorted(x.columns)).collect()), key=str) for t, x in folded(spark, f"{scratch}/sink").items()}
    assert again == {t: got[t] for t in again}


def test_turns_of_lines(spark, scratch):
    df = clicks(spark).withColumn("area", F.lit("N")).withColumn("city", F.lit("C"))
    lines = adslog.format_lines(df.select(*COLS), keep=("batch_id",)).unionByName(
        spark.createDataFrame([(1, "no click"), (17, "x\ty z")], "batch_id bigint, value string"))
    write_batches(lines, f"{scratch}/src", fmt="text", span=8)
    app.start_from_lines(read_line_batches(spark, f"{scratch}/src"), f"{scratch}/sink", f"{scratch}/ck", threshold=3,
                         trigger={"availableNow": True}, rejects=f"{scratch}/bad").awaitTermination()
    assert _tables(spark, f"{scratch}/sink") == _expected(df, 3)
    assert sorted(r.value for r in spark.read.parquet(f"{scratch}/bad").collect()) == ["no click", "x\ty z"]


def test_a_long_log_is_few_micro_batches(spark):
    for low, high in ((0, 0), (5, 9), (0, 199), (7, 11_999)):
        df = spark.createDataFrame([(low,), (high,)], "batch_id bigint")
        span = span_of(df)
        assert len({b - b % span for b in range(low, high + 1)}) <= TRIGGERS
        assert span == 1 or high - low >= TRIGGERS - 1
    assert span_of(spark.createDataFrame([], "batch_id bigint")) == 1


def test_micro_batches_follow_the_clicks(spark):
    assert [triggers_of(n) for n in (0, 1, 2 * ROWS, 3 * ROWS + 1, 10 * ROWS, 10 ** 12)] == [LEAST, LEAST, LEAST, 5, 11, TRIGGERS]
    df = spark.range(1200).select((F.col("id") + 7).alias("batch_id"))
    span = span_of(df)
    assert len({b - b % span for b in range(7, 1207)}) <= LEAST


@pytest.fixture(scope="module")
def click_tables(tmp_path_factory):
    """A click in every 100th of 30,000 events: 60 batches of 500 events, 15 of 2,000."""
    root = tmp_path_factory.mktemp("clicks")
    ids = list(range(0, 30_000, 100))
    pq.write_table(pa.table({
        "event_id": pa.array(ids, pa.int64()), "ts": pa.array([1_704_100_000_000_000 + i for i in ids], pa.timestamp("us")),
        "user_id": pa.array([i % 7 for i in ids], pa.int64()), "event_type": ["click"] * len(ids), "value": [1.0] * len(ids),
        "props": [f'{{"k": {i % 11}}}' for i in ids]}), root / "events.parquet")
    pq.write_table(pa.table({"n_nationkey": pa.array(range(7), pa.int32()), "n_name": list("ABCDEFG"), "n_regionkey": pa.array([1] * 7, pa.int32())}),
                   root / "nation.parquet")
    pq.write_table(pa.table({"r_regionkey": pa.array([1], pa.int32()), "r_name": ["R"]}), root / "region.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(registry.STREAM_QUERIES))
def test_a_replay_of_few_clicks_is_few_micro_batches(spark, click_tables, monkeypatch, name):
    """All clicks are laid out, with the numbers of their batches, for ``LEAST`` micro-batches at most."""
    class Laid(Exception):
        pass

    def lay(df, path, **kw):
        assert df.count() == 300 and df.select("batch_id").distinct().count() in (15, 60)
        raise Laid(write_batches(df, path, **kw))

    monkeypatch.setattr(registry, "write_batches", lay)
    with pytest.raises(Laid) as laid:
        registry.STREAM_QUERIES[name](spark, click_tables)
    assert 2 <= laid.value.args[0] <= LEAST


def test_a_micro_batch_looks_up_its_folders_once(spark, scratch, monkeypatch):
    seen, folders = [], app.Store.folders
    monkeypatch.setattr(app.Store, "folders", lambda self, versions: seen.append(1) or folders(self, versions))
    df = clicks(spark, n=60, batches=3)
    write_batches(df.select(*COLS), f"{scratch}/src")
    app.start(read_batches(spark, f"{scratch}/src"), f"{scratch}/sink", f"{scratch}/ck", threshold=3, trigger={"availableNow": True}).awaitTermination()
    assert len(seen) == 2  # none in the first, which has no groups before it
    assert _tables(spark, f"{scratch}/sink") == _expected(df, 3)


def test_the_state_of_a_replay_follows_its_clicks(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = registry.STATE_ROWS
    assert [registry.state_partitions(spark, n) for n in (0, 1, rows, rows + 1, 10 ** 12)] == [1, 1, 1, 2, cores]


@pytest.mark.parametrize("name", sorted(registry.STREAM_QUERIES))
def test_a_replay_of_few_clicks_has_one_state_partition(spark, click_tables, monkeypatch, name):
    """The layout of the log is found without a job of its own; every click reaches the stream."""
    class Started(Exception):
        pass

    def started(rows, *args, state_partitions, **kw):
        raise Started(state_partitions)

    monkeypatch.setattr(app, "start", started)
    monkeypatch.setattr(app, "start_from_lines", started)
    monkeypatch.setattr(registry, "span_of", None)
    with pytest.raises(Started) as got:
        registry.STREAM_QUERIES[name](spark, click_tables)
    assert got.value.args[0] == 1


def test_the_layout_is_that_of_the_whole_log(spark, click_tables):
    for wide in (500, 2000):
        stored, span, parts = registry.stored_clicks(spark, click_tables, wide)
        assert stored.count() == 300 and span == span_of(stored) and parts == 1


def test_a_micro_batch_counts_its_clicks_once(spark, scratch, monkeypatch):
    """Blocks, users' totals and groups' totals read the same stored counts."""
    seen = []
    for name in ("blocked_turns", "user_totals"):
        kept = getattr(guard, name)
        monkeypatch.setattr(app, name, lambda totals, counts, x, kept=kept: seen.append(counts.is_cached) or kept(totals, counts, x))
    df = clicks(spark, n=60, batches=2)
    n = write_batches(df.select(*COLS), f"{scratch}/src")
    app.start(read_batches(spark, f"{scratch}/src"), f"{scratch}/sink", f"{scratch}/ck", threshold=3, trigger={"availableNow": True}).awaitTermination()
    assert seen == [True] * 2 * n
    assert _tables(spark, f"{scratch}/sink") == _expected(df, 3)


def test_blocked_turns_shuffle_the_counts_once_for_steps_and_window(spark):
    counts = spark.createDataFrame([("d", "N", "C", "u", "1", t, 2) for t in range(4)], "day string, area string, city string, user_id string, ads_id string, turn bigint, n bigint")
    counts = counts.unionByName(counts.withColumn("city", F.lit("E")).withColumn("n", F.lit(1).cast("bigint")))
    totals = spark.createDataFrame([("d", "u", "1", 20), ("d", "v", "1", 99)], "day string, user_id string, ads_id string, total bigint")
    got = guard.blocked_turns(totals, counts, 13)
    assert [tuple(r) for r in got.collect()] == [("u", 1)]  # 8 before, 3 a turn: 11, 14, 17, 20
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(day") == 1
