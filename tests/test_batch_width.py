"""Micro-batches of the click log are 500 events wide where the guard's edges decide (event ids are unique)."""
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """User 7 crosses the threshold in events 0 to 499 and clicks again at 600 and 1,900."""
    root = tmp_path_factory.mktemp("clicks")
    ids = [1, 2, 600, 1900, 700]
    users = [7, 7, 7, 7, 8]
    pq.write_table(pa.table({
        "event_id": pa.array(ids, pa.int64()), "ts": pa.array([1_704_100_000_000_000 + i for i in ids], pa.timestamp("us")),
        "user_id": pa.array(users, pa.int64()), "event_type": ["click"] * 5, "value": [1.0] * 5,
        "props": ['{"k": 3}', '{"k": 3}', '{"k": 4}', '{"k": 5}', '{"k": 3}']}), root / "events.parquet")
    pq.write_table(pa.table({"n_nationkey": pa.array([7, 8], pa.int32()), "n_name": ["A", "B"], "n_regionkey": pa.array([1, 1], pa.int32())}),
                   root / "nation.parquet")
    pq.write_table(pa.table({"r_regionkey": pa.array([1], pa.int32()), "r_name": ["R"]}), root / "region.parquet")
    return str(root)


def rows_of(spark, tables, name):
    df = E.queries()[name](spark, tables)
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


WANT = {
    "blacklist_users": ["(0, '7')"],
    "user_ad_day_counts": ["('4', 1, '2024-01-01', '8')", "('4', 2, '2024-01-01', '7')"],
    "area_city_ads_count": ["('4', 'R', 'A', 2, '2024-01-01')", "('4', 'R', 'B', 1, '2024-01-01')"],
    "area_ads_rollup": ["('4', 'R', 3, '2024-01-01')"],
    "area_top3_ads": ["""('R', '2024-01-01', '[{"4":3}]')"""],
}
for twin in ("user_ad_day_counts stream_user_ads_click", "area_city_ads_count stream_area_city_ads", "area_top3_ads stream_area_top3",
             "area_top3_ads stream_lines_area_top3", "area_city_ads_count stream_changelog_area_city_ads", "area_top3_ads stream_changelog_area_top3"):
    WANT[twin.split()[1]] = WANT[twin.split()[0]]


@pytest.mark.parametrize("name", sorted(WANT))
def test_clicks_after_the_crossing_500_events_are_not_admitted(spark, tables, name):
    got = rows_of(spark, tables, name)
    assert got == WANT[name]
    con = duckdb.connect()
    for t in ("events", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    for t, c in (("customer", "c_custkey BIGINT, c_name VARCHAR, c_mktsegment VARCHAR"), ("part", "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR")):
        con.execute(f"CREATE TABLE {t} ({c})")
    twin = con.sql(E.oracle_sql()[name]).to_arrow_table()
    assert sorted(map(str, (tuple(r[c] for c in sorted(twin.column_names)) for r in twin.to_pylist()))) == got
