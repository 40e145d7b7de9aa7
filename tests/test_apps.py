import pytest

from tests.conftest import SF_SMALL
from visitlens.plans import apps
from visitlens.plans.registry import PARAMS_JSON, QUERIES
from visitlens.sources import adapters as A
from visitlens.streaming.app import reports


def test_offline_app_matches_queries(spark, scratch):
    v, u = A.user_visit_action(spark, SF_SMALL), A.user_info(spark, SF_SMALL)
    tid = apps.run_offline(spark, v, u, PARAMS_JSON, apps.table_writer(scratch), task_id="task-0001")
    assert tid == "task-0001"
    for table, q in [("category_top10", "category_top10"),
                     ("category_top10_session_top10", "category_session_top10")]:
        got = sorted(map(tuple, spark.read.parquet(f"{scratch}/{table}").collect()))
        assert got == sorted(map(tuple, QUERIES[q](spark, SF_SMALL).collect()))


def test_area_app_matches_query(spark, scratch):
    apps.run_area(A.user_visit_action(spark, SF_SMALL), A.city_info(spark, SF_SMALL),
                  A.product_info(spark, SF_SMALL), apps.table_writer(scratch))
    got = sorted(map(tuple, spark.read.parquet(f"{scratch}/area_count_info").collect()))
    assert got == sorted(map(tuple, QUERIES["area_product_top3"](spark, SF_SMALL).collect()))


def test_realtime_app_from_text_lines(spark, scratch):
    from visitlens.sources import adslog
    lines = ["1550275200000 North C_1 u1 a1"] * 3 + ["bad line", "1550275200000 South C_2 u2 a1"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{scratch}/in")
    q = apps.run_realtime(adslog.file_lines(spark, f"{scratch}/in"), f"{scratch}/out", f"{scratch}/ck",
                          threshold=2, trigger={"availableNow": True})
    q.awaitTermination()
    views = reports(spark, f"{scratch}/out")
    got = sorted(map(tuple, views["area_city_ads_count"].collect()))
    assert got == [("2019-02-16", "North", "C_1", "a1", 3), ("2019-02-16", "South", "C_2", "a1", 1)]
    assert [r[0] for r in views["blacklist"].collect()] == ["u1"]


def test_cli_programs_on_stored_tables(spark, scratch):
    """Store the adapter views as parquet tables, then run the command line programs on them."""
    from visitlens.__main__ import main
    from visitlens.plans.registry import TASK_ID
    tables = {"visits": A.user_visit_action(spark, SF_SMALL), "users": A.user_info(spark, SF_SMALL),
              "cities": A.city_info(spark, SF_SMALL), "products": A.product_info(spark, SF_SMALL)}
    for name, df in tables.items():
        df.write.parquet(f"{scratch}/in/{name}")
    args = [f"--{n}={scratch}/in/{n}" for n in tables] + [f"--out={scratch}/out"]
    main(["area"] + args)
    main(["offline", f"--params={PARAMS_JSON}", f"--task-id={TASK_ID}"] + args)
    for table, q in [("area_count_info", "area_product_top3"), ("category_top10", "category_top10"),
                     ("category_top10_session_top10", "category_session_top10")]:
        got = sorted(map(tuple, spark.read.parquet(f"{scratch}/out/{table}").collect()))
        assert got == sorted(map(tuple, QUERIES[q](spark, SF_SMALL).collect())), table


def test_cli_realtime_once_on_text_lines(spark, scratch):
    from visitlens.__main__ import main
    lines = ["1550275200000 North C_1 u1 a1"] * 3 + ["1550275200000 South C_2 u2 a1", "junk"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{scratch}/in")
    main(["realtime", f"--lines-dir={scratch}/in", f"--sink={scratch}/out", f"--checkpoint={scratch}/ck",
          "--threshold=2", "--once", "--state-partitions=2", f"--rejects={scratch}/rejects"])
    views = reports(spark, f"{scratch}/out")
    assert sorted(map(tuple, views["area_city_ads_count"].collect())) == [
        ("2019-02-16", "North", "C_1", "a1", 3), ("2019-02-16", "South", "C_2", "a1", 1)]
    assert [r[0] for r in views["blacklist"].collect()] == ["u1"]
    assert [r[0] for r in spark.read.parquet(f"{scratch}/rejects").collect()] == ["junk"]


def test_second_run_keeps_the_first_runs_rows(spark, scratch):
    v, u = A.user_visit_action(spark, SF_SMALL), A.user_info(spark, SF_SMALL)
    for task in ("one", "two"):
        apps.run_offline(spark, v, u, PARAMS_JSON, apps.table_writer(scratch), task_id=task)
    rows = spark.read.parquet(f"{scratch}/category_top10").groupBy("task_id").count().collect()
    assert sorted((r[0], r[1]) for r in rows) == [("one", 10), ("two", 10)]


def test_catalog_programs(spark, scratch):
    """Inputs by table name in a chosen database, reports appended to the catalog."""
    from visitlens.__main__ import main
    spark.sql(f"CREATE DATABASE vl_shop LOCATION '{scratch}/db'")
    try:
        for name, df in (("user_visit_action", A.user_visit_action(spark, SF_SMALL)), ("city_info", A.city_info(spark, SF_SMALL)),
                         ("product_info", A.product_info(spark, SF_SMALL))):
            df.write.saveAsTable(f"vl_shop.{name}")
        main(["area", "--database=vl_shop", "--out-database=vl_shop"])
        got = sorted(map(tuple, spark.table("vl_shop.area_count_info").collect()))
        assert got == sorted(map(tuple, QUERIES["area_product_top3"](spark, SF_SMALL).collect()))
    finally:
        spark.catalog.setCurrentDatabase("default")
        spark.sql("DROP DATABASE vl_shop CASCADE")


def test_session_keeps_settings_already_made(spark):
    from visitlens.session import get_session
    key, old = "spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set(key, "Asia/Shanghai")
    try:
        assert get_session().conf.get(key) == "Asia/Shanghai"
        assert get_session(extra={key: "UTC"}).conf.get(key) == "UTC"
    finally:
        spark.conf.set(key, old)


def test_cluster_needs_a_shared_folder(monkeypatch):
    from visitlens import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_cli_with_cluster_profile_in_fresh_process(spark, scratch):
    """The cluster sizing profile (8000 shuffle partitions, RocksDB state, ...) in its own JVM."""
    import os
    import subprocess
    import sys
    tables = {"visits": A.user_visit_action(spark, SF_SMALL), "cities": A.city_info(spark, SF_SMALL),
              "products": A.product_info(spark, SF_SMALL)}
    local = scratch.replace("file:", "")
    for name, df in tables.items():
        df.write.parquet(f"{scratch}/in/{name}")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    args = [sys.executable, "-m", "visitlens", "area", "--master", "local[2]", "--profile", "cluster",
            f"--visits={local}/in/visits", f"--cities={local}/in/cities",
            f"--products={local}/in/products", f"--out={local}/out"]
    subprocess.run(args, cwd=root, check=True, timeout=600, capture_output=True)
    got = sorted(map(tuple, spark.read.parquet(f"{scratch}/out/area_count_info").collect()))
    assert got == sorted(map(tuple, QUERIES["area_product_top3"](spark, SF_SMALL).collect()))
