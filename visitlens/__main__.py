"""Command line: ``python -m visitlens {offline,area,realtime} ...``.

Inputs are catalog table names or parquet paths; outputs go over JDBC (``--jdbc-url``) or
into a folder of tables (``--out``) or the catalog (``--out-database``).
"""

from __future__ import annotations

import argparse

from visitlens import schemas as S
from visitlens.plans import apps
from visitlens.session import get_session
from visitlens.sources import adslog
from visitlens.sources.tables import read_table, typed


def _writer(a):
    if a.jdbc_url:
        props = {"user": a.jdbc_user or "", "password": a.jdbc_password or ""}
        return apps.jdbc_writer(a.jdbc_url, props)
    return apps.table_writer(a.out) if a.out else apps.catalog_writer(a.out_database)


def main(argv=None):
    p = argparse.ArgumentParser(prog="visitlens")
    p.add_argument("program", choices=["offline", "area", "realtime"])
    p.add_argument("--master")
    p.add_argument("--visits", default="user_visit_action")
    p.add_argument("--users", default="user_info")
    p.add_argument("--cities", default="city_info")
    p.add_argument("--products", default="product_info")
    p.add_argument("--params", default='{startDate:"", endDate:"", startAge:"", endAge:""}')
    p.add_argument("--task-id")
    p.add_argument("--jdbc-url")
    p.add_argument("--jdbc-user")
    p.add_argument("--jdbc-password")
    p.add_argument("--out", help="folder for report tables when no --jdbc-url is given")
    p.add_argument("--out-database", help="catalog database for report tables when neither is given")
    p.add_argument("--hive", action="store_true", help="use the Hive catalog")
    p.add_argument("--database", help="catalog database that table names are looked up in")
    p.add_argument("--kafka-servers")
    p.add_argument("--topic", default="ads_log")
    p.add_argument("--lines-dir", help="text-file line source instead of Kafka")
    p.add_argument("--sink")
    p.add_argument("--checkpoint")
    p.add_argument("--threshold", type=int, default=100)
    p.add_argument("--starting-offsets", help="Kafka start of a first run: latest, earliest or JSON "
                   "(default: latest, or earliest with --once)")
    p.add_argument("--max-files-per-trigger", type=int, help="files of --lines-dir per micro-batch (default: all)")
    p.add_argument("--rejects", help="table folder for malformed lines")
    p.add_argument("--state-partitions", type=int)
    p.add_argument("--keep-batches", type=int, help="delete group folders unused for so many micro-batches (default: none)")
    p.add_argument("--once", action="store_true",
                   help="process what the source holds now, then stop (availableNow trigger)")
    p.add_argument("--profile", default="local", choices=["local", "cluster"])
    a = p.parse_args(argv)
    spark = get_session(a.master, profile=a.profile, hive=a.hive, database=a.database)
    if a.program == "offline":
        v = typed(read_table(spark, a.visits), S.USER_VISIT_ACTION)
        u = typed(read_table(spark, a.users), S.USER_INFO)
        print(apps.run_offline(spark, v, u, a.params, _writer(a), a.task_id))
    elif a.program == "area":
        v = typed(read_table(spark, a.visits), S.USER_VISIT_ACTION)
        c = typed(read_table(spark, a.cities), S.CITY_INFO)
        pr = typed(read_table(spark, a.products), S.PRODUCT_INFO)
        apps.run_area(v, c, pr, _writer(a))
    else:
        start = a.starting_offsets or ("earliest" if a.once else "latest")
        lines = (adslog.file_lines(spark, a.lines_dir, a.max_files_per_trigger) if a.lines_dir
                 else adslog.kafka_lines(spark, a.kafka_servers, a.topic, start))
        trigger = {"availableNow": True} if a.once else None
        q = apps.run_realtime(lines, a.sink, a.checkpoint, a.threshold, trigger=trigger,
                              state_partitions=a.state_partitions, rejects=a.rejects, keep=a.keep_batches)
        q.awaitTermination()


if __name__ == "__main__":
    main()
