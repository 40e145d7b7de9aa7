"""The three programs: offline category reports (Q1, Q2), area report (Q3), realtime job (Q4-Q6).

Report writers are ``(df, table_name) -> None`` callables, e.g. ``jdbc_writer`` (append, as
the original programs did) or ``table_writer`` (append into a folder of tables).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from visitlens import schemas as S
from visitlens.fixed import BLOCK_THRESHOLD
from visitlens.plans import offline as O
from visitlens.sources.params import VisitFilter
from visitlens.sources.sinks import jdbc_append
from visitlens.sources.tables import typed
from visitlens.streaming import app as realtime

Writer = Callable[[DataFrame, str], None]


def jdbc_writer(url: str, properties: dict | None = None) -> Writer:
    """Append each report in one transaction: the reports are cut to their top rows, so one task writes them."""
    return lambda df, table: jdbc_append(df, url, table, properties, max_connections=1)


def table_writer(root: str) -> Writer:
    """Append each report to its folder below ``root``: earlier runs' rows stay, by task id."""
    return lambda df, table: df.write.mode("append").parquet(f"{root.rstrip('/')}/{table}")


def catalog_writer(database: str | None = None) -> Writer:
    """Append each report to a table of the catalog."""
    prefix = f"{database}." if database else ""
    return lambda df, table: df.write.mode("append").saveAsTable(prefix + table)


def run_offline(spark: SparkSession, visits: DataFrame, users: DataFrame, params_json: str,
                write: Writer, task_id: str | None = None) -> str:
    """Q1 and Q2 for one run id, from one scan of the visits; returns the run id."""
    task_id = task_id or str(uuid.uuid4())
    flt = VisitFilter.from_json(spark, params_json)
    top10, sessions = O.category_reports(visits, users, flt, task_id)
    write(typed(top10, S.CATEGORY_TOP10), "category_top10")
    write(typed(sessions, S.CATEGORY_SESSION_TOP10), "category_top10_session_top10")
    return task_id


def run_area(visits: DataFrame, cities: DataFrame, products: DataFrame, write: Writer) -> None:
    """Q3 into ``area_count_info`` (area, product_name, clickcount, city_remark)."""
    write(typed(O.area_report(visits, cities, products), S.AREA_COUNT_INFO), "area_count_info")


def run_realtime(lines: DataFrame, sink_root: str, checkpoint: str, threshold: int = BLOCK_THRESHOLD,
                 trigger: dict | None = None, state_partitions: int | None = None,
                 rejects: str | None = None, keep: int | None = None):
    """Q4-Q6 from a ``value`` line stream (Kafka or text files); returns the StreamingQuery.

    ``rejects`` names a folder that the same query writes the malformed lines to.
    """
    return realtime.start_from_lines(lines, sink_root, checkpoint, threshold=threshold, trigger=trigger,
                                     state_partitions=state_partitions, rejects=rejects, keep=keep)
