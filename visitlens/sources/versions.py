"""Tables replaced in one step, laid out for joins without a shuffle.

``overwrite_table`` drops a table before it writes it: readers may meet none, and a failed write leaves none.
Here a replacement is written as new catalog tables of a version of its own, beside the old ones. Only when all
of them are complete does one catalog change point the view of that name to them. Until then, and for good if a
write fails, readers see the old version; a query that has opened an old version goes on reading it, since its
files stay until ``drop_superseded`` is asked to take them away.

Several tables that belong together (here: visits and users placed by the same salted keys) are parts of one
version, so no reader sees one of them new and the other old: ``current`` takes the version from the view.

``Layout`` gives a part's folders, buckets and order. Rows are dealt by the bucket columns before the write, in the
way Spark numbers buckets, so a bucket is one file a folder, written by one task.
"""

from __future__ import annotations

import time
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

VERSION = "visitlens.version"


class Layout(NamedTuple):
    partition_by: tuple[str, ...] = ()
    bucket_by: tuple[str, ...] = ()
    buckets: int = 0
    sort_by: tuple[str, ...] = ()


def part_table(name: str, part: str, version: str) -> str:
    return f"{name}__{part}__{version}"


def _save(df: DataFrame, table: str, layout: Layout, root: str | None) -> None:
    if layout.buckets:
        df = df.repartition(layout.buckets, *layout.bucket_by)
    w = df.write.format("parquet").mode("error")
    if layout.partition_by:
        w = w.partitionBy(*layout.partition_by)
    if layout.buckets:
        w = w.bucketBy(layout.buckets, *layout.bucket_by).sortBy(*(layout.sort_by or layout.bucket_by))
    if root:
        w = w.option("path", f"{root.rstrip('/')}/{table}")
    w.saveAsTable(table)


def replace_tables(spark: SparkSession, name: str, parts: dict[str, tuple[DataFrame, Layout]],
                   root: str | None = None) -> str:
    """Write ``parts`` as a new version of ``name`` and point the view ``name`` to it; the version.

    The view selects the first part. With ``root`` the tables are external, in folders below it (a shared folder);
    otherwise they lie in the warehouse. Tables of a version that could not be completed are dropped and the error
    is raised. ``name`` must be new or a view made here: a table of that name is an error, never dropped.
    """
    if not parts:
        raise ValueError("a version has at least one part")
    if spark.catalog.tableExists(name) and current_version(spark, name) is None:
        raise ValueError(f"{name} is no view of a versioned table")
    version = f"v{time.time_ns():020d}_{uuid.uuid4().hex[:6]}"
    try:
        for part, (df, layout) in parts.items():
            _save(df, part_table(name, part, version), layout, root)
        spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{VERSION}' = '{version}') AS "
                  f"SELECT * FROM {part_table(name, next(iter(parts)), version)}")
    except Exception:
        for part in parts:
            spark.sql(f"DROP TABLE IF EXISTS {part_table(name, part, version)}")
        raise
    return version


def current_version(spark: SparkSession, name: str) -> str | None:
    """The version that readers of ``name`` get; None if ``name`` isn't a versioned table."""
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return found.get(VERSION)


def current(spark: SparkSession, name: str, *parts: str) -> list[DataFrame]:
    """The named parts, all of the same version."""
    version = current_version(spark, name)
    if version is None:
        raise ValueError(f"{name} is no view of a versioned table")
    return [spark.table(part_table(name, part, version)) for part in parts]


def drop_superseded(spark: SparkSession, name: str, keep: int = 1) -> list[str]:
    """Drop the tables of versions older than the current one, but for the ``keep`` latest of them; the dropped ones.

    Versions later than the current one are left alone: a writer may be at work on them. Files of tables in the
    warehouse go with them, files below a ``root`` stay.
    """
    now = current_version(spark, name)
    database, _, bare = name.rpartition(".")
    listed = spark.sql(f"SHOW TABLES{f' IN {database}' if database else ''} LIKE '{bare}__*__v*'")
    tables = [r["tableName"] for r in listed.collect() if not r["isTemporary"]]
    of = {t: t.rpartition("__")[2] for t in tables if t.startswith(f"{bare.lower()}__")}
    old = sorted({v for v in of.values() if now and v < now})
    gone = set(old[:len(old) - keep] if keep else old)
    dropped = sorted(t for t, v in of.items() if v in gone)
    for t in dropped:
        spark.sql(f"DROP TABLE {f'{database}.' if database else ''}{t}")
    return dropped
