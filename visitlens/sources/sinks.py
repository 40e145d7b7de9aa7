"""Sinks: managed / external table overwrite and JDBC append.

All writes are done by executors through Spark's writers (commit protocol, task retries);
nothing is collected to the driver first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overwrite_table(df: DataFrame, name: str, path: str | None = None, fmt: str = "parquet",
                    partition_by: list[str] | None = None) -> None:
    """Replace a catalog table with ``df`` (drop-if-exists + save as table, S4).

    With ``path`` the table is external and lives in that (shared) folder. ``partition_by``
    (e.g. ``["date"]``) lets later date filters prune whole folders.
    """
    w = df.write.mode("overwrite").format(fmt)
    if path:
        w = w.option("path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def with_task_id(df: DataFrame, task_id: str) -> DataFrame:
    """Prefix a report with its run id (the first positional column of the report tables)."""
    return df.select(F.lit(task_id).alias("task_id"), *[c for c in df.columns if c != "task_id"])


def jdbc_append(df: DataFrame, url: str, table: str, properties: dict | None = None,
                batch_size: int = 1000, max_connections: int | None = None) -> None:
    """Append rows over JDBC (S9 / S10): batched inserts, one transaction per task.

    ``max_connections`` caps concurrent writers (Spark coalesces to that many partitions); with 1
    the whole insert is one transaction, which suits reports cut to their top rows. Rows are never
    funnelled through the driver.
    """
    props = dict(properties or {})
    props.setdefault("batchsize", str(batch_size))
    if max_connections:
        props.setdefault("numPartitions", str(max_connections))
    df.write.jdbc(url, table, mode="append", properties=props)


def jdbc_insert_row(spark: SparkSession, url: str, table: str, values: tuple,
                    schema: T.StructType, properties: dict | None = None) -> None:
    """Insert one row (S11) through the same writer."""
    jdbc_append(spark.createDataFrame([values], schema), url, table, properties)


def jdbc_read(spark: SparkSession, url: str, table: str, properties: dict | None = None) -> DataFrame:
    return spark.read.jdbc(url, table, properties=dict(properties or {}))
