"""Table scans (catalog or parquet path) bound to the fixed schemas, and small local tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.fixed import PREVIEW_ROWS
from visitlens.session import shared_dir


def read_table(spark: SparkSession, name_or_path: str, fmt: str = "parquet") -> DataFrame:
    """Catalog table by name, else a file path (parquet by default).

    Column pruning and filter pushdown happen at the scan because the result stays a
    DataFrame; callers only ``select`` what they use.
    """
    if "/" not in name_or_path and spark.catalog.tableExists(name_or_path):
        return spark.table(name_or_path)
    return spark.read.format(fmt).load(name_or_path)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bind a scan to a schema by column name: select + cast, extra columns dropped.

    This replaces a typed-object conversion: the plan stays columnar and prunable.
    """
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder below the shared checkpoint root and read it back.

    Cuts the lineage with files that every executor sees: later uses do not run ``df`` again, and a
    lost executor costs a task.
    """
    path = shared_dir(df.sparkSession, "tables", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def from_rows(spark: SparkSession, rows: Iterable, schema: T.StructType) -> DataFrame:
    """A local collection as a table (small, driver-side input such as test rows)."""
    return spark.createDataFrame(list(rows), schema)


def preview(spark: SparkSession, name_or_path: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows of a table (``select * ... show(n)``); the limit is the feature."""
    return read_table(spark, name_or_path).limit(n)
