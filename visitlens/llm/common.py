"""Small pieces shared by the operators: table reads, shared scratch tables, word patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.session import shared_dir

#: Fixed value of the query contracts: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch of texts.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder below the session's shared checkpoint root and read it back.

    Cuts the lineage with files every executor sees, so that a lost executor costs a task and
    not the job.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "llm", name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame, name: str) -> DataFrame:
    """``persisted``, but the shuffle files of ``df`` go as soon as it is written, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    had = conf.get(CLEANUP_KEY, None)
    conf.set(CLEANUP_KEY, "true")
    try:
        return persisted(df, name)
    finally:
        if had is None:
            conf.unset(CLEANUP_KEY)
        else:
            conf.set(CLEANUP_KEY, had)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the Arrow batches of its session that hold whole texts, unless somebody chose a bound.

    The default of 10,000 rows is hundreds of megabytes of long documents, in the JVM and in Python.
    """
    spark = df.sparkSession
    if BATCH_KEY not in {r["key"] for r in spark.sql("SET").collect()}:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    return df


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of words; null and empty texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words (long); null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
