"""Visits and users placed side by side once, so that every later join of them needs no shuffle.

Both tables are bucketed and sorted by (user, salt), the visits below a folder per day. A report's date bound opens
its days only, and the join reads bucket i of one table against bucket i of the other: no exchange on either side.

Adaptive execution cannot split a bucket, so hot users are split when the tables are written: users with more than
one in ``HOT_SHARE`` visits get one of ``SALTS`` salts and their rows of the user table are repeated once for each
(at most ``2 * HOT_SHARE`` users). Visits without a user join nothing and are salted alike. The salt comes from a
row's columns and place, so many equal rows are spread too; the visits should be a scan or a stored table, whose rows
keep their place when a task runs again.

Defined results, those of ``filter_visits``: visits of unknown or null users join nothing; a user row that occurs
twice doubles its visits; empty and null dates are kept as they are and share the folder of no day; empty tables give
empty results; visit columns beyond the schema are kept, but for ``__salt`` and ``__day``, which are the layout's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.operators.joins import SALT, SALTS, hot_keys
from visitlens.sources.params import VisitFilter, apply
from visitlens.sources.versions import Layout, current, replace_tables

DAY = "__day"


def _salt(key: str, columns: list[str], hot: list):
    spread = F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(SALTS))
    return F.when(F.col(key).isNull() | F.col(key).isin(hot), spread).otherwise(F.lit(0)).cast("int").alias(SALT)


def place(visits: DataFrame, users: DataFrame, name: str, buckets: int | None = None, root: str | None = None) -> str:
    """Write both tables as a new version of ``name``, a view on the visits; the version.

    A bucket is one task of every later join; unless given, there are as many as the session has shuffle partitions.
    """
    clash = {SALT, DAY} & {c for df in (visits, users) for c in df.columns}
    if clash:
        raise ValueError(f"columns of the layout itself: {sorted(clash)}")
    spark = visits.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(visits, "user_id")
    placed = visits.select("*", _salt("user_id", visits.columns, hot), F.col("date").alias(DAY))
    copies = F.when(F.col("user_id").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = users.where(F.col("user_id").isNotNull()).select("*", F.explode(copies).alias(SALT))
    key = ("user_id", SALT)
    return replace_tables(spark, name, {
        "visits": (placed, Layout(partition_by=(DAY,), bucket_by=key, buckets=buckets)),
        "users": (known, Layout(bucket_by=key, buckets=buckets))}, root)


def filter_placed(spark: SparkSession, name: str, flt: VisitFilter) -> DataFrame:
    """``filter_visits`` of the tables that ``place`` wrote: the same rows, joined without an exchange."""
    visits, users = current(spark, name, "visits", "users")
    out = [c for c in visits.columns if c not in (SALT, DAY)]
    day = flt.date_predicate(DAY)
    if day is not None:  # an empty date text has no folder of its own, so the null folder is opened as well
        visits = visits.where(day | F.col(DAY).isNull()).where(flt.date_predicate("date"))
    users = apply(users.select("user_id", SALT, "age"), flt.age_predicate("age"))
    return visits.join(users.select("user_id", SALT), ["user_id", SALT]).select(*out)
