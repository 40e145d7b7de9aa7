"""Visit filter: the visits whose user is known, inside optional date and age bounds.

The date bound is a visit-side predicate and the age bound a user-side one; both are applied
before the join so they reach the parquet scans as pushed filters. Only visit columns come out. A
user id that appears twice in ``user_info`` multiplies its visits (inner-join fan-out, kept on
purpose). Both sides of the join are scans: AQE splits a user that holds a large share of the visits,
and where the bounds leave few users Spark filters the visits by a Bloom filter of them before the
shuffle (``CLUSTER_CONF`` has the sizes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.sources.params import VisitFilter, apply


def filtered_users(users: DataFrame, flt: VisitFilter) -> DataFrame:
    return apply(users.select("user_id", "age"), flt.age_predicate("age")).select("user_id")


def filter_visits(visits: DataFrame, users: DataFrame, flt: VisitFilter) -> DataFrame:
    """Row-level result (J1, P1, P3, P4): every visit column, one row per matching user row."""
    v = apply(visits, flt.date_predicate("date"))
    u = filtered_users(users, flt)
    return v.join(u, "user_id").select(*v.columns)


def user_multiplicity(users: DataFrame, flt: VisitFilter) -> DataFrame:
    """Matching user rows per user id: how often the join repeats each of that user's visits.

    Lets aggregations count visits *before* the join (eager aggregation) and multiply after,
    which keeps a hot user from sending all of its raw rows through one join task.
    """
    return filtered_users(users, flt).groupBy("user_id").agg(F.count(F.lit(1)).alias("mult"))
