"""Click guard of the streaming job, from built-in operators (St3).

Before a user is blocked everything is admitted, so the running count of *all* clicks per (day, user, ad)
reaches the threshold in the same micro-batch as the count of admitted ones. The job therefore counts all
clicks by a built-in streaming aggregation (a point update per touched key in the state store, map-side
partial counts before the shuffle) and passes the clicks themselves along. Per micro-batch, users whose
count reached the threshold are appended to the block table, and clicks are admitted by an anti join with
the users blocked in earlier batches; the crossing batch itself stays admitted.

A log may carry its own numbering of the guard's batches in ``turn`` (a replayed or late log whose edges are
given). A micro-batch then takes any number of turns: the running counts at the end of each turn follow from the
counts of all clicks and the clicks of the later turns, so users are blocked at the end of the very turn in which
they crossed. Without ``turn``, a micro-batch is one turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTED = ["day", "user_id", "ads_id"]
CLICK = ["day", "area", "city", "user_id", "ads_id"]


def guarded_stream(clicks: DataFrame) -> DataFrame:
    """Clicks (``day, area, city, user_id, ads_id, turn, bad``) and, with ``total``, the changed counts of all clicks.

    ``bad`` holds a malformed line, whose other columns do not count. Rows with ``total`` are one per
    (day, user, ad) that the micro-batch touched.
    """
    counts = clicks.filter(F.col("bad").isNull()).groupBy(*COUNTED).agg(F.count(F.lit(1)).alias("total"))
    turn = F.col("turn") if "turn" in clicks.columns else F.lit(0)
    rows = clicks.select(*CLICK, turn.cast("bigint").alias("turn"), "bad").withColumn("total", F.lit(None).cast("bigint"))
    return rows.unionByName(counts, allowMissingColumns=True)


def newly_blocked(totals: DataFrame, before: DataFrame | None, threshold: int) -> DataFrame:
    """Users whose count reached the threshold and who were not blocked before."""
    return unblocked(totals.filter(F.col("total") >= threshold).select("user_id").distinct(), before)


def unblocked(rows: DataFrame, before: DataFrame | None) -> DataFrame:
    """Rows of users that are not in the block table ``before`` (none yet: None)."""
    return rows if before is None else rows.join(before, "user_id", "left_anti")


def click_counts(clicks: DataFrame) -> DataFrame:
    """Clicks of a micro-batch -> ``n`` per key (and turn): a hot user is a row per task and key before any shuffle."""
    return clicks.groupBy(*CLICK, *[c for c in clicks.columns if c == "turn"]).agg(F.count(F.lit(1)).alias("n"))


def blocked_turns(totals: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """(user_id, turn) of the users in ``totals`` that a micro-batch blocks: the turn at whose end each crossed.

    ``totals`` counts all clicks up to the end of the micro-batch, ``counts`` (``click_counts``) its own by turn.
    """
    rows = counts.select(*COUNTED, "turn", "n").unionByName(totals.select(*COUNTED, "total"), allowMissingColumns=True)
    rows = rows.repartition(*COUNTED)  # once for the steps and their window; ``counts`` has few rows per key
    both = rows.groupBy(*COUNTED, "turn").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
    none = F.lit(0).cast("bigint")
    later = Window.partitionBy(*COUNTED).orderBy(F.desc_nulls_first("turn")).rowsBetween(Window.unboundedPreceding, -1)
    at_end = F.sum(F.coalesce("total", none) - F.coalesce("n", none)).over(later)
    crossed = both.withColumn("at_end", at_end).filter(F.col("turn").isNotNull() & (F.col("at_end") >= threshold))
    return crossed.groupBy("user_id").agg(F.min("turn").alias("turn"))


def _until(blocked: DataFrame) -> DataFrame:
    return blocked.select("user_id", F.col("turn").alias("blocked_turn"))


def _late() -> Column:
    return F.col("turn") > F.col("blocked_turn")


def admitted_counts(counts: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows of ``counts`` without the turns after that in which their user was ``blocked``."""
    rows = counts.join(_until(blocked), "user_id", "left")
    return rows.filter(F.col("blocked_turn").isNull() | ~_late()).drop("blocked_turn", "turn")


def user_totals(totals: DataFrame, counts: DataFrame, blocked: DataFrame) -> DataFrame:
    """Admitted clicks so far per (day, user, ad) of ``totals``: all but those after the user was ``blocked``."""
    late = counts.join(_until(blocked), "user_id").filter(_late()).select(*COUNTED, (-F.col("n")).alias("total"))
    rows = totals.select(*COUNTED, "total").unionByName(late).groupBy(*COUNTED).agg(F.sum("total").alias("click_count"))
    return rows.filter(F.col("click_count") > 0)
