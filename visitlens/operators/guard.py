"""Click guard and ad counters over a click log with micro-batch numbers (Q4, Q5, Q6).

Guard semantics, per micro-batch in this order: drop users blocked at batch start; count
the rest per (day, user, ad) into never-reset totals; block a user once any total reaches
the threshold. The whole crossing batch is still admitted; a block holds for all ads and all
later days.

Closed form used here (no recursion, no driver loop): before a user is blocked everything
is admitted, so with ``cum`` = running total per (day, user, ad) over batches,
``blocked_batch(user) = min(batch where cum >= T)`` and a row is admitted iff
``blocked_batch is null or batch_id <= blocked_batch``.

Scale: every step first collapses rows to (batch, key) counts with map-side partial
aggregation, so a user or ad with a third of all clicks becomes a handful of rows per batch
before any shuffle. Running totals are taken per (day, user, ad) and a user's block batch is a
partially aggregated minimum: nothing is dealt by user alone. The block table (one row per
blocked user) then meets the counts, or the raw rows, in a join whose hot users are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitlens.fixed import BLOCK_THRESHOLD, TOP_ADS
from visitlens.functions.text import ads_json, epoch_ms_to_day
from visitlens.operators.joins import HOT_SHARE, hot_key_join
from visitlens.operators.topk import top_n_per_group
from visitlens.sources.tables import persisted

DEFAULT_THRESHOLD = BLOCK_THRESHOLD  # clicks on one ad by one user in one day


def with_day(ads: DataFrame) -> DataFrame:
    return ads if "day" in ads.columns else ads.withColumn("day", epoch_ms_to_day("ts"))


def _blocked_from_counts(per: DataFrame, threshold: int) -> DataFrame:
    """(user_id, blocked_batch) from click counts per (batch, day, user, ad, ...) in ``n``."""
    key_counts = per.groupBy("batch_id", "day", "user_id", "ads_id").agg(F.sum("n").alias("n"))
    w = (Window.partitionBy("day", "user_id", "ads_id").orderBy("batch_id")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    crossed = key_counts.withColumn("cum", F.sum("n").over(w)).filter(F.col("cum") >= threshold)
    return crossed.groupBy("user_id").agg(F.min("batch_id").alias("blocked_batch"))


def _counts(ads: DataFrame, keys: tuple) -> DataFrame:
    return with_day(ads).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def blocked_users(ads: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """(user_id, blocked_batch): the batch at whose end each user gets blocked."""
    return _blocked_from_counts(_counts(ads, ("batch_id", "day", "user_id", "ads_id")), threshold)


def _admitted(rows: DataFrame, blocked: DataFrame, hot: list | None = None) -> DataFrame:
    j = hot_key_join(rows, blocked, "user_id", "left", hot=hot)
    return (j.filter(F.col("blocked_batch").isNull() | (F.col("batch_id") <= F.col("blocked_batch")))
             .drop("blocked_batch"))


def _busy_users(counts: DataFrame) -> list:
    """Users with more than one in ``HOT_SHARE`` of the clicks that ``counts`` sums up: fewer than ``HOT_SHARE``."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    users = counts.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.sum("n").alias("n"))
    return [r[0] for r in users.filter(F.col("n") * HOT_SHARE > total).select("user_id").collect()]


def admitted_clicks(ads: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Row-level guard output: the clicks that pass the blacklist.

    The clicks are read twice: once for stored counts, which give the block table and the busy users, and
    once for the admission join.
    """
    a = with_day(ads)
    per = persisted(_counts(a, ("batch_id", "day", "user_id", "ads_id")), "user-click-counts")
    return _admitted(a, _blocked_from_counts(per, threshold), _busy_users(per))


def admitted_counts(ads: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Admitted clicks pre-aggregated per (batch, user, day, area, city, ad) -> n.

    The counts are written once to the shared folder and read for the block table, the hot users
    and the admission join.
    """
    per = persisted(_counts(ads, ("batch_id", "user_id", "day", "area", "city", "ads_id")), "click-counts")
    return _admitted(per, _blocked_from_counts(per, threshold))


def user_ad_day_counts(admitted: DataFrame) -> DataFrame:
    """Admitted clicks per (day, user, ad): the guard's counters."""
    return (admitted.groupBy("day", "user_id", "ads_id")
                    .agg(F.sum("n").cast("bigint").alias("click_count")))


def area_city_ads_count(admitted: DataFrame) -> DataFrame:
    """Running totals per (day, area, city, ad)."""
    return (admitted.groupBy("day", "area", "city", "ads_id")
                    .agg(F.sum("n").cast("bigint").alias("click_count")))


def area_ads_rollup(city_counts: DataFrame) -> DataFrame:
    """Totals per (day, area, ad): the city level summed away."""
    return (city_counts.groupBy("day", "area", "ads_id")
                       .agg(F.sum("click_count").cast("bigint").alias("click_count")))


def area_top3_ads(city_counts: DataFrame, n: int = TOP_ADS) -> DataFrame:
    """(day, area, top3_json): ``[{"ad":count},...]`` by count desc, ad id asc.

    The list per group is cut to ``n`` before it is collected, so it is bounded by ``n``.
    """
    top = top_n_per_group(area_ads_rollup(city_counts), ["day", "area"],
                          [F.col("click_count").desc(), F.col("ads_id").asc()], n, rank_col="rn")
    return ads_texts(top, "rn").select("day", "area", "top3_json")


def ads_texts(top: DataFrame, rank_col: str) -> DataFrame:
    """Ranked rows (day, area, ads_id, click_count) -> per (day, area) their list ``ads`` in rank order and its JSON text."""
    g = top.groupBy("day", "area").agg(F.array_sort(F.collect_list(F.struct(rank_col, "ads_id", "click_count"))).alias("ads"))
    pairs = F.transform("ads", lambda a: F.struct(a["ads_id"].alias("ads_id"), a["click_count"].alias("count")))
    return g.withColumn("pairs", pairs).withColumn("top3_json", ads_json("pairs")).drop("pairs")


def area_top3_ads_by_day(top3: DataFrame) -> DataFrame:
    """(day, areas_json): one JSON object per day, area -> top-3 JSON text, areas ascending.

    One entry per area: the list is bounded by the number of areas, not by the data.
    """
    g = top3.groupBy("day").agg(
        F.array_sort(F.collect_list(F.struct("area", "top3_json"))).alias("areas"))
    return g.select("day", F.to_json(F.map_from_entries("areas")).alias("areas_json"))
