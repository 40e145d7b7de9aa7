"""City-share summary per group: ``A:50.0%,B:25.0%,其他:25.0%``.

The reference computes it with a map-buffer aggregate function. Here it is built-in
aggregation: no per-group map or list is ever built and no group is sorted in one task.

1. ``groupBy(keys + city).count()``                 -- combined before the shuffle
2. both from that one shuffle: totals and number of cities per group, and its two largest cities,
   reduced where the counts lie, so a group sends at most three rows a task, however many cities it has
3. ``groupBy(keys)`` puts totals and ranks together  -- same partitioning, no new exchange

``city_shares`` ranks every city of a group and so sorts them in one task: it is for results that
list them all and for groups whose cities come from a table of cities.

Semantics (fixed by the reference's output text):
  share r = floor(c / total * 1000 + 0.5) / 10, printed as a JVM double (``33.3``, ``100.0``)
  the two largest shares are listed (ties: larger count, then city name ascending)
  when there are more than two cities a remainder ``其他:x%`` follows, with
  x = floor((100 - r1 - r2) * 10 + 0.5) / 10 (no correction: parts may sum to 100.1)
  a null city name prints as ``null`` (string concatenation on the JVM).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitlens.fixed import NAME_SEP, OTHER_LABEL, PART_SEP, PCT_SUFFIX, TOP_CITIES
from visitlens.functions.text import half_up_tenths, pct_text, round_half_up_1dp


def city_counts(clicks: DataFrame, keys: Sequence[str], city: str = "city_name") -> DataFrame:
    """Clicks per (keys, city): the shuffle-combined counter map of the reference."""
    return clicks.groupBy(*keys, city).agg(F.count(F.lit(1)).alias("city_clicks"))


def city_shares(counts: DataFrame, keys: Sequence[str], city: str = "city_name") -> DataFrame:
    """Per (keys, city): clicks, group total, number of cities, share and rank in group."""
    w_all = Window.partitionBy(*keys)
    w_ord = Window.partitionBy(*keys).orderBy(F.col("city_clicks").desc(), F.col(city).asc_nulls_first())
    return (counts
            .withColumn("clickcount", F.sum("city_clicks").over(w_all))
            .withColumn("n_cities", F.count(F.lit(1)).over(w_all))
            .withColumn("share", half_up_tenths(F.col("city_clicks").cast("double")
                                                / F.col("clickcount").cast("double")))
            .withColumn("city_rank", F.row_number().over(w_ord)))


def top_cities(counts: DataFrame, keys: Sequence[str], city: str = "city_name") -> DataFrame:
    """Per group, in at most three rows: ``clickcount`` and ``n_cities`` in one, a largest city with its rank in each other."""
    w = Window.partitionBy(*keys).orderBy(F.col("city_clicks").desc(), F.col(city).asc_nulls_first())
    top = counts.withColumn("city_rank", F.row_number().over(w)).where(F.col("city_rank") <= TOP_CITIES)
    totals = counts.groupBy(*keys).agg(F.sum("city_clicks").alias("clickcount"), F.count(F.lit(1)).alias("n_cities"))
    return top.select(*keys, city, "city_clicks", "city_rank").unionByName(totals, allowMissingColumns=True)


def city_summary(top: DataFrame, keys: Sequence[str], city: str = "city_name") -> DataFrame:
    """Per group: clickcount and the city_remark text (A6, T2, T3), from the rows of ``top_cities`` or the top ones of ``city_shares``."""
    g = top.groupBy(*keys).agg(
        F.max("clickcount").alias("clickcount"),
        F.max("n_cities").alias("n_cities"),
        *[F.max(F.when(F.col("city_rank") == i + 1, F.col("city_clicks"))).alias(f"c{i + 1}") for i in range(TOP_CITIES)],
        *[F.max(F.when(F.col("city_rank") == i + 1, F.coalesce(F.col(city), F.lit("null")))).alias(f"n{i + 1}")
          for i in range(TOP_CITIES)])
    total = F.col("clickcount").cast("double")
    shares = g.select("*", *[half_up_tenths(F.col(f"c{i + 1}").cast("double") / total).alias(f"r{i + 1}")
                             for i in range(TOP_CITIES)])
    parts = [pct_text(F.col(f"n{i + 1}"), f"r{i + 1}") for i in range(TOP_CITIES)]
    other = round_half_up_1dp(F.lit(100.0) - F.col("r1") - F.col("r2"))
    remark = F.concat_ws(PART_SEP, *parts,
                         F.when(F.col("n_cities") > TOP_CITIES, pct_text(F.lit(OTHER_LABEL), other)))
    return shares.select(*keys, F.col("clickcount"), remark.alias("city_remark"))


def city_ratio(clicks: DataFrame, keys: Sequence[str], city: str = "city_name") -> DataFrame:
    """``group by keys: count(*) AS clickcount, city_ratio(city) AS city_remark``."""
    return city_summary(top_cities(city_counts(clicks, keys, city), keys, city), keys, city)


# The same recipe as Spark SQL text over a view with columns (keys..., city_name), for
# users that chain SQL steps through temp views. Built-in functions only: partial
# aggregation and codegen apply exactly as in the DataFrame version.
CITY_RATIO_SQL = (
    """
WITH c AS (
  SELECT {keys}, city_name, count(*) AS city_clicks
  FROM {view} GROUP BY {keys}, city_name
), s AS (
  SELECT {keys}, city_name, city_clicks,
         sum(city_clicks) OVER (PARTITION BY {keys}) AS clickcount,
         count(*) OVER (PARTITION BY {keys}) AS n_cities,
         floor(CAST(city_clicks AS DOUBLE) / CAST(sum(city_clicks) OVER (PARTITION BY {keys}) AS DOUBLE)
               * 1000 + 0.5) / 10 AS share,
         row_number() OVER (PARTITION BY {keys} ORDER BY city_clicks DESC, city_name ASC NULLS FIRST) AS city_rank
  FROM c
), g AS (
  SELECT {keys}, max(clickcount) AS clickcount, max(n_cities) AS n_cities,
         max(CASE WHEN city_rank = 1 THEN share END) AS r1,
         max(CASE WHEN city_rank = 2 THEN share END) AS r2,
         max(CASE WHEN city_rank = 1 THEN concat(coalesce(city_name, 'null'), '""" + NAME_SEP
    + """', CAST(share AS STRING), '""" + PCT_SUFFIX + """') END) AS p1,
         max(CASE WHEN city_rank = 2 THEN concat(coalesce(city_name, 'null'), '""" + NAME_SEP
    + """', CAST(share AS STRING), '""" + PCT_SUFFIX + """') END) AS p2
  FROM s WHERE city_rank <= """ + str(TOP_CITIES) + """ GROUP BY {keys}
)
SELECT {keys}, clickcount,
       concat_ws('""" + PART_SEP + """', p1, p2,
                 CASE WHEN n_cities > """ + str(TOP_CITIES) + """ THEN
                   concat('""" + OTHER_LABEL + NAME_SEP + """', CAST(floor((100.0 - r1 - r2) * 10 + 0.5) / 10 AS STRING),
                          '""" + PCT_SUFFIX + """')
                 END) AS city_remark
FROM g
""")


def city_ratio_sql(spark, view: str, keys: Sequence[str]) -> DataFrame:
    return spark.sql(CITY_RATIO_SQL.format(keys=", ".join(keys), view=view))


# The summary text as a function that users call by name in their own SQL, over an array of
# (city, clicks): one entry per city of a group, made by the per-city counts before it. Built-in
# expressions only; each ``transform`` over a one-element array names an intermediate value.
CITY_RATIO_FUNCTION = f"""
CREATE OR REPLACE TEMPORARY FUNCTION city_ratio(counts ARRAY<STRUCT<city: STRING, n: BIGINT>>)
RETURNS STRING
RETURN transform(array(named_struct(
    'top', slice(array_sort(counts, (a, b) -> CASE
             WHEN a.n > b.n THEN -1 WHEN a.n < b.n THEN 1
             WHEN a.city IS NULL AND b.city IS NULL THEN 0 WHEN a.city IS NULL THEN -1 WHEN b.city IS NULL THEN 1
             WHEN a.city < b.city THEN -1 WHEN a.city > b.city THEN 1 ELSE 0 END), 1, {TOP_CITIES}),
    'total', CAST(aggregate(counts, 0L, (t, x) -> t + x.n) AS DOUBLE),
    'cities', size(counts))), g ->
  transform(array(transform(g.top, x -> named_struct(
      'city', coalesce(x.city, 'null'), 'share', floor(CAST(x.n AS DOUBLE) / g.total * 1000 + 0.5) / 10))), p ->
    concat_ws('{PART_SEP}', transform(p, x -> concat(x.city, '{NAME_SEP}', CAST(x.share AS STRING), '{PCT_SUFFIX}')),
      CASE WHEN g.cities > {TOP_CITIES} THEN concat('{OTHER_LABEL}{NAME_SEP}', CAST(
        floor(aggregate(p, 100.0D, (r, x) -> r - x.share) * 10 + 0.5) / 10 AS STRING), '{PCT_SUFFIX}') END))[0])[0]
"""


def register_city_ratio(spark) -> None:
    """Make ``city_ratio(array of (city, clicks))`` callable in the session's SQL."""
    spark.sql(CITY_RATIO_FUNCTION)
