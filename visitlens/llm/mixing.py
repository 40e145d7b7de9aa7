"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded draw.

Sizes are summed per source, targets are shared out by weight under a cap of ``MAX_RATE`` times a
source's size, and a source's rate is target / size. A document is emitted ``floor(rate)`` times
and once more if its hash draw falls below the fraction. The draw depends on the seed and the
document's id alone, so reruns and retried tasks agree. One draw per document leaves a source of few
or unequal documents off its target, so the draws of a source are shifted round the circle by the one of
``SHIFTS`` equal steps that comes nearest: each draw stays uniform, and the shift follows from sums of the
sizes by source and step of the circle, whatever their number of documents.

Defined results: a null or empty text has size 0 and is emitted like any other document of its
source; a null source is a source of its own, last in order; a source whose documents are all
empty has target 0 and no copies; repeated rows draw alike; empty tables give empty results.
Working columns are built from ``doc_id``, ``source`` and ``text`` only; ``emit`` returns the
input's own columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.llm.common import n_words, persisted, read

#: Fixed values of the query contract.
WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = "mix"
#: Steps of the circle that a source's draws may be shifted by, a power of two; tasks a source is spread over.
SHIFTS = 64
SALTS = 32


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1): 52 bits of MD5 over the seed and the id."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """Per source ``source, source_size, target``: all sizes shared by weight, capped at ``max_rate`` times its size.

    ``sizes`` has ``source`` and ``size``. Weights repeat over the sources by code point, null last.
    Taking capped sources out and sharing their excess by weight, until none is above, ends at one
    share per weight: sources in order of cap / weight are capped until the first whose share fits.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    ranked = per.select("*", weight.cast("double").alias("weight"), (F.lit(max_rate) * F.col("source_size")).alias("cap"))
    every = Window.partitionBy(F.lit(0))
    rising = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shares = ranked.select("*", (left.cast("double") / weight_left).alias("share"))
    fits = F.col("share") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "share"))).over(every)["share"]
    target = F.when(fits, F.col("level") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    target = F.least(target, F.col("cap").cast("double"))
    return shares.withColumn("level", level).select("source", "source_size", target.alias("target"))


def with_rates(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``source``) and the columns of ``targets`` for their source.

    The join is salted by document, so a source that holds a third of all rows is spread over ``SALTS``
    tasks; Spark broadcasts the table of sources where its size allows.
    """
    salt = F.expr(f"CAST(pmod(xxhash64(doc_id), {SALTS}) AS INT)")
    t = targets.withColumnRenamed("source", "t_source").withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col("source").eqNullSafe(F.col("t_source"))
    out = docs.withColumn("salt", salt).join(t, same & (F.col("salt") == F.col("t_salt")))
    return out.drop("t_source", "salt", "t_salt")


def shifted_targets(sized: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """``targets`` with ``whole`` and ``part`` of the rate and the ``shift`` whose taken words are nearest the target."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select("*", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part"))
    # A draw lies in a step of the circle and at some place of it; a shift moves the step and leaves the place.
    at = draw(F.col("doc_id"), seed) * SHIFTS
    edge = F.col("part") * SHIFTS
    rows = with_rates(sized, targets.select("source", "part")).select("source", "size", "part", at.alias("at"))
    inside = F.when(F.col("at") - F.floor("at") < edge - F.floor(edge), F.col("size")).otherwise(0)
    steps = rows.groupBy("source", "part", F.floor("at").alias("step")).agg(F.sum("size").alias("all"), F.sum(inside).alias("some"))
    tried = steps.select("*", F.explode(F.sequence(F.lit(0), F.lit(SHIFTS - 1))).alias("shift"))
    now = (F.col("step") + F.col("shift")) % SHIFTS
    taken = F.when(now < F.floor(edge), F.col("all")).when(now == F.floor(edge), F.col("some")).otherwise(0)
    tried = tried.groupBy("source", "shift").agg(F.sum(taken).alias("extra")).withColumnRenamed("source", "s")
    both = tried.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    off = F.abs(F.col("whole") * F.col("source_size") + F.col("extra") - F.col("target"))
    best = both.groupBy(*targets.columns).agg(F.min(F.struct(off, "shift"))["shift"].alias("shift"))
    return best


def _times(seed: str) -> Column:
    moved = draw(F.col("doc_id"), seed) + F.col("shift") / F.lit(float(SHIFTS))
    moved = F.when(moved >= 1, moved - 1).otherwise(moved)
    return (F.col("whole") + F.when(moved < F.col("part"), 1).otherwise(0)).cast("long")


def _planned(docs: DataFrame, weights: Sequence[int], max_rate: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """Stored sizes of the documents, and the stored plan of the sources."""
    sized = persisted(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    targets = persisted(source_targets(sized, weights, max_rate), "mix-targets")
    return sized, persisted(shifted_targets(sized, targets, seed), "mix-plan")


def copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, copies``."""
    sized, plan = _planned(docs, weights, max_rate, seed)
    return with_rates(sized, plan).select("doc_id", "size", "source_size", "target", _times(seed).alias("copies"))


def emit(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mix itself: every document of ``docs`` as often as it is taken, with its own columns."""
    _, plan = _planned(docs, weights, max_rate, seed)
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source")
    rated = with_rates(row, plan.select("source", "whole", "part", "shift"))
    return rated.select("row", F.explode(F.array_repeat(F.lit(0), _times(seed).cast("int")))).select("row.*")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    out = copies(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_MIX_CTES = r"""
sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM {docs}
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM per
), shared AS (
  SELECT *, cap / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0.0)) AS share
  FROM weighted
  WINDOW up AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(share, ratio) AS level FROM shared WHERE share * weight <= cap
), targets AS (
  SELECT source, source_size,
         least(CASE WHEN share * weight <= cap THEN level * weight ELSE cap::DOUBLE END, cap::DOUBLE) AS target,
         CASE WHEN source_size > 0 THEN
           least(CASE WHEN share * weight <= cap THEN level * weight ELSE cap::DOUBLE END, cap::DOUBLE) / source_size
         ELSE 0.0 END AS rate
  FROM shared, level
), drawn AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, floor(t.rate) AS whole, t.rate - floor(t.rate) AS part,
         ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), tried AS (
  SELECT source, k, abs(sum(size * (whole + CASE WHEN u + k / 64.0::DOUBLE - floor(u + k / 64.0::DOUBLE) < part THEN 1 ELSE 0 END))
                        - any_value(target)) AS off
  FROM drawn, range(64) r(k) GROUP BY source, k
), chosen AS (
  SELECT source, k FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1
), mixed AS (
  SELECT doc_id, size, source_size, target,
         (whole + CASE WHEN u + k / 64.0::DOUBLE - floor(u + k / 64.0::DOUBLE) < part THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM drawn JOIN chosen ON drawn.source IS NOT DISTINCT FROM chosen.source
)"""
OP6_SQL = f"WITH {_MIX_CTES.format(docs='documents')} SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed"
