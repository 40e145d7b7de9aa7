"""Streaming queries registered with the driver.

The click table of the fixture is laid out as files and run through the streaming job with ``availableNow``; each
query starts its own stream and reads the job's tables. They share the batch replay's DuckDB twins, since both must
agree when the guard's edges are the same: every click carries the number of its batch, and the job blocks users at
the end of each. A replayed log is a backlog, so a micro-batch takes consecutive numbers, about ``ROWS`` clicks at once:
a micro-batch costs seconds however few clicks it has, so a log of more than ``TRIGGERS`` numbers takes ``LEAST`` of
them unless it has many clicks, and ``TRIGGERS`` at most.
``stream_changelog_*`` fold what every batch published; the other ``stream_*`` read the current groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.plans.oracle import ADAPTERS, FINE_ADAPTERS, GUARD, LINES, guard_sql
from visitlens.plans.registry import GUARD_THRESHOLD
from visitlens.session import shared_dir
from visitlens.sources import adapters as A
from visitlens.sources import adslog
from visitlens.sources.tables import persisted
from visitlens.streaming import app

REPLAY_SCHEMA = T.StructType([
    T.StructField("ts", T.LongType()),
    T.StructField("area", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("ads_id", T.StringType()),
    T.StructField("turn", T.LongType()),
])


#: Files of a micro-batch of the replay, micro-batches of a replay at most.
FILES, TRIGGERS = 4, 12
#: Clicks that a micro-batch of the replay is meant to take, micro-batches up to which it takes fewer.
ROWS, LEAST = 500_000, 4
#: Clicks of a replay for each state partition: a micro-batch has a dozen shuffles, whose tasks cost more than a few clicks.
STATE_ROWS = 100_000


def triggers_of(rows: int, most: int = TRIGGERS) -> int:
    """Micro-batches at most for a log of so many clicks."""
    return min(most, max(LEAST, -(-rows // ROWS) + 1))


def extent() -> list[Column]:
    """The first and last batch of a log, and its clicks."""
    return [F.min("batch_id").alias("low"), F.max("batch_id").alias("high"), F.count(F.lit(1)).alias("rows")]


def span_between(low: int | None, high: int | None, rows: int, triggers: int = TRIGGERS) -> int:
    """``span_of`` for ``rows`` clicks of the batches ``low`` to ``high``."""
    if low is None or high - low < triggers - 1:
        return 1
    return -(-(high - low + 1) // max(triggers_of(rows, triggers) - 1, 1))  # spans start at multiples, not at ``low``


def span_of(df: DataFrame, triggers: int = TRIGGERS) -> int:
    """Consecutive ``batch_id`` of a micro-batch: 1 if all of ``df`` are ``triggers`` micro-batches at most, else by ``triggers_of``."""
    return span_between(*df.agg(*extent()).first(), triggers)


def write_batches(df: DataFrame, path: str, fmt: str = "parquet", first: int = 0, span: int = 1) -> int:
    """Lay ``df`` out as ``FILES`` files per ``span`` consecutive ``batch_id``, in one job. Returns the number of micro-batches.

    The guard's result depends on where batches start and end, so rows keep their ``batch_id`` as ``turn`` (before a
    tab in text files). The file source takes files by modification time: the files of a micro-batch get one time,
    later ones later times, from ``first`` on. Each file holds one blank row, so that no file of a micro-batch is
    missing; the job skips it.
    """
    spark = df.sparkSession
    if fmt == "text":
        df = df.withColumn("value", F.concat(F.col("batch_id"), F.lit("\t"), F.col("value")))
    else:
        df = df.withColumn("turn", F.col("batch_id").cast("bigint"))
    df = df.withColumn("batch_id", F.col("batch_id") - F.pmod(F.col("batch_id"), F.lit(span)))
    columns = [c for c in df.columns if c != "batch_id"]
    part = F.pmod(F.xxhash64(*columns), F.lit(FILES)).cast("int")
    blank = df.select("batch_id").distinct().select(
        *[F.lit("" if fmt == "text" else None).cast(df.schema[c].dataType).alias(c) for c in columns], "batch_id",
        F.explode(F.sequence(F.lit(0), F.lit(FILES - 1))).alias("part"))
    rows = df.select(*columns, "batch_id", part.alias("part")).unionByName(blank)
    rows.repartition("batch_id", "part").write.mode("append").partitionBy("batch_id", "part").format(fmt).save(path)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    folders = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id=*"))
    ids = sorted(int(f.getPath().getName().split("=")[1]) for f in folders)
    for turn, b in enumerate(ids):
        for file in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={b}/part=*/part-*")):
            fs.setTimes(file.getPath(), 1_500_000_000_000 + 60_000 * (first + turn), -1)
    return len(ids)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The click stream of ``write_batches``, a batch per trigger."""
    files = spark.readStream.schema(REPLAY_SCHEMA).option("maxFilesPerTrigger", str(FILES)).option("maxFileAge", "36500d")
    return files.parquet(f"{path}/batch_id=*/part=*").filter(F.col("ts").isNotNull())


def read_line_batches(spark: SparkSession, path: str) -> DataFrame:
    """The line stream of ``write_batches``, a batch per trigger."""
    files = spark.readStream.format("text").option("maxFilesPerTrigger", str(FILES)).option("maxFileAge", "36500d")
    rows = files.load(f"{path}/batch_id=*/part=*").select("value").filter(F.col("value") != "")
    tab = F.instr("value", "\t")
    return rows.select(F.expr("CAST(substring_index(value, '\t', 1) AS BIGINT)").alias("turn"),
                       F.col("value").substr(tab + 1, F.length("value")).alias("value"))


def state_partitions(spark: SparkSession, rows: int) -> int:
    """State partitions for a replay of so many clicks: one per ``STATE_ROWS``, at most one per core, whatever the batch setting."""
    try:
        most = spark.sparkContext.defaultParallelism
    except Exception:  # no driver-side context (Spark Connect)
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, -(-rows // STATE_ROWS)))


def _finished(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"stream replay failed: {q.exception()}")


def stored_clicks(spark: SparkSession, sf_dir: str, batch_rows: int) -> tuple[DataFrame, int, int]:
    """The whole click log, stored (it is read for the blank rows and the files), its span and its state partitions.

    The log's extent is observed while it is stored, which takes no job of its own.
    """
    seen = Observation()
    clicks = persisted(A.ads_log(spark, sf_dir, batch_rows).observe(seen, *extent()), "clicks")
    log = seen.get
    return clicks, span_between(log["low"], log["high"], log["rows"]), state_partitions(spark, log["rows"])


def replay(spark: SparkSession, sf_dir: str, threshold: int = GUARD_THRESHOLD, batch_rows: int = A.BATCH_ROWS) -> str:
    """Run the streaming job over the fixture's whole click log; returns the sink root."""
    root = shared_dir(spark, "stream-replay")
    clicks, span, parts = stored_clicks(spark, sf_dir, batch_rows)
    write_batches(clicks, f"{root}/src", span=span)
    _finished(app.start(read_batches(spark, f"{root}/src"), f"{root}/sink", f"{root}/checkpoint", threshold=threshold,
                        trigger={"availableNow": True}, state_partitions=parts))
    return f"{root}/sink"


def replay_lines(spark: SparkSession, sf_dir: str, threshold: int = GUARD_THRESHOLD, batch_rows: int = A.BATCH_ROWS) -> str:
    """The whole original path: text lines in -> parse -> guard -> reports."""
    root = shared_dir(spark, "stream-lines-replay")
    clicks, span, parts = stored_clicks(spark, sf_dir, batch_rows)
    write_batches(adslog.format_lines(clicks, keep=("batch_id",)), f"{root}/src", fmt="text", span=span)
    _finished(app.start_from_lines(read_line_batches(spark, f"{root}/src"), f"{root}/sink", f"{root}/checkpoint", threshold=threshold,
                                   trigger={"availableNow": True}, state_partitions=parts))
    return f"{root}/sink"


def _table(name: str, runner=replay, batch_rows: int = A.BATCH_ROWS):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return app.reports(spark, runner(spark, sf_dir, batch_rows=batch_rows))[name]
    run.__name__ = f"stream_{name}"
    return run


def folded(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The reports from everything that the batches published: totals only grow, so the largest is the last."""
    store = app.Store(spark, root)
    last = store.last()
    q5 = store.history("area_city_ads_count", last).groupBy("day", "area", "city", "ads_id")
    q5 = q5.agg(F.max("click_count").alias("click_count"))
    top = store.history("area_top3_ads", last).groupBy("day", "area").agg(F.max_by("top3_json", "batch_id").alias("top3_json"))
    return {"area_city_ads_count": q5, "area_top3_ads": top,
            "blacklist": store.history("blacklist", last).select("user_id")}


def _changelog(name: str, batch_rows: int = A.BATCH_ROWS):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return folded(spark, replay(spark, sf_dir, batch_rows=batch_rows))[name]
    run.__name__ = f"stream_changelog_{name}"
    return run


STREAM_QUERIES = {
    "stream_guard": _table("blacklist", batch_rows=A.WIDE_BATCH_ROWS),
    "stream_user_ads_click": _table("user_ads_click"),
    "stream_area_city_ads": _table("area_city_ads_count"),
    "stream_area_top3": _table("area_top3_ads"),
    "stream_lines_guard": _table("blacklist", replay_lines, A.WIDE_BATCH_ROWS),
    "stream_lines_area_city_ads": _table("area_city_ads_count", replay_lines, A.WIDE_BATCH_ROWS),
    "stream_lines_area_top3": _table("area_top3_ads", replay_lines),
    "stream_changelog_area_city_ads": _changelog("area_city_ads_count"),
    "stream_changelog_area_top3": _changelog("area_top3_ads"),
    "stream_changelog_guard": _changelog("blacklist", A.WIDE_BATCH_ROWS),
}

_W, _WF = ("WITH " + x + "," + GUARD for x in (ADAPTERS, FINE_ADAPTERS))
STREAM_ORACLE = {
    "stream_guard": _W + "\nSELECT DISTINCT user_id FROM bl",
    "stream_user_ads_click": _WF +
        "\nSELECT day, user_id, ads_id, CAST(count(*) AS BIGINT) AS click_count FROM adm GROUP BY ALL",
    "stream_area_city_ads": _WF + "\nSELECT * FROM q5",
    "stream_area_top3": _WF + "\nSELECT * FROM q6",
    "stream_changelog_area_city_ads": _WF + "\nSELECT * FROM q5",
    "stream_changelog_area_top3": _WF + "\nSELECT * FROM q6",
    "stream_changelog_guard": _W + "\nSELECT DISTINCT user_id FROM bl",
}
_WL, _WLF = ("WITH " + x + "," + LINES + "," + guard_sql("parsed_ok") for x in (ADAPTERS, FINE_ADAPTERS))
STREAM_ORACLE.update({
    "stream_lines_guard": _WL + "\nSELECT DISTINCT user_id FROM bl",
    "stream_lines_area_city_ads": _WL + "\nSELECT * FROM q5",
    "stream_lines_area_top3": _WLF + "\nSELECT * FROM q6",
})
