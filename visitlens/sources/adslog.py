"""Ad-click log lines: source, parser and writer.

Line format (space separated): ``<epoch ms> <area> <city> <user id> <ad id>``.
Fields are taken by position after a Java-style ``split(" ")``, so a field holding a
space shifts the later ones (kept: it is the line format's own limit); extra fields are
ignored; a line with fewer than five fields, or a time that is no number or lies outside
the years 1 to 9999, is rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.functions.text import epoch_ms_to_day, java_split

FIELDS = ("ts", "area", "city", "user_id", "ads_id")
#: Epoch milliseconds of 0001-01-01 and of the end of 9999: days outside have no date text.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def kafka_lines(spark: SparkSession, bootstrap_servers: str, topic: str,
                starting_offsets: str = "latest", extra: dict | None = None) -> DataFrame:
    """Streaming ``value STRING`` from a Kafka topic.

    Offsets live in the query checkpoint (exactly-once with the state), instead of being
    auto-committed apart from the outputs. Needs the spark-sql-kafka package on the cluster.
    """
    opts = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topic,
            "startingOffsets": starting_offsets}
    opts.update(extra or {})
    return (spark.readStream.format("kafka").options(**opts).load()
                 .select(F.col("value").cast("string").alias("value")))


def file_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``value STRING`` from text files; a micro-batch takes all new files by default."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path).select("value")


def parse_lines(lines: DataFrame, value_col: str = "value", failfast: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Lines -> (ts BIGINT, area, city, user_id, ads_id STRING, day, valid BOOLEAN), and the columns in ``keep``.

    ``failfast=True`` raises on the first bad line, as the original job did; by default bad
    lines stay as ``valid = false`` rows for a reject table.
    """
    parts = java_split(F.col(value_col), " ")
    ts = F.expr("try_cast(get(__p, 0) AS BIGINT)")
    valid = F.coalesce((F.size("__p") >= 5) & ts.between(FIRST_MS, LAST_MS), F.lit(False))
    if failfast:
        valid = F.when(valid, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("malformed ads log line: "), F.col(value_col))))
    out = lines.withColumn("__p", parts).select(
        F.col(value_col),
        ts.alias("ts"),
        *[F.get(F.col("__p"), i).alias(name) for i, name in enumerate(FIELDS) if i > 0],
        valid.alias("valid"),
        *keep,
    )
    # A day only for valid lines: another time may overflow, which would stop a stream for good.
    return out.withColumn("day", F.when(F.col("valid"), epoch_ms_to_day("ts")))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("valid").select(*FIELDS, "day")


def rejected(parsed: DataFrame, value_col: str = "value") -> DataFrame:
    return parsed.filter(~F.col("valid")).select(value_col)


def _jvm_text(c: str) -> Column:
    # string concatenation on the JVM prints a null field as "null"
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def format_lines(ads: DataFrame, keep: tuple = ()) -> DataFrame:
    """Typed click rows -> one ``value`` line each (the producer's format)."""
    return ads.select(*keep, F.concat_ws(" ", *[_jvm_text(c) for c in FIELDS]).alias("value"))


def write_kafka(lines: DataFrame, bootstrap_servers: str, topic: str) -> None:
    """Batch write of lines to a Kafka topic (needs the spark-sql-kafka package)."""
    (lines.select("value").write.format("kafka")
          .option("kafka.bootstrap.servers", bootstrap_servers).option("topic", topic).save())
