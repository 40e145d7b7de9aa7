"""The streaming job: click lines -> guard -> running totals and top ads -> keyed report tables.

Topology (one query, one checkpoint; one pass over a line gives its click or its reject):

    source (Kafka / files) -> parse (S7) -> day (F9)
      -> running count of all clicks per (day, user, ad), beside the clicks (St3, ``streaming.guard``)
      -> foreachBatch (St4, St5, St7, St9), per micro-batch b below the sink folder:
           blacklist/batch_id=b            users blocked in b, with the turn (S15)
           user_ads_click/batch_id=b       changed totals per day/user/ad of users not blocked before (S14)
           area_city_ads_count/batch_id=b  totals per day/area/city/ad of the touched (day, area) groups (Q5, S12)
           area_top3_ads/batch_id=b        top ads of the touched (day, area) groups (Q6, S13)
           rejects/batch_id=b              malformed lines, in the folder the caller names
           versions/batch_id=b             (day, area) -> the batch that holds the group now
           batches/batch_id=b              written last: the batch is complete, with its line counts

A batch reads and writes the (day, area) groups that it touches. A group's totals stand whole in one batch
folder and ``versions`` names it, so readers open a folder per current group, however long the job has run,
and never meet a half-written group: a replayed batch overwrites only its own folders, which nobody reads
before it is complete. Totals only grow, so the new top of a group lies among its old top and the ads whose
totals changed (``incremental_top_n``); no other ad of the group is ranked again.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from visitlens.fixed import BATCH_INTERVAL, TOP_ADS
from visitlens.operators.guard import DEFAULT_THRESHOLD, ads_texts, with_day
from visitlens.operators.topk import incremental_top_n, semi
from visitlens.sources import adslog
from visitlens.streaming.guard import admitted_counts, blocked_turns, click_counts, guarded_stream, unblocked, user_totals

GROUP = ["day", "area"]
SCHEMAS = {
    "area_city_ads_count": "day string, area string, city string, ads_id string, click_count bigint, added bigint",
    "area_top3_ads": "day string, area string, ads array<struct<place int, ads_id string, click_count bigint>>, top3_json string",
    "user_ads_click": "day string, user_id string, ads_id string, click_count bigint",
    "blacklist": "user_id string, turn bigint",
    "versions": "day string, area string, version bigint",
    "batches": "lines bigint, rejected bigint",
}
TABLES = ("area_city_ads_count", "user_ads_click", "blacklist", "area_top3_ads")


class Store:
    """The tables of one sink folder, a folder per table and micro-batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch_id={batch}"

    def write(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table, batch))
        return self.batch(table, batch)

    def batch(self, table: str, batch: int) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table, batch))

    def history(self, table: str, last: int) -> DataFrame:
        """Every batch up to ``last``, with its ``batch_id``."""
        df = self.spark.read.schema(f"{SCHEMAS[table]}, batch_id bigint").parquet(f"{self.root}/{table}")
        return df.filter(F.col("batch_id") <= last)

    def last(self) -> int | None:
        """The last complete batch."""
        rows = self.spark.read.schema(f"{SCHEMAS['batches']}, batch_id bigint").parquet(f"{self.root}/batches")
        return rows.agg(F.max("batch_id")).first()[0]

    def folders(self, versions: DataFrame) -> list[int]:
        """The batches whose folders hold the groups in ``versions``."""
        return sorted(r[0] for r in versions.select("version").distinct().collect())

    def groups(self, table: str, versions: DataFrame, ids: list[int] | None = None) -> DataFrame:
        """Rows of the groups in ``versions``, each from the folder that holds it; ``ids``: their ``folders``, if known."""
        schema = SCHEMAS[table]
        ids = self.folders(versions) if ids is None else ids
        if not ids:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(f"{schema}, batch_id bigint").option("basePath", f"{self.root}/{table}")
        rows = read.parquet(*[self.path(table, i) for i in ids]).withColumnRenamed("batch_id", "version")
        return semi(rows, versions, [*GROUP, "version"]).drop("version")

    def drop_superseded(self, last: int, keep: int) -> list[int]:
        """Delete the group folders that no group has used since batch ``last - keep``; returns their batches."""
        used = {r[0] for b in range(max(0, last - keep), last + 1) for r in self.batch("versions", b).select("version").distinct().collect()}
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        held = {int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/area_top3_ads"))
                if f.getPath().getName().startswith("batch_id=")}
        gone = sorted(b for b in held - used if b < last - keep)
        for b in gone:
            for table in ("area_city_ads_count", "area_top3_ads"):
                fs.delete(jvm.org.apache.hadoop.fs.Path(self.path(table, b)), True)
        return gone


class BatchSink:
    """``foreachBatch`` writer of the tables above."""

    def __init__(self, root: str, threshold: int, rejects: str | None = None, keep: int | None = None):
        self.root, self.threshold, self.rejects, self.keep = root.rstrip("/"), threshold, rejects, keep
        self.last: int | None = None

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        batch_id = int(batch_id)
        store = Store(rows.sparkSession, self.root)
        if self.last is None and batch_id > 0:  # a restarted job: batches before this one are complete
            self.last = batch_id - 1
        rows = rows.persist()
        try:
            self._write(store, rows, batch_id)
        finally:
            rows.unpersist()
        self.last = batch_id
        if self.keep is not None and batch_id and batch_id % max(self.keep, 1) == 0:
            store.drop_superseded(batch_id, self.keep)

    def _write(self, store: Store, rows: DataFrame, b: int) -> None:
        before = None if self.last is None else store.history("blacklist", self.last).select("user_id")
        totals = unblocked(rows.filter(F.col("total").isNotNull()), before)
        own = rows.filter(F.col("total").isNull())
        counts = own.agg(F.count(F.lit(1)).alias("lines"), F.count("bad").alias("rejected")).first()  # fills the cache, too
        good = own.filter(F.col("bad").isNull())
        clicks = click_counts(good).persist()  # read for the blocks, the users' totals and the groups' totals
        try:
            with ThreadPoolExecutor(4) as jobs:  # the tables of a batch, but for the blocks, do not depend on one another
                old = jobs.submit(self._old_folders, store, good)
                waiting = []
                if self.rejects:
                    bad = own.filter(F.col("bad").isNotNull()).select(F.col("bad").alias("value"))
                    waiting.append(jobs.submit(bad.write.mode("overwrite").parquet, f"{self.rejects.rstrip('/')}/batch_id={b}"))
                blocked = store.write(blocked_turns(totals, clicks, self.threshold), "blacklist", b)
                waiting += [
                    jobs.submit(store.write, user_totals(totals, clicks, blocked), "user_ads_click", b),
                    jobs.submit(self._groups, store, admitted_counts(unblocked(clicks, before), blocked), old.result(), b)]
                for job in waiting:
                    job.result()
        finally:
            clicks.unpersist()
        store.write(store.spark.createDataFrame([tuple(counts)], SCHEMAS["batches"]).coalesce(1), "batches", b)

    def _old_folders(self, store: Store, clicks: DataFrame) -> list[int]:
        """The folders with the groups of ``clicks`` so far, while the guard still decides which clicks are admitted."""
        if self.last is None:
            return []
        return store.folders(semi(store.batch("versions", self.last), clicks.select(*GROUP).distinct(), GROUP))

    def _groups(self, store: Store, admitted: DataFrame, ids: list[int], b: int) -> None:
        """The touched (day, area) groups: totals, top ads, and where each group now is. ``ids``: folders that hold them."""
        added = admitted.groupBy(*GROUP, "city", "ads_id").agg(F.sum("n").alias("added")).persist()
        touched = added.select(*GROUP).distinct()
        known = store.spark.createDataFrame([], SCHEMAS["versions"]) if self.last is None else store.batch("versions", self.last)
        old = semi(known, touched, GROUP)
        now = store.write(running_totals(store.groups("area_city_ads_count", old, ids), added), "area_city_ads_count", b)
        rest = semi(known, touched, GROUP, keep=False)
        versions = rest.unionByName(touched.withColumn("version", F.lit(b).cast("bigint"))).coalesce(1)
        with ThreadPoolExecutor(1) as job:  # neither needs the other
            waiting = job.submit(store.write, versions, "versions", b)
            store.write(top_ads(store.groups("area_top3_ads", old, ids), now), "area_top3_ads", b)
            waiting.result()
        added.unpersist()


def running_totals(before: DataFrame, added: DataFrame) -> DataFrame:
    """Totals per day/area/city/ad (St5, St6): those of the groups before, and the batch's clicks in ``added``."""
    none = F.lit(0).cast("bigint")
    rows = before.withColumn("added", none).unionByName(added.withColumn("click_count", none))
    both = F.sum(F.col("click_count") + F.col("added"))
    return rows.groupBy(*GROUP, "city", "ads_id").agg(both.alias("click_count"), F.sum("added").alias("added"))


def top_ads(before: DataFrame, now: DataFrame, n: int = TOP_ADS) -> DataFrame:
    """The new top of every touched group from its old one and the totals of the ads that changed (St9, W3)."""
    old = before.select(*GROUP, F.explode("ads").alias("ad")).select(*GROUP, "ad.ads_id", "ad.click_count")
    new = now.groupBy(*GROUP, "ads_id").agg(F.sum("click_count").alias("click_count"), F.sum("added").alias("added"))
    new = new.filter(F.col("added") > 0).drop("added")
    top = incremental_top_n(old, new, GROUP, ["ads_id"], [F.col("click_count").desc(), F.col("ads_id").asc()], n, "place")
    return ads_texts(top, "place").select(*GROUP, "ads", "top3_json")


def reports(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The four report tables as of the last complete batch of a job that writes to ``root``.

    Raises if no batch was completed yet; any storage error is passed on.
    """
    store = Store(spark, root)
    last = store.last()
    if last is None:
        raise ValueError(f"no complete batch in {root}")
    versions = store.batch("versions", last)
    ids = store.folders(versions)
    user = store.history("user_ads_click", last).groupBy("day", "user_id", "ads_id").agg(F.max("click_count").alias("click_count"))
    return {
        "area_city_ads_count": store.groups("area_city_ads_count", versions, ids).drop("added"),
        "user_ads_click": user,  # totals only grow: a key's value is its largest
        "blacklist": store.history("blacklist", last).select("user_id").distinct(),
        "area_top3_ads": store.groups("area_top3_ads", versions, ids).select("day", "area", "top3_json"),
    }


def start(clicks: DataFrame, sink_root: str, checkpoint: str,
          threshold: int = DEFAULT_THRESHOLD, trigger: dict | None = None,
          query_name: str | None = None, state_partitions: int | None = None,
          rejects: str | None = None, keep: int | None = None) -> StreamingQuery:
    """Start the job on a parsed click stream (ts, area, city, user_id, ads_id; ``bad`` if lines may be malformed).

    ``turn`` numbers the guard's batches where the log gives their edges; later micro-batches hold later turns.
    Without it every micro-batch is one.

    ``trigger`` defaults to a 5-second micro-batch (St1); tests pass ``{"availableNow": True}``.
    Streaming state is not coalesced by AQE, so ``state_partitions`` (default: the session's
    shuffle partitions) should be sized to the cluster (a few tasks per core), not to the batch
    shuffle setting; it is fixed by the checkpoint once the query has started. ``rejects`` names a folder
    for malformed lines. With ``keep``, group folders that no group has used for that many batches are
    deleted; without it none is.
    """
    if "bad" not in clicks.columns:
        clicks = clicks.withColumn("bad", F.lit(None).cast("string"))
    w = (guarded_stream(with_day(clicks)).writeStream.outputMode("update")
         .foreachBatch(BatchSink(sink_root, threshold, rejects, keep))
         .option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"processingTime": BATCH_INTERVAL})))
    if query_name:
        w = w.queryName(query_name)
    if not state_partitions:
        return w.start()
    spark = clicks.sparkSession
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(int(state_partitions)))
    try:  # read once when the query is planned and then kept in its checkpoint
        return w.start()
    finally:
        spark.conf.set(key, old)


def start_from_lines(lines: DataFrame, sink_root: str, checkpoint: str, **kw) -> StreamingQuery:
    """Same job from raw ``value`` lines (Kafka / text files); malformed lines are counted, and kept with ``rejects``."""
    turn = [c for c in lines.columns if c == "turn"]
    parsed = adslog.parse_lines(lines, keep=turn)
    bad = F.when(~F.col("valid"), F.coalesce("value", F.lit("")))
    return start(parsed.select(*adslog.FIELDS, "day", *turn, bad.alias("bad")), sink_root, checkpoint, **kw)
