"""SparkSession defaults and the shared scratch folder.

Everything that must survive an executor (or driver) loss is written below the folder the
cluster names in ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its
own and a cluster session an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of this package relies on. Values are defaults: ``get_session`` sets only what
# an existing session, or its cluster's configuration, leaves unset.
DEFAULT_CONF = {
    # Day strings are computed from epoch millis; pin the zone so results do not depend on
    # the machine (the reference used the JVM default zone).
    "spark.sql.session.timeZone": "UTC",
    # AQE: runtime broadcast conversion (a measured size check), partition coalescing and
    # skew-join splitting for hot keys.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Sizing for a large cluster (~100 TB input, ~1000 executors). Shuffle partitions start
# high and AQE coalesces them to ~256 MB each, so neither a tiny nor a huge stage spills
# or starves; broadcasts happen only below a measured 64 MB; skewed join partitions are
# split; large streaming state lives in RocksDB with changelog checkpoints.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    # Static (plan-time) broadcast sizes come from compressed file sizes; scale them up so a
    # table that decompresses to several times its parquet size is not broadcast by mistake.
    # The runtime (AQE) threshold below uses measured shuffle sizes instead.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # A selective side of a shuffled join (the users inside the age bounds) filters the other by a Bloom
    # filter before its shuffle, also if it is larger than the 10 MB that Spark allows by itself.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "4g",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "50000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "50000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "536870912",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "visitlens", extra: dict | None = None,
                profile: str = "local", hive: bool = False, database: str | None = None) -> SparkSession:
    """Session with the package defaults; ``profile="cluster"`` adds ``CLUSTER_CONF``.

    Settings that the session, its builder or the cluster's configuration already made are kept;
    ``extra`` is set in any case. ``hive`` turns on the Hive catalog of a new session and
    ``database`` makes that database the current one.
    """
    defaults = dict(DEFAULT_CONF)
    if profile == "cluster":
        defaults.update(CLUSTER_CONF)
    if shuffle_partitions:
        defaults["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder
    if SparkSession.getActiveSession() is None:
        builder = builder.appName(app_name)
        if master:
            builder = builder.master(master)
        if hive:
            builder = builder.enableHiveSupport()
        for k in [k for k in defaults if k.startswith("spark.ui.")]:  # fixed when the process starts
            builder = builder.config(k, defaults.pop(k))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    chosen = {r["key"] for r in spark.sql("SET").collect()}
    for k, v in defaults.items():
        if k not in chosen and spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    if database:
        spark.catalog.setCurrentDatabase(database)
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A local session without one (its executors are this process) gets a private folder, once; on a
    cluster the setting must name a folder that all executors share, and its absence is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no driver-side context, use the session setting
        sc = None
    root = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if sc is None or not re.fullmatch(r"local(\[(\*|\d+)(,\s*\d+)?\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="visitlens-ckpt-")
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root


def shared_dir(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A fresh folder under the shared checkpoint root."""
    root = checkpoint_root(spark)
    name = "/".join(parts) if parts else "scratch"
    if unique:
        name = f"{name}-{uuid.uuid4().hex[:12]}"
    return root.rstrip("/") + "/visitlens/" + name
