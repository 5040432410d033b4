"""Spark session helpers.

Library code never creates a session of its own: every operator takes the
caller's DataFrames.  ``get_session`` is for scripts, tests and the bench.
``shared_dir`` resolves the folder for checkpoints and written results from
the session (``spark.checkpoint.dir``), so jobs on a cluster use the shared
folder the cluster names.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # no Python call-site capture per DataFrame call (plan building cost)
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # keep CPU-heavy post-shuffle stages parallel on small inputs
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # A lone local JVM resolves its own address more reliably this way.
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
}


def get_session(master: str | None = None, app: str = "tandem",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only when
    none is configured (local runs and tests).  A cluster names its shared
    folder in ``spark.checkpoint.dir``; that setting always wins."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster job needs a shared folder")
    local = tempfile.mkdtemp(prefix="tandem-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a fresh path of the shared folder and read it back: later
    plans scan the result instead of computing it again, and losing executors
    loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, costly: bool = False) -> DataFrame:
    """Rows dealt by ``key`` over all cores where the input has fewer partitions
    than that (e.g. one small file); else as they are.  ``costly`` work per row
    always has them dealt: a file may hold all its rows in one row group, which
    one task reads however many partitions the scan has."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    if costly:
        return df.repartition(max(4 * cores, parts), key)
    return df.repartition(cores, key) if parts < cores else df
