"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tessera") -> SparkSession:
    """Session tuned for the preparation and evaluation jobs.

    AQE stays on so that shuffle partitions are coalesced at small scale and
    skewed join partitions are split at large scale.  The UI is off.  A master
    given here, in ``TESSERA_MASTER`` or to spark-submit holds; without any it
    is ``local[8]``.  Shuffle partitions and driver memory are only set for a
    local master (or on request), and the package is sent to the workers, wherever they run.
    """
    master = master or os.environ.get("TESSERA_MASTER")
    given = SparkConf().get("spark.master")  # spark-submit or spark-defaults
    local = (master or given or "local").startswith("local")
    parts = shuffle_partitions or os.environ.get("TESSERA_SHUFFLE_PARTITIONS") or ("8" if local else None)
    b = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master or not given:
        b = b.master(master or "local[8]")
    if parts:
        b = b.config("spark.sql.shuffle.partitions", str(parts))
    if local:
        b = b.config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    ship_package(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it installed."""
    root = os.path.dirname(os.path.abspath(__file__))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tessera-package-"), "tessera"), "zip",
                               os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(made)


def balance(df, min_partitions: int | None = None):
    """Spread a skinny input over the cluster.

    A table stored as one row group is read by one task, and every row-local
    step before the first shuffle would run there.  When the scan yields fewer
    partitions than the default parallelism, round-robin it (one shuffle of the
    raw rows); a large input already has enough splits and is returned as is.
    The partition count comes from planning only; no job runs.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names it).
    Only when it is unset -- local runs and tests -- a folder is created and
    registered, so that later calls agree.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    sc.setCheckpointDir(conf)
    return (sc.getCheckpointDir() or conf).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
