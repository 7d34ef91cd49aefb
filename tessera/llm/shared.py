"""The folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    With a local master and the setting unset (tests), a temporary folder is
    taken; on a cluster the setting must name a shared one.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", compression: str = "zstd") -> DataFrame:
    """Write the rows to the shared folder and read them back (cuts the lineage).

    The files outlive lost executors; the reliable copy is used instead of a
    cache or a local checkpoint.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
