"""Training text, vocabulary files, prepared examples, scalar logs and
numbered artifacts.

Writers use Spark's commit protocol (a job either commits all of its files
or none), which is what an atomic temp-file-and-rename gives a single
process.  "Build only if absent" is ``mode("ignore")``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalize_newlines


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def write_training_text(df: DataFrame, col: str, path: str, model_path: str | None = None) -> bool:
    """One sentence per line, newline turned into space; skipped when the
    text or the tokenizer model built from it (``model_path``) already exists.
    Returns True when written."""
    if _exists(df.sparkSession, path) or (model_path is not None and _exists(df.sparkSession, model_path)):
        return False
    df.select(normalize_newlines(F.coalesce(F.col(col), F.lit(""))).alias("value")).write.mode("ignore").text(path)
    return True


def save_vocab(vocab: DataFrame, path: str, merges: DataFrame | None = None, mode: str = "ignore") -> None:
    """Vocabulary (and BPE merges) as Parquet under ``path``.  The merges
    come first: a committed vocabulary means that all is there."""
    if merges is not None:
        # left over from a run that ended before its vocabulary was written
        merges.write.mode(mode if _exists(vocab.sparkSession, f"{path}/vocab/_SUCCESS") else "overwrite").parquet(f"{path}/merges")
    vocab.write.mode(mode if _exists(vocab.sparkSession, f"{path}/vocab/_SUCCESS") else "overwrite").parquet(f"{path}/vocab")


def load_vocab(spark: SparkSession, path: str):
    """``(vocab, merges or None)``; a missing or half-written vocabulary raises."""
    if not _exists(spark, f"{path}/vocab/_SUCCESS"):
        raise FileNotFoundError(f"no vocabulary at {path}")
    vocab = spark.read.parquet(f"{path}/vocab")
    merges = spark.read.parquet(f"{path}/merges") if _exists(spark, f"{path}/merges") else None
    return vocab, merges


def get_or_build_vocab(spark: SparkSession, path: str, build):
    """Load the vocabulary at ``path``; build (``build() -> (vocab, merges)``)
    and save it first when absent."""
    if not _exists(spark, f"{path}/vocab/_SUCCESS"):
        vocab, merges = build()
        save_vocab(vocab, path, merges)
    return load_vocab(spark, path)


def write_examples(df: DataFrame, path: str, order_cols=("split", "epoch", "step", "order"),
                   num_partitions: int | None = None, mode: str = "overwrite") -> None:
    """Examples in training order, partitioned by ``split`` on disk.

    A range shuffle on the order columns plus a sort inside each partition;
    part files then follow the order, so a trainer can stream them.
    """
    cols = [c for c in order_cols if c in df.columns]
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    out = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    out.write.mode(mode).partitionBy("split").parquet(path)


def write_stepped_examples(df: DataFrame, path: str, step_col: str = "step", order_cols=("split", "step", "order"),
                           num_partitions: int | None = None) -> None:
    """S6 with a step index: for each file its split, first and last step and rows, under ``path/_steps``.

    The index is read back from the committed files and written after them; an
    overwrite removes it with the data, so an index is there only for what it describes.
    """
    write_examples(df, path, order_cols, num_partitions)
    files = df.sparkSession.read.parquet(path).groupBy("split", F.col("_metadata.file_path").alias("file")).agg(
        F.min(step_col).alias("first_step"), F.max(step_col).alias("last_step"), F.count(F.lit(1)).alias("n_rows"))
    files.write.mode("overwrite").parquet(f"{path}/_steps")


def resume_examples(spark: SparkSession, path: str, first_step: int, split: str = "train", step_col: str = "step") -> DataFrame:
    """S6 + D5: the rows of a split from ``first_step`` on; files that end before it are not opened.

    The driver gets one name a file that is left.  A folder without a committed index raises.
    """
    if not _exists(spark, f"{path}/_steps/_SUCCESS"):
        raise FileNotFoundError(f"no step index at {path}")
    index = spark.read.parquet(f"{path}/_steps").where((F.col("split") == split) & (F.col("last_step") >= int(first_step)))
    files = sorted(r["file"] for r in index.select("file").collect())
    if not files:
        return spark.read.parquet(path).where(F.lit(False))
    return spark.read.option("basePath", path).parquet(*files).where(F.col(step_col) >= int(first_step))


def append_scalars(df: DataFrame, path: str, run: str | None = None, batch: int | None = None) -> None:
    """Append ``(tag, step, value, ts)`` rows to the metric log.

    With ``run`` and ``batch`` the rows are one folder of the log, replaced as a whole: appending
    the same batch again (a retry, a replayed micro-batch) changes nothing.  Without them
    rows are added each time.  A log is written in one of the two ways; see :func:`read_scalars`.
    """
    cols = ["tag", "step", "value"] + (["ts"] if "ts" in df.columns else [])
    rows = df.select(*cols)
    if run is None or batch is None:
        rows.write.mode("append").parquet(path)
        return
    keyed = rows.withColumns({"run": F.lit(str(run)), "batch": F.lit(int(batch)).cast("bigint")})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch").parquet(path)


def read_scalars(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """The rows of a metric log, of one run or of all."""
    log = spark.read.option("basePath", path).parquet(path)
    if run is not None:
        log = log.where(F.col("run").cast("string") == str(run))
    return log.drop("run", "batch")


_NUMBERED = r"^(.*?)(\d+)\.pt$"


def _rx_quote(text: str) -> str:
    return "".join(ch if ch.isalnum() or ch == "_" else "\\" + ch for ch in text)


def latest_artifact(paths: DataFrame, path_col: str = "path", base: str | None = None) -> DataFrame:
    """Per base name, the artifact with the largest *number* (not string
    order).  Names must match ``<base><digits>.pt`` exactly; temp files and
    other suffixes are ignored.  ``base`` restricts to one base name, which may
    end in a digit itself; the number is what follows it.  Digit runs of any
    length are compared as numbers; one beyond a bigint has a NULL ``number``."""
    pattern = _NUMBERED if base is None else f"^({_rx_quote(base)})(\\d+)\\.pt$"
    name = F.regexp_extract(F.col(path_col), r"([^/]+)$", 1)
    d = paths.select(
        F.col(path_col).alias("path"),
        F.regexp_extract(name, pattern, 1).alias("base"),
        F.regexp_extract(name, pattern, 2).alias("_digits"),
    ).where(F.col("_digits") != "")
    # numbers in order: by length without leading zeros, then as text
    bare = F.regexp_replace("_digits", "^0+(?=.)", "")
    d = d.withColumn("_order", F.struct(F.length(bare).alias("l"), bare.alias("d")))
    best = d.groupBy("base").agg(F.max_by(F.struct("path", "_order"), F.struct("_order", "path")).alias("_b"))
    return best.select("base", F.col("_b.path").alias("path"), F.expr("try_cast(_b._order.d AS bigint)").alias("number"))
