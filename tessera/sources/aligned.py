"""Line-aligned text files.

Reading: every line gets its exact 0-based number from
``(file path, block start, position in block)`` -- the text reader reads a
block sequentially in one task, so a line's number is its place in the task
shifted by a number for each block; the blocks are counted first, and no
text is shuffled for it.
The two sides then meet in an equi join on ``line_no``; unequal line counts
fail the job from inside the join (``raise_error``), without a count action.

Writing: a range shuffle on the order column plus a sort inside each
partition; part files in name order are the line order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize_newlines


def read_numbered_lines(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """Lines of a file or a folder of part files with their exact 0-based number."""
    raw = spark.read.text(path, lineSep="\n").select(
        F.col("value").alias(text_col),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    # the lines of a block follow each other in one task; a block is one row here
    blocks = raw.groupBy("_file", "_block").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_file").alias("_bf"), F.col("_block").alias("_bb"),
                           (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = raw.join(F.broadcast(blocks), (F.col("_file") == F.col("_bf")) & (F.col("_block") == F.col("_bb")))
    return placed.select(text_col, (F.col("_seq") + F.col("_shift")).alias("line_no"))


def read_aligned_lines(spark: SparkSession, src_path: str, tgt_path: str, split: str | None = None,
                       key: str = "line_no") -> DataFrame:
    """``(line_no, src_text, tgt_text[, split])``; line *i* of one file
    pairs with line *i* of the other; unequal line counts raise."""
    s = read_numbered_lines(spark, src_path, "src_text").withColumnRenamed("line_no", "_ls")
    t = read_numbered_lines(spark, tgt_path, "tgt_text").withColumnRenamed("line_no", "_lt")
    j = s.join(t, F.col("_ls") == F.col("_lt"), "full_outer")
    bad = F.col("_ls").isNull() | F.col("_lt").isNull()
    line_no = F.when(bad, F.raise_error(F.lit(f"line counts differ between {src_path} and {tgt_path}")).cast("bigint")).otherwise(
        F.col("_ls")
    )
    out = j.select(line_no.alias(key), "src_text", "tgt_text")
    if split is not None:
        out = out.withColumn("split", F.lit(split))
    return out


def read_split_files(spark: SparkSession, folder: str, src: str, tgt: str,
                     splits=("train", "valid", "test")) -> DataFrame:
    """S1 for a folder holding ``<split>.<lang>`` files; missing splits are skipped.

    ``line_no`` restarts in each file; ``pair_id`` (number of the split * 2^48 +
    ``line_no``) is unique over all of them."""
    from tessera.sources.artifacts import _exists

    out = None
    for number, sp in enumerate(splits):
        sp_src, sp_tgt = f"{folder}/{sp}.{src}", f"{folder}/{sp}.{tgt}"
        if not (_exists(spark, sp_src) and _exists(spark, sp_tgt)):
            continue
        d = read_aligned_lines(spark, sp_src, sp_tgt, split=sp)
        d = d.withColumn("pair_id", F.lit(number << 48).cast("bigint") + F.col("line_no"))
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise FileNotFoundError(f"no aligned split files under {folder}")
    return out


def write_hypotheses(df: DataFrame, path: str, order_col: str = "line_no", text_col: str = "hyp",
                     num_partitions: int | None = None, mode: str = "overwrite") -> None:
    """One line per row in ``order_col`` order, line feeds and carriage returns turned into spaces."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    out = (
        df.select(F.col(order_col), F.translate(normalize_newlines(F.coalesce(F.col(text_col), F.lit(""))), "\r", " ").alias("value"))
        .repartitionByRange(n, order_col)
        .sortWithinPartitions(order_col)
        .select("value")
    )
    out.write.mode(mode).text(path)
