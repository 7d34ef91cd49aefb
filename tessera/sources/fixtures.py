"""The given tables and the fixture tables Spark derives from them.

Every derivation is row-local or an equi join on a unique key, so none of
them has a hot key: a conversation or document holding a third of all rows
is still spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import balance

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Positions inside a conversation or document take the low 32 bits of a key.
KEY_STEP = 1 << 32

# Tables whose rows carry long texts: row-local work on them is heavy, so a
# scan with too few splits is spread first (see ``session.balance``).
TEXT_TABLES = {"documents", "pages", "conversations"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return balance(df) if name in TEXT_TABLES else df


def row_key(major: str, minor: str) -> "F.Column":
    """One number for (id, position): unique for ids below 2^31 and any number of positions an array can hold."""
    return F.col(major).cast("bigint") * KEY_STEP + F.col(minor).cast("bigint")


def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn paired with the next turn of its conversation when that
    turn is an assistant turn; ``pair_id = conv_id * 2^32 + turn``.

    An equi join on ``(conv_id, turn)`` rather than a window over
    ``conv_id``: a very long conversation cannot pile up in one task.
    """
    c = read_table(spark, sf_dir, "conversations")
    user = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src_text"))
    nxt = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt_text")
    )
    return user.join(nxt, ["conv_id", "turn"]).select(
        row_key("conv_id", "turn").alias("pair_id"), "src_text", "tgt_text"
    )


def _doc_lines(spark: SparkSession, sf_dir: str, extra=("lang",)) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", *extra, F.split(F.col("text"), "\n", -1).alias("lines"))


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line i of a document with line i+1; ``pair_id = doc_id * 2^32 + i``.

    Neighbouring lines are paired inside the row (no self join, no window).
    """
    d = _doc_lines(spark, sf_dir, extra=())
    n = F.size("lines")
    idx = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(
        idx,
        lambda i: F.struct(
            i.alias("i"), F.get(F.col("lines"), i).alias("src_text"), F.get(F.col("lines"), i + 1).alias("tgt_text")
        ),
    )
    return d.select("doc_id", F.inline(pairs)).select(
        row_key("doc_id", "i").alias("pair_id"), "src_text", "tgt_text"
    )


def damage(col) -> "F.Column":
    """The fixed damage rule that turns a reference line into a hypothesis."""
    c = F.col(col) if isinstance(col, str) else col
    for a, b in ((" the ", " "), ("tion", "toin"), ("ung", "nug"), ("ción", "cion")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def hyp_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All document lines as references, damaged copies as hypotheses; ``id``
    numbered as in ``line_pairs``."""
    d = _doc_lines(spark, sf_dir)
    return (
        d.select("doc_id", "lang", F.posexplode("lines").alias("i", "ref"))
        .select(row_key("doc_id", "i").alias("id"), "lang", "ref", damage("ref").alias("hyp"))
    )


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as one score per (vector, dimension)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("seq_id"), F.posexplode("embedding").alias("token_id", "score")).select(
        "seq_id", F.col("token_id").cast("int").alias("token_id"), F.col("score").cast("double").alias("score")
    )


def score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("seq_id"), F.col("label").alias("label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")


def scalar_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a metric log: ``(tag, step, value, ts)``.  The file holds
    ``timestamp_ntz``; it is cast to ``timestamp`` (watermarks need it)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("tag"),
        F.col("event_id").alias("step"),
        F.col("value").cast("double").alias("value"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def translation_nested(spark: SparkSession, sf_dir: str, src: str = "en", tgt: str = "zh") -> DataFrame:
    """``conv_pairs`` packed as ``translation MAP<STRING,STRING>`` records."""
    cp = conv_pairs(spark, sf_dir)
    return cp.select("pair_id", F.create_map(F.lit(src), F.col("src_text"), F.lit(tgt), F.col("tgt_text")).alias("translation"))
