"""Stages that turn ``documents`` into encoded training rows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns they were given, extra ones and their names included.
A document is a ``doc_id`` with its text: rows that repeat both are one document, the least
row by the other columns.  Rows that share an id but not the text are documents of their
own, and so are rows without an id; they come after all others where the order of ids
decides.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_codec, jaccard_join, language_id, mixing, repeated_passages
from tessera.llm.shared import stored

#: Names of the columns that a decision and a document's key are joined under; no column of documents has them.
DECISION, KEY = "__corpus_pipeline_decision", "__corpus_pipeline_key"


def _documents(docs: DataFrame) -> DataFrame:
    """Each document once, with a key in the order of ids: the id itself where it tells all rows apart.

    Otherwise the rows are put in order of id and text (no id last) by ranges, and numbered in the
    stored table.
    """
    n, distinct, given = docs.agg(F.count("*"), F.count_distinct("doc_id"), F.count("doc_id")).first()
    if n == distinct == given:
        return docs.withColumn(KEY, F.col("doc_id").cast("long"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = F.min(F.struct(F.lit(0).alias("z"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]))
    rows = docs.groupBy("doc_id", "text").agg(least.alias(DECISION))
    back = {"doc_id": F.col("doc_id"), "text": F.col("text"), **{c: F.col(f"{DECISION}.c{i}") for i, c in enumerate(others)}}
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    rows = rows.select(*[back[c].alias(c) for c in docs.columns]).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.withColumn(KEY, F.monotonically_increasing_id()), "documents")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without a letter and those below the threshold go.

    Every row is judged by its own text, so repeated rows and null ids need no care here.
    """
    return language_id.accepted(docs, language_id.train(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group of near-duplicates."""
    every = _documents(docs)
    kept = jaccard_join.jaccard_components(every, KEY).where("doc_id = component_id").select(F.col("doc_id").alias(KEY))
    return every.join(kept, KEY, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated passages that are not their first occurrence; ``n_chars`` follows the text."""
    every = _documents(docs)
    cut = repeated_passages.deduplicated_texts(every, KEY).select(F.col("doc_id").alias(KEY), F.col("kept_text").alias(DECISION))
    out = every.join(stored(cut, "cut"), KEY, "left")
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col(DECISION).isNotNull(), F.length(DECISION)).otherwise(F.col("n_chars")).cast(kind))
    out = out.withColumn("text", F.coalesce(F.col(DECISION), F.col("text")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: no row, or up to three."""
    every = _documents(docs)
    copies = mixing.mix(every, KEY).where("copies > 0").select(F.col("doc_id").alias(KEY), F.col("copies").cast("int").alias(DECISION))
    out = every.join(stored(copies, "copies"), KEY)
    out = out.withColumn(DECISION, F.explode(F.array_repeat(F.lit(1), F.col(DECISION))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of the ids and of the text decoded from them."""
    return bpe_codec.round_trip_digests(docs, with_ids=True)


STAGES = [
    ("language id", identified),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("mixing sources", mixed),
    ("BPE encoding", encoded),
]

#: SQL has no subword models, metric joins or byte-pair merges; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1], 1):
        docs = stored(stage(spark, docs, sf_dir), f"stage{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
