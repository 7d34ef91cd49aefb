"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each source gets a target number of words; every document of a source is
expected the same number of times, target over size of the source.  Documents
of a source are put in one order, the expected copies are summed along it, one
random offset (a digest of the seed and the source's name) is added, and a
document is taken once for every integer that the sum crosses at it.  The order
goes by size class first, so the words taken come near the target, not only
the documents.

The running sum needs the rank of a document in its source.  It is put
together from three small steps (classes before, digest prefixes before, rows
before under the same prefix), so a source, size or group of copies with a
third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import stored

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size.
MOST = 3
SEED = "mix"
#: Rows of one source and size class that share a digest prefix, about.
ROWS_TOGETHER = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """Words that each source gives, from one row a source (``has, name, source_size``).

    The shares by weight are cut at ``most`` times the size, and the excess is
    shared again by weight.  In ascending order of cut over weight, the level
    (words per unit of weight) that all uncut sources end up with is the
    largest of those reached along the way.
    """
    by_name = Window.orderBy(F.col("has").desc(), "name")
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cut = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("has").desc(), "name")
    before = by_cut.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cut.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    place = (F.row_number().over(by_name) - 1) % len(weights)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    # a window over sources: one row each, whatever the number of documents
    rows = totals.withColumn("weight", pick)
    rows = rows.withColumn("level", (F.sum("source_size").over(all_rows) * share - most * F.coalesce(
        F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
    rows = rows.withColumn("level", F.max("level").over(all_rows))
    return rows.withColumn("target", F.least((F.col("source_size") * most).cast("double"), F.col("level") * F.col("weight")))


def _offset(seed: str) -> Column:
    """One number in [0, 1) for each source, the same at each run."""
    digest = F.md5(F.concat(F.lit(seed), F.when(F.col("has"), F.concat(F.lit(":"), "name")).otherwise(F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("long") / float(1 << 20)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for every row.

    ``size`` is the number of words (null text: 0), ``copies`` how often the
    mix takes the document, ``taken`` copies times size.  Null sources are one
    source, the last.  A source without words has target 0 and is not taken.
    Rows are documents: one that is repeated is drawn for each row.  An empty
    table gives an empty one.  ``share`` is the size of the mix against that of
    all documents.
    """
    slim = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").isNotNull().alias("has"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("name"),
        word_count(F.col(f"`{text_col}`").cast("string")).alias("size"))
    slim = stored(slim, "sizes")  # the texts are read once
    n = slim.count()
    digits = max(0, math.ceil(math.log(max(n, 1) / ROWS_TOGETHER, 16)))
    binary = F.bin("size")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = slim.select(
        "*", F.concat(F.lpad(F.length(binary).cast("string"), 2, "0"), F.substring(binary, 1, 4)).alias("class"),
        digest.alias("digest"), F.substring(digest, 1, digits).alias("prefix"))

    counts = rows.groupBy("has", "name", "class", "prefix").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    classes = counts.groupBy("has", "name", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sources = targets(classes.groupBy("has", "name").agg(F.sum("words").alias("source_size")), weights, most, share)
    sources = sources.select(
        "has", "name", "source_size", "target", _offset(seed).alias("offset"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("expected"))

    def before(by: list[str], order: str) -> Column:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    source, group = ["has", "name"], ["has", "name", "class"]
    bases = classes.select(*group, before(source, "class").alias("class_base")).join(sources, source)
    inside = counts.select(*group, "prefix", before(group, "prefix").alias("prefix_base"))
    bases = inside.join(bases, group)
    together = Window.partitionBy(*group, "prefix").orderBy("digest", "doc_id", "size")
    ranked = rows.withColumn("row", F.row_number().over(together)).join(bases, [*group, "prefix"])
    rank = F.col("class_base") + F.col("prefix_base") + F.col("row")

    def crossed(k: Column) -> Column:
        return F.floor(F.col("offset") + F.col("expected") * k)

    copies = (crossed(rank) - crossed(rank - 1)).cast("long")
    return ranked.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, source IS NOT NULL AS has, coalesce(source, '') AS name,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT has, name, sum(size)::BIGINT AS source_size FROM d GROUP BY has, name),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY has DESC, name) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
              ORDER BY source_size / weight::DOUBLE, has DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY source_size / weight::DOUBLE, has DESC, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM w),
t AS (
  SELECT has, name, source_size, least((source_size * 3)::DOUBLE, max(lv) OVER () * weight) AS target,
         ('0x' || substr(md5('mix' || CASE WHEN has THEN ':' || name ELSE '' END), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u
  FROM l),
r AS (
  SELECT d.*, row_number() OVER (PARTITION BY has, name ORDER BY lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 4),
                                 md5(doc_id::VARCHAR), doc_id, size) AS k
  FROM d)
SELECT doc_id, size, source_size, target, c AS copies, c * size AS taken FROM (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0
              ELSE (floor(u + target / t.source_size * k) - floor(u + target / t.source_size * (k - 1)))::BIGINT END AS c
  FROM r JOIN t ON r.has = t.has AND r.name = t.name)
"""
