"""Nested translation records.

``col("translation")[lang]`` works for both a MAP<STRING,STRING> and a
STRUCT with one field per language, so both record layouts are read the
same way.  A missing language key gives NULL (B25: dropped later with reason
``null_text``; the row keeps its rank).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType


def read_translations(spark: SparkSession, path: str, src: str, tgt: str, fmt: str = "parquet",
                      key: str = "pair_id") -> DataFrame:
    """Read ``{translation: {lang: text}}`` records and flatten one pair."""
    df = spark.read.format(fmt).load(path)
    return flatten_pairs(df, src, tgt, key=key)


def _lang(df: DataFrame, lang: str):
    t = df.schema["translation"].dataType
    if isinstance(t, MapType):
        return F.element_at(F.col("translation"), F.lit(lang))
    if isinstance(t, StructType):
        names = set(t.fieldNames())
        return F.col("translation")[lang] if lang in names else F.lit(None).cast("string")
    raise TypeError(f"translation must be a map or struct, got {t.simpleString()}")


def flatten_pairs(df: DataFrame, src: str, tgt: str, key: str = "pair_id") -> DataFrame:
    """project both languages to ``src_text`` / ``tgt_text``."""
    cols = [key] if key in df.columns else []
    return df.select(*cols, _lang(df, src).alias("src_text"), _lang(df, tgt).alias("tgt_text"))


def sentences(df: DataFrame, lang: str, key: str = "pair_id") -> DataFrame:
    """S3: one language's sentences, lazily (a projection)."""
    cols = [key] if key in df.columns else []
    return df.select(*cols, _lang(df, lang).alias("text"))
