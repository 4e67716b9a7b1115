"""Stop-word tables (one column, word)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance import schema as S
from parlance.functions import text

WORD = T.StructType([T.StructField("word", T.StringType())])


def stopwords_from_text(lines: DataFrame, lower: bool = True) -> DataFrame:
    """Distinct white-space tokens of a value column."""
    value = F.lower("value") if lower else F.col("value")
    return lines.select(F.explode(text.words(value)).alias("word")).distinct()


def load_stopwords(spark: SparkSession, paths: Sequence[str], lower: bool = True) -> DataFrame:
    """Union of the listed files; missing files are skipped, and no file at all gives an empty table."""
    words = spark.createDataFrame([], WORD)
    for path in paths:
        try:
            words = words.unionByName(stopwords_from_text(spark.read.text(path), lower))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return words.distinct()


def load_stopwords_or_fallback(spark: SparkSession, path: str) -> DataFrame:
    """One file, lower-cased; when it is missing, the nine fallback words."""
    try:
        return stopwords_from_text(spark.read.text(path), lower=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([(w,) for w in S.FALLBACK_STOPWORDS], WORD)
