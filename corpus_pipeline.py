"""The corpus pipeline: documents to token ids, in five stages.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's
result as Parquet in the shared folder and reads it again as the next one's docs. All stages but the last return the
columns of documents; the last adds n_tokens and the ids in place of the text.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import bpe, exact_dedup, langid, mixing, simhash
from parlance.llm.shared import in_one, keep


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those that are `und`, without any letter (nulls too), go. Repeated rows stay."""
    found = langid.identify(in_one(docs, text="text"), langid.train(docs), drop_text=True)
    return found.where(F.col("lang_pred") != "und").select("__row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without their blanks (ties and repeated rows: one of them)."""
    return exact_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints (three words) linked at two or fewer bits."""
    return simhash.dedup(docs, words=3)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is a source of its own."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (array<int>), and whether the ids decode to the text (null: empty)."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    given = docs.select("doc_id", "lang", "source", "text")
    encoded = bpe.encode(given, ranks, public_tokenizers.PATTERN, packed=False, decodes="decodes", drop_text=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "decodes", "ids")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("source_mix", source_mix),
    ("byte_bpe", tokens),
]

#: Components of near copies, language models and hashed draws are not expressible in SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
