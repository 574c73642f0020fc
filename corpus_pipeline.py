"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept.

Language identification drops texts in no learned language; exact and near duplicates keep one document of each group; sources are
mixed to target weights, which repeats documents of small sources; packing gives the pieces of the training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import exact, langid, mixing, neardup, packing
from strata.llm.common import cut
from strata.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a learned language."""
    return langid.keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity of 0.8 or more."""
    return neardup.one_of_each(docs, words=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources have their weights: no source more than twice, every document at least once."""
    return mixing.mix(docs, max_repetition=2.0, marks=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents; a repeated document is packed as often."""
    return packing.pack(docs, tokenizer())


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("packed", packed)]

#: Tokenisation, language models and packing aren't SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each gives is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
