"""From raw documents to packed training sequences, in stages.

Each stage takes the documents its predecessor kept. All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import documents
from waymark.llm.mixing import mixed_documents
from waymark.llm.ngram_join import one_of_each_group
from waymark.llm.packing import pack_documents
from waymark.llm.quality_rules import kept_documents
from waymark.llm.sanitise import sanitised
from waymark.storage import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the limits and are no outliers of their language and source."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the words that reveal it."""
    return sanitised(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality), ("n-gram join", near_duplicates), ("PII", personal_data),
    ("mixing", mixing), ("packing", packing)]

# The estimates of the first stage and the hashes of the second have no SQL; the stages are
# tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every result is written and read again."""
    docs = documents(spark, sf_dir)
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{position}")
    return docs
