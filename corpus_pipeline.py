"""A training corpus from raw documents: quality, near copies, benchmark passages, secrets, packing.

Each stage reads what its predecessor wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricepanel.llm import decontamination, jaccard_join, packing, quality_ranking, secrets, tables
from pricepanel.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality ranking accepts."""
    return quality_ranking.accepted(docs, tables.table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id from each group of near copies."""
    return jaccard_join.one_of_each_group(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.without_contaminated(docs, tables.table(spark, sf_dir, "benchmark"))


def live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with values that one owner holds and that look live replaced by a mark."""
    return secrets.mask_live(docs, *secrets.source_names())


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of one length."""
    return packing.pack(stage(packing.pieces(docs), "pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality), ("ngram_jaccard_join", near_copies), ("benchmark_decontamination", benchmark_passages),
    ("secret_scans", live_secrets), ("best_fit_packing", sequences),
]
#: SQL cannot express the trained classifier, the walks or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = tables.table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
