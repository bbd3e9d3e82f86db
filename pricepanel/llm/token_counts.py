"""Exact length histogram of a corpus and the answers that its suffix sums give.

Documents are aggregated by encoded length. For each length the running sums
over the longer ones say how many documents a context limit cuts and how many
tokens remain, so no later question needs the texts again.

Defined results: a null or empty text has length 0 and counts as a document;
repeated rows count each; an empty table gives an empty histogram; other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.llm import tables, tokens
from pricepanel.session import stage

#: Lengths are summed in ranges of this many, so that no window holds more rows.
RANGE = 1024


def length_counts(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Documents by encoded length: n_tokens, n_docs. A task sends each length once."""
    path = tokenizer or tokens.tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for _, _, begin in tokens.encoded(batch, "text", path):
                for n, k in zip(*np.unique(np.diff(begin), return_counts=True)):
                    found[int(n)] = found.get(int(n), 0) + int(k)
        yield pa.record_batch([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["n_tokens", "n_docs"])

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return rows.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_table(counts: DataFrame) -> DataFrame:
    """One row per length L that occurs, taken as a context limit.

    n_docs have length L; docs_fit have at most L; docs_cut have more; kept_tokens
    is the sum of min(length, L); lost_tokens is the rest; share_fit is
    docs_fit over all documents, so L is the quantile of every q up to share_fit.
    Sums run inside ranges of lengths and then over the ranges.
    """
    rows = counts.withColumn("part", F.expr(f"n_tokens div {RANGE}"))
    rows = rows.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    after = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "part", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_above"),
    )
    totals = counts.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("all_tokens"))
    longer = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    docs_cut = F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("docs_above")
    tokens_cut = F.coalesce(F.sum("tokens").over(longer), F.lit(0)) + F.col("tokens_above")
    all_docs = totals.select("all_docs").scalar()
    all_tokens = totals.select("all_tokens").scalar()
    return (
        rows.join(parts, "part")
        .select("n_tokens", "n_docs", docs_cut.alias("docs_cut"), tokens_cut.alias("tokens_cut"))
        .select(
            F.col("n_tokens").alias("context_limit"), "n_docs", (all_docs - F.col("docs_cut")).alias("docs_fit"), "docs_cut",
            (all_tokens - F.col("tokens_cut") + F.col("docs_cut") * F.col("n_tokens")).alias("kept_tokens"),
            (F.col("tokens_cut") - F.col("docs_cut") * F.col("n_tokens")).alias("lost_tokens"),
            ((all_docs - F.col("docs_cut")) / all_docs).alias("share_fit"),
        )
    )


def at_limits(counts: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Documents cut and tokens kept at any stated limits, whether or not a document has that length."""
    rows = counts.withColumn("context_limit", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))))
    longer = F.col("n_tokens") > F.col("context_limit")
    return rows.groupBy("context_limit").agg(
        F.sum(F.when(longer, F.col("n_docs")).otherwise(0)).alias("docs_cut"),
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("kept_tokens"),
    )


def quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least each share of the documents does not exceed; ``table`` is a context table."""
    rows = table.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    return rows.where("share_fit >= share").groupBy("share").agg(F.min("context_limit").alias("length"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    # one row per length, read by several branches: written once, so that texts are encoded once
    return context_table(stage(length_counts(tables.table(spark, sf_dir, "documents")), "lengths"))
