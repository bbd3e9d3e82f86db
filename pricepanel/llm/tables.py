"""What all operators of this subpackage do with their input tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def texts(df: DataFrame, *more: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, text (null: empty) and the named further columns; any other column of the table is left out."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(c) for c in more))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_numbers(task: int, before: int, n: int) -> pa.Array:
    """Numbers that no other row of a job has: the task's number, then the place in the task."""
    return pa.array((np.int64(task) << np.int64(33)) + np.arange(before, before + n, dtype=np.int64))


def sampled(rows: DataFrame, size: int) -> list[Row]:
    """At most ``size`` rows, those of smallest hash; ``rows`` is a written table of distinct rows.

    The rows are counted first, and only those under a cut that leaves a little over ``size`` of them are ordered, so
    what reaches the driver follows ``size`` and not the number of rows or tasks.
    """
    mark, total, spare = F.xxhash64(*rows.columns), rows.count(), size + 8 * math.isqrt(size) + 8
    if total > spare:
        rows = rows.where(mark < F.lit(min(2**64 * spare // total - 2**63, 2**63 - 1)))
    return rows.orderBy(mark, *rows.columns).limit(size).collect()
