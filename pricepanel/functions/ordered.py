"""Positions and running totals along an order, without one window over the whole table."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 256
SLICE = 1 << 20


def with_position(df: DataFrame, value: str, tie: list[str], out: str = "position", bins: int = BINS) -> DataFrame:
    """Number the rows by ``value`` and then the tie columns, from 1; values must not be null.

    Approximate quantiles cut the values into bins of similar size. A row's
    position is the count of rows in lower bins (a table of at most ``bins``
    rows) plus its place in its own bin, so where exactly the cuts fall does not
    matter. Rows with one and the same value share a bin.
    """
    cuts = df.approxQuantile(value, [i / bins for i in range(1, bins)], 0.5 / bins)
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    binned = Bucketizer(splits=splits, inputCol=value, outputCol="__bin").transform(df)
    # One row per bin: the only window without a partition, over at most `bins` rows.
    lower = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        binned.groupBy("__bin").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(lower), F.lit(0)))
        .drop("__n")
    )
    in_bin = Window.partitionBy("__bin").orderBy(value, *tie)
    return (
        binned.join(offsets, ["__bin"])
        .withColumn(out, F.col("__before") + F.row_number().over(in_bin))
        .drop("__bin", "__before")
    )


def total_before(df: DataFrame, keys: list[str], order: str, value: str, out: str, slice_size: int = SLICE) -> DataFrame:
    """Sum of ``value`` over the earlier rows of a key, by a whole-number order column.

    A key with very many rows is cut into slices of the order column: the total
    of earlier slices comes from one row per slice, the rest from a window over
    the own slice.
    """
    sliced = df.withColumn("__slice", F.floor(F.col(order) / F.lit(slice_size)))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy(*keys, "__slice").agg(F.sum(value).alias("__sum"))
    over_slices = earlier(Window.partitionBy(*keys).orderBy("__slice"))
    slices = slices.withColumn("__base", F.coalesce(F.sum("__sum").over(over_slices), F.lit(0))).drop("__sum")
    inside = earlier(Window.partitionBy(*keys, "__slice").orderBy(order))
    return (
        sliced.withColumn("__part", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(slices, [*keys, "__slice"])
        .withColumn(out, F.col("__base") + F.col("__part"))
        .drop("__slice", "__base", "__part")
    )
