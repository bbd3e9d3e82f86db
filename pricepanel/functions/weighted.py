"""Weighted mean and frequency-weighted standard deviation as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(value: str, weight: str, skip_null_weights: bool = True) -> Column:
    """``sum(w * x) / sum(w)``; by default weights of null values do not count."""
    w = F.when(F.col(value).isNotNull(), F.col(weight)) if skip_null_weights else F.col(weight)
    return F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(w).cast("double"))


def centre_name(value: str) -> str:
    return f"__centre_{value}"


def with_centres(
    df: DataFrame, keys: list[str], values: list[str], weight: str, skip_null_weights: bool = False
) -> DataFrame:
    """Add the weighted mean of each value over its group, the first pass of ``weighted_sd``.

    The groups are series with one row per day, so a window holds at most one
    row per calendar day. The aggregate that follows on the same keys needs no
    further shuffle. Two passes avoid the cancellation of sums of squares.
    """
    group = Window.partitionBy(*keys)
    centres = {}
    for value in values:
        weights = F.when(F.col(value).isNotNull(), F.col(weight)) if skip_null_weights else F.col(weight)
        centres[centre_name(value)] = F.try_divide(
            F.sum(F.col(weight) * F.col(value)).over(group), F.sum(weights).over(group).cast("double")
        )
    return df.withColumns(centres)


def weighted_sd(value: str, weight: str, skip_null_weights: bool = False) -> Column:
    """Standard deviation with frequency weights, after ``with_centres`` on the same keys.

    ``N`` is the sum of all weights, those of null values included; set
    ``skip_null_weights`` to leave them out. Null unless ``N`` is above 1.
    """
    weights = F.when(F.col(value).isNotNull(), F.col(weight)) if skip_null_weights else F.col(weight)
    total = F.sum(weights).cast("double")
    spread = F.sum(F.col(weight) * F.pow(F.col(value) - F.col(centre_name(value)), F.lit(2.0)))
    return F.when(total > 1, F.sqrt(spread / F.when(total > 1, total - 1)))
