"""Weekly panel and seasonal price index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions import scalars as S
from pricepanel.schemas import PANEL, PanelColumns

MIN_WEEKS = 10  # fixed value: products seen in fewer weeks go
PRICES = ("price_anchor", "price_lowest")


def weekly_means(daily: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Mean prices of each product and elapsed week."""
    start = daily.agg(F.min(cols.day)).scalar()
    return (
        daily.withColumn("week_elapsed", S.week_elapsed(cols.day, start))
        .groupBy(cols.product, "week_elapsed")
        .agg(*[F.avg(c).alias(f"avg_{c}") for c in PRICES])
    )


def all_weeks(weekly: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Every product with every week from 1 to the last one seen."""
    last = weekly.agg(F.max("week_elapsed")).scalar()
    return weekly.select(cols.product).distinct().withColumn("week_elapsed", F.explode(F.sequence(F.lit(1), last)))


def fill_weeks(weekly: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Weekly panel without gaps: missing weeks take the price of the last week seen.

    ``weekly RIGHT JOIN all weeks``; weeks before a product is first seen stay null.
    The windows hold one row per product and week.
    """
    upto = Window.partitionBy(cols.product).orderBy("week_elapsed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dense = weekly.join(all_weeks(weekly, cols), [cols.product, "week_elapsed"], "right")
    return dense.withColumns({f"avg_{c}": F.last(f"avg_{c}", ignorenulls=True).over(upto) for c in PRICES})


def keep_frequent(filled: DataFrame, min_weeks: int = MIN_WEEKS, cols: PanelColumns = PANEL) -> DataFrame:
    """Products with a price in at least ``min_weeks`` weeks, by anti join on the others."""
    rare = (
        filled.groupBy(cols.product)
        .agg(F.count("avg_price_anchor").alias("weeks"))
        .filter(F.col("weeks") < min_weeks)
        .select(cols.product)
    )
    return filled.join(rare, [cols.product], "left_anti")


def with_initial_change(weekly: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Log change of each price from the product's first week; weeks before it go."""
    series = Window.partitionBy(cols.product).orderBy("week_elapsed").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    seen = weekly.filter(F.col("avg_price_anchor").isNotNull())
    return seen.withColumns(
        {
            f"{c.removeprefix('price_')}_initial_change": S.safe_ln(f"avg_{c}") - S.safe_ln(F.first(f"avg_{c}").over(series))
            for c in PRICES
        }
    )


def seasonal_index(changes: DataFrame, master: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Mean change from the initial price by product source and week."""
    return (
        changes.join(master, [cols.product])
        .groupBy("source", "week_elapsed")
        .agg(
            F.avg("anchor_initial_change").alias("anchor_initial_change"),
            F.avg("lowest_initial_change").alias("lowest_initial_change"),
            F.count(F.lit(1)).alias("products"),
        )
    )
