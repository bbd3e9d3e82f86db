"""Lags, gaps and neighbours on the panel.

Windows over a pair (seller, product) see one row per day at most, and windows
over a product's daily series likewise: their length is bounded by the calendar.
A product-day may hold any number of sellers, so what looks across it
(`with_day_context`) works on slices of ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions import scalars as S
from pricepanel.schemas import PANEL, PanelColumns

FIRST_PAGE_SIZE = 15  # fixed value: quotes on one page
RANKS_PER_SLICE = 4096


def pair_days(cols: PanelColumns = PANEL):
    return Window.partitionBy(*cols.pair).orderBy(cols.day)


def with_observation_lags(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Previous rank and days since the previous observation of the pair."""
    w = pair_days(cols)
    return df.withColumns(
        {
            "rank_prev": F.lag(cols.rank).over(w),
            "days_bet": F.datediff(F.col(cols.day), F.lag(cols.day).over(w)),
        }
    )


def with_price_lags(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Previous price, change and change indicator of the pair; null at the first observation."""
    return (
        df.withColumn("price2_prev", F.lag(cols.price).over(pair_days(cols)))
        .withColumn("price2_change", F.col(cols.price) - F.col("price2_prev"))
        .withColumn("indic_change", S.flag(F.col("price2_change") != 0))
    )


def with_page_days(df: DataFrame, page_size: int = FIRST_PAGE_SIZE, cols: PanelColumns = PANEL) -> DataFrame:
    """Days until the pair is seen next, and those of them that follow a first-page day."""
    ahead = F.datediff(F.lead(cols.day).over(pair_days(cols)), F.col(cols.day))
    first_page = S.flag(F.col(cols.rank) <= page_size)
    return df.withColumns({"days_next": ahead, "first_page": first_page}).withColumn(
        "days_first_page", F.col("first_page") * F.col("days_next")
    )


def with_day_context(df: DataFrame, anchor: str, slice_size: int = RANKS_PER_SLICE, cols: PanelColumns = PANEL) -> DataFrame:
    """Add the next lower and next higher quote by rank, the lowest quote and the anchor's.

    Each product-day is cut into slices of ranks. Neighbours inside a slice come
    from a window over the slice; the edges, the lowest and the anchor's price
    come from one small row per slice.
    """
    sliced = df.withColumn("__slice", F.floor((F.col(cols.rank) - 1) / F.lit(slice_size)).cast("int"))
    keys = [*cols.product_day, "__slice"]
    across = Window.partitionBy(*cols.product_day).orderBy("__slice")
    whole = Window.partitionBy(*cols.product_day)
    edges = (
        sliced.groupBy(*keys)
        .agg(
            F.min_by(cols.price, cols.rank).alias("__first"),
            F.max_by(cols.price, cols.rank).alias("__last"),
            F.min(F.when(F.col(cols.rank) == 1, F.col(cols.price))).alias("__lowest"),
            F.min(F.when(F.col(cols.seller) == anchor, F.col(cols.price))).alias("__anchor"),
        )
        .select(
            *keys,
            F.lag("__last").over(across).alias("__before"),
            F.lead("__first").over(across).alias("__after"),
            F.min("__lowest").over(whole).alias("price_lowest"),
            F.min("__anchor").over(whole).alias("price_anchor"),
        )
    )
    within = Window.partitionBy(*keys).orderBy(cols.rank)
    return (
        sliced.withColumns(
            {"__down": F.lag(cols.price).over(within), "__up": F.lead(cols.price).over(within)}
        )
        .join(edges, keys)
        .withColumns(
            {
                "price_next_lowest": F.coalesce("__down", "__before"),
                "price_next_highest": F.coalesce("__up", "__after"),
            }
        )
        .drop("__slice", "__down", "__up", "__before", "__after")
    )


def with_quote_distances(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Distances to the neighbours, the lowest and the anchor, as shares of the own price."""
    own = F.col(cols.price)
    return df.withColumns(
        {
            f"pct_diff_{name}": S.ratio(own - F.col(f"price_{name}"), own)
            for name in ("next_lowest", "next_highest", "lowest", "anchor")
        }
    )


def special_prices(df: DataFrame, anchor: str, cols: PanelColumns = PANEL) -> DataFrame:
    """Lowest price of each product-day with the anchor's beside it, null where it has none.

    The lowest side is kept whole: ``anchor RIGHT JOIN lowest``.
    """
    lowest = df.filter(F.col(cols.rank) == 1).select(*cols.product_day, F.col(cols.price).alias("price_lowest"))
    of_anchor = df.filter(F.col(cols.seller) == anchor).select(*cols.product_day, F.col(cols.price).alias("price_anchor"))
    return of_anchor.join(lowest, cols.product_day, "right")


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner", on: list[str] | None = None) -> DataFrame:
    """Join on all column names the two sides share, or on the stated ones."""
    return a.join(b, on or [c for c in a.columns if c in b.columns], how)


def lowest_vs_anchor(df: DataFrame, anchor: str, cols: PanelColumns = PANEL) -> DataFrame:
    """Lowest and anchor price of each product-day that has both, in one aggregate pass."""
    return (
        df.filter((F.col(cols.rank) == 1) | (F.col(cols.seller) == anchor))
        .groupBy(*cols.product_day)
        .agg(
            F.min(F.when(F.col(cols.rank) == 1, F.col(cols.price))).alias("price_lowest"),
            F.min(F.when(F.col(cols.seller) == anchor, F.col(cols.price))).alias("price_anchor"),
        )
        .filter(F.col("price_lowest").isNotNull() & F.col("price_anchor").isNotNull())
    )


def with_gap_weights(daily: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Days since the product's previous observation, 1 for its first; needs one row per product-day."""
    w = Window.partitionBy(cols.product).orderBy(cols.day)
    return daily.withColumn(
        "days_bet", F.coalesce(F.datediff(F.col(cols.day), F.lag(cols.day).over(w)), F.lit(1))
    )


def seller_displacement(df: DataFrame, top: int = FIRST_PAGE_SIZE, cols: PanelColumns = PANEL) -> DataFrame:
    """Per product-day: ranked places with a known previous holder, and places whose holder changed."""
    place = Window.partitionBy(cols.product, cols.rank).orderBy(cols.day)
    return (
        df.filter(F.col(cols.rank) <= top)
        .withColumn("__moved", S.flag(F.col(cols.seller) != F.lag(cols.seller).over(place)))
        .filter(F.col("__moved").isNotNull())
        .groupBy(*cols.product_day)
        .agg(F.count(F.lit(1)).alias("num_ranked"), F.sum("__moved").alias("displaced"))
    )


def log_returns(daily: DataFrame, series: dict[str, str], cols: PanelColumns = PANEL) -> DataFrame:
    """Log change of each series since the product's previous day; the first day goes.

    ``series`` maps a column to the name of its log change.
    """
    w = Window.partitionBy(cols.product).orderBy(cols.day)
    changes = {out: S.safe_ln(c) - S.safe_ln(F.lag(c).over(w)) for c, out in series.items()}
    return (
        daily.withColumns({**changes, "__before": F.lag(cols.day).over(w)})
        .filter(F.col("__before").isNotNull())
        .drop("__before")
    )


def seller_series(df: DataFrame, seller: str, cols: PanelColumns = PANEL) -> DataFrame:
    """Price and rank series of every product one seller lists."""
    return df.filter(F.col(cols.seller) == seller).select(*cols.pair, cols.day, cols.price, cols.rank)
