"""Seller profiles and pair features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.functions import scalars as S
from pricepanel.functions import weighted as W
from pricepanel.operators import changes as C
from pricepanel.operators import panel as P
from pricepanel.operators import sellers as L
from pricepanel.schemas import PANEL, PanelColumns
from pricepanel.session import stage


def pair_history(panel: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """The panel with all pair-level lags, from one shuffle on (seller, product)."""
    return P.with_page_days(C.with_change_history(panel, cols), cols=cols)


def pair_profile(panel: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Change counts, observed days and rates of every pair."""
    return L.with_pair_rates(L.pair_counts(pair_history(panel, cols), cols))


def seller_profile(panel: DataFrame, anchor: str, cols: PanelColumns = PANEL) -> DataFrame:
    """About thirty features of each seller.

    The history is staged once; two branches then read their columns of it, one
    through pairs and one straight to sellers. The days of change come from the
    same aggregate as the moments, as a distinct count.
    """
    placed = P.with_quote_distances(P.with_day_context(panel, anchor, cols=cols), cols)
    history = stage(pair_history(placed, cols), "history")
    totals = L.seller_totals(L.with_pair_rates(L.pair_counts(history, cols)), cols)
    moments = history.groupBy(cols.seller).agg(
        *L.change_moments(),
        *L.target_moments(cols),
        F.avg("rating").alias("avg_rating"),
        F.avg("numrating").alias("avg_num_rating"),
        F.count("price_inc").alias("__changes"),
        F.count_distinct(F.when(F.col("is_change"), F.col(cols.day))).alias("__change_days"),
    )
    # Sellers without any change have no target at all.
    targets = [c for c in moments.columns if c.startswith("avg_tgt_pct")]
    moments = moments.withColumns({c: F.when(F.col("__changes") > 0, F.col(c)) for c in targets})
    return (
        totals.join(moments, [cols.seller])
        .withColumn("avg_num_same_day_change", S.ratio("__changes", "__change_days"))
        .withColumns(
            {
                "avg_pct_inventory_changed": S.ratio("avg_num_same_day_change", "num_listings"),
                "pct_listings_no_change": S.ratio("listings_no_change", "num_listings"),
            }
        )
        .drop("__changes", "__change_days")
    )


def pair_variability(panel: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Weighted spread, mean price, mean rank and CV of each pair; pairs without a spread go."""
    keys = cols.pair
    weighted = panel.withColumn("__w", F.coalesce(F.col("days_bet"), F.lit(1)))
    return (
        W.with_centres(weighted, keys, [cols.price], "__w")
        .groupBy(*keys)
        .agg(
            W.weighted_sd(cols.price, "__w").alias("stdev_price"),
            W.weighted_mean(cols.price, "__w").alias("mean_price"),
            W.weighted_mean(cols.rank, "__w").alias("mean_rank"),
        )
        .withColumn("cv", S.ratio("stdev_price", "mean_price"))
        .filter(F.col("stdev_price").isNotNull() & F.col("mean_price").isNotNull())
    )


def pair_features(panel: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Sixteen features of each pair: prices, ranks, days and changes, in one pass.

    Change features of pairs that never changed price are zero.
    """
    keys = cols.pair
    history = C.with_change_history(panel, cols).withColumn("__w", F.coalesce(F.col("days_bet"), F.lit(1)))
    change = F.col("is_change")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        W.with_centres(history, keys, [cols.price], "__w")
        .groupBy(*keys)
        .agg(
            W.weighted_sd(cols.price, "__w").alias("price_stdev"),
            W.weighted_mean(cols.price, "__w").alias("price_mean"),
            W.weighted_mean(cols.rank, "__w").alias("rank_mean"),
            F.sum("__w").alias("days_observed"),
            F.size(F.collect_set(cols.price)).alias("num_unique_price"),
            F.max(cols.price).alias("price_max"),
            F.min(cols.price).alias("price_min"),
            zero(F.avg(F.when(change, F.col(cols.rank)))).alias("avg_tgt_rank"),
            zero(F.avg("days_bet_change")).alias("avg_days_bet_change"),
            zero(F.avg(F.abs("pct_change"))).alias("avg_pct_change"),
            zero(F.sum("price_inc")).alias("num_increase"),
            zero(F.sum("price_dec")).alias("num_decrease"),
            zero(F.avg("ranks_bumped")).alias("avg_ranks_bumped"),
        )
        .withColumns(
            {
                "coeff_var": S.ratio("price_stdev", "price_mean"),
                "price_range": S.safe_ln("price_max") - S.safe_ln("price_min"),
                "num_change": F.col("num_increase") + F.col("num_decrease"),
            }
        )
    )
