"""Strategy classes of sellers and of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.functions import scalars as S
from pricepanel.operators import models as M
from pricepanel.operators import stats
from pricepanel.schemas import PANEL, PanelColumns
from pricepanel.session import stage

# The features by which sellers and pairs are classed, each with
# the offset inside its log, and the least activity that makes a class.
SELLER_FEATURES = {
    "avg_tgt_rank": 0.01,
    "avg_pct_inventory_changed": 0.0,
    "avg_days_bet_change": 0.01,
    "avg_abs_ranks_bumped": 0.01,
    "avg_pct_change": 0.0,
}
OTHER_SELLER_LOGS = {
    "sd_days_bet_change": 0.01,
    "avg_rating": 0.01,
    "avg_num_rating": 0.01,
    "avg_days_observed": 0.0,
    "avg_pct_first_page": 0.0,
}
PAIR_FEATURES = {
    "rank_mean": 0.0,
    "num_change": 0.1,
    "num_unique_price": 0.0,
    "avg_days_bet_change": 0.1,
    "avg_pct_change": 0.1,
    "coeff_var": 0.1,
    "pct_decrease": 0.1,
}
MIN_SELLER_CHANGES = 90
MIN_PAIR_DAYS = 50


def logs_of(features: dict[str, float]) -> list[str]:
    return [f"log_{c}" for c in features]


def active_sellers(profile: DataFrame, min_changes: int = MIN_SELLER_CHANGES) -> DataFrame:
    """Sellers with enough price changes, with the logs of their features."""
    return stats.log_features(profile.filter(F.col("num_price_change") > min_changes), {**SELLER_FEATURES, **OTHER_SELLER_LOGS})


def seller_classes(profile: DataFrame, k: int = 3, min_changes: int = MIN_SELLER_CHANGES, starts: int = M.STARTS, cols: PanelColumns = PANEL) -> DataFrame:
    """Seller and strategy class; class 1 is the largest."""
    columns = logs_of(SELLER_FEATURES)
    chosen = stage(active_sellers(profile, min_changes).select(cols.seller, *columns), "sellers")
    return M.cluster_rows(chosen, columns, k, starts)


def active_pairs(features: DataFrame, clusters: DataFrame, min_days: int = MIN_PAIR_DAYS, cols: PanelColumns = PANEL) -> DataFrame:
    """Changing pairs of the clustered sellers, seen long enough, with the logs of their features."""
    kept = features.join(clusters.select(cols.seller), [cols.seller], "left_semi").filter(
        (F.col("num_change") > 0) & (F.col("days_observed") > min_days)
    )
    return stats.log_features(kept.withColumn("pct_decrease", S.ratio("num_decrease", "num_change")), PAIR_FEATURES)


def pair_classes(features: DataFrame, clusters: DataFrame, k: int = 3, min_days: int = MIN_PAIR_DAYS, starts: int = M.STARTS, cols: PanelColumns = PANEL) -> DataFrame:
    """Pair and strategy class; class 1 is the largest."""
    columns = logs_of(PAIR_FEATURES)
    chosen = stage(active_pairs(features, clusters, min_days, cols).select(*cols.pair, *columns), "pairs")
    return M.cluster_rows(chosen, columns, k, starts)
