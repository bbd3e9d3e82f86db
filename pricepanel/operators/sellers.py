"""Seller behaviour: from pairs (seller, product) up to sellers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.functions import scalars as S
from pricepanel.operators.changes import pair_change_counts
from pricepanel.schemas import PANEL, PanelColumns

FRINGE_RATINGS = 415  # fixed value: sellers with fewer ratings are the fringe
FULFILLED_SHARE = 0.1  # fixed value: share of listings that makes a fulfilled seller


def days_observed(panel: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Days covered by each pair: the gaps between its observations, plus one."""
    return panel.groupBy(*cols.pair).agg((F.coalesce(F.sum("days_bet"), F.lit(0)) + 1).alias("days_observed"))


def first_page_days(paged: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Days observed and days on the first page of each pair, from ``with_page_days``."""
    return paged.groupBy(*cols.pair).agg(
        F.coalesce(F.sum("days_next"), F.lit(0)).alias("days_observed"),
        F.coalesce(F.sum("days_first_page"), F.lit(0)).alias("days_first_page"),
    )


def first_page_share(paged: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return first_page_days(paged, cols).withColumn("pct_first_page", S.ratio("days_first_page", "days_observed"))


def pair_counts(history: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Change counts and days of every pair in one aggregate.

    Same rows as ``merge_pair_counts``; pairs without a change count zero.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (
        history.groupBy(*cols.pair)
        .agg(
            total("price_inc").alias("num_price_inc"),
            total("price_dec").alias("num_price_dec"),
            total("days_next").alias("days_observed"),
            total("days_first_page").alias("days_first_page"),
        )
        .withColumn("num_price_change", F.col("num_price_inc") + F.col("num_price_dec"))
    )


def merge_pair_counts(changes: DataFrame, paged: DataFrame, only_changed: bool = False, cols: PanelColumns = PANEL) -> DataFrame:
    """Join change counts and observed days of pairs, kept on both sides; gaps become zero.

    ``only_changed`` keeps the pairs with a change (a left join) instead.
    """
    how = "left" if only_changed else "full"
    return pair_change_counts(changes, cols).join(first_page_days(paged, cols), cols.pair, how).fillna(0)


def with_pair_rates(counts: DataFrame) -> DataFrame:
    """Rates per observed day, and a flag for pairs that never changed price."""
    return counts.withColumns(
        {
            "pct_first_page": S.ratio("days_first_page", "days_observed"),
            "changes_per_day": S.ratio("num_price_change", "days_observed"),
            "inc_per_day": S.ratio("num_price_inc", "days_observed"),
            "dec_per_day": S.ratio("num_price_dec", "days_observed"),
            "no_change": S.flag(F.col("num_price_change") == 0),
        }
    )


def seller_totals(pairs: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Sums and means of pair features per seller; missing means become zero."""
    sums = {"num_price_inc": "num_price_inc", "num_price_dec": "num_price_dec",
            "num_price_change": "num_price_change", "no_change": "listings_no_change"}
    means = ["days_observed", "days_first_page", "pct_first_page", "changes_per_day", "inc_per_day", "dec_per_day"]
    return (
        pairs.groupBy(cols.seller)
        .agg(
            F.count(F.lit(1)).alias("num_listings"),
            *[F.sum(c).alias(out) for c, out in sums.items()],
            *[F.avg(c).alias(f"avg_{c}") for c in means],
        )
        .withColumn("prop_changes_inc", S.ratio("num_price_inc", "num_price_change"))
        .fillna(0)
    )


def change_moments() -> list:
    """Aggregates over change rows; rows of other kinds hold nulls and do not count."""
    gap, bumped, size = F.col("days_bet_change"), F.col("ranks_bumped"), F.abs("pct_change")
    change = F.col("price_inc").isNotNull()
    return [
        F.avg(gap).alias("avg_days_bet_change"),
        F.stddev_samp(gap).alias("sd_days_bet_change"),
        F.avg(bumped).alias("avg_ranks_bumped"),
        F.stddev_samp(bumped).alias("sd_ranks_bumped"),
        F.avg(F.abs(bumped)).alias("avg_abs_ranks_bumped"),
        F.stddev_samp(F.abs(bumped)).alias("sd_abs_ranks_bumped"),
        F.avg(F.when(F.col("price_inc") == 1, size)).alias("avg_pct_inc"),
        F.avg(F.when(F.col("price_dec") == 1, size)).alias("avg_pct_dec"),
        F.avg(size).alias("avg_pct_change"),
        F.avg(F.when(change, F.abs("price2_change"))).alias("avg_price_change"),
    ]


def target_moments(cols: PanelColumns = PANEL) -> list:
    """Where sellers land with a change: rank, and distance to neighbours, lowest and anchor."""
    change = F.col("price_inc").isNotNull()
    at_change = lambda c: F.when(change, F.col(c))
    zero = lambda c: F.coalesce(F.avg(at_change(c)), F.lit(0.0))
    return [
        F.avg(at_change(cols.rank)).alias("avg_tgt_rank"),
        F.stddev_samp(at_change(cols.rank)).alias("sd_tgt_rank"),
        zero("pct_diff_next_lowest").alias("avg_tgt_pct_diff_next_lowest"),
        zero("pct_diff_next_highest").alias("avg_tgt_pct_diff_next_highest"),
        zero("pct_diff_lowest").alias("avg_tgt_pct_diff_lowest"),
        F.avg(at_change("pct_diff_anchor")).alias("avg_tgt_pct_diff_anchor"),
    ]


def seller_change_moments(changes: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return changes.groupBy(cols.seller).agg(*change_moments())


def seller_targets(changes: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return changes.groupBy(cols.seller).agg(*target_moments(cols))


def num_listings(panel: DataFrame, approx: bool = False, cols: PanelColumns = PANEL) -> DataFrame:
    """Distinct products per seller; ``approx`` trades exactness for a fixed-size sketch."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return panel.groupBy(cols.seller).agg(count(cols.product).alias("num_listings"))


def change_synchronization(changes: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Price changes of each seller on each day it changed any."""
    return changes.groupBy(cols.day, cols.seller).agg(F.count(F.lit(1)).alias("num_same_day_change"))


def mean_synchronization(synch: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return synch.groupBy(cols.seller).agg(F.avg("num_same_day_change").alias("avg_num_same_day_change"))


def seller_ratings(panel: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return panel.groupBy(cols.seller).agg(
        F.avg("rating").alias("avg_rating"), F.avg("numrating").alias("avg_num_rating")
    )


def fulfilled_share(panel: DataFrame, threshold: float = FULFILLED_SHARE, cols: PanelColumns = PANEL) -> DataFrame:
    """Share of a seller's products it ever fulfilled, and a flag above the threshold."""
    pairs = panel.groupBy(*cols.pair).agg(F.max("fba").alias("ever"))
    return (
        pairs.groupBy(cols.seller)
        .agg(F.coalesce(F.avg("ever"), F.lit(0.0)).alias("pct_fba"))
        .withColumn("fba", S.flag(F.col("pct_fba") > threshold))
    )


def quote_lifetime(panel: DataFrame, cut: str, fringe: float = FRINGE_RATINGS, cols: PanelColumns = PANEL) -> DataFrame:
    """First and last day, age, prices and mean rank of each fringe pair; still alive at the cut date."""
    return (
        panel.filter(F.col("numrating") < fringe)
        .groupBy(*cols.pair)
        .agg(
            F.min(cols.day).alias("first_day"),
            F.max(cols.day).alias("last_day"),
            F.count_distinct(cols.price).alias("num_unique_prices"),
            F.avg(cols.rank).alias("mean_rank"),
        )
        .withColumns(
            {
                "still": S.flag(F.col("last_day") >= F.to_date(F.lit(cut))),
                "age": F.datediff("last_day", "first_day") + 1,
            }
        )
    )


def top_rows(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The ``k`` rows with the largest value; ties by the given column."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie)).limit(k)


def change_concentration(sellers: DataFrame, top: int, cols: PanelColumns = PANEL) -> DataFrame:
    """Share of all price changes made by the ``top`` most active sellers."""
    leaders = top_rows(sellers, "num_price_change", top, cols.seller).agg(F.sum("num_price_change"))
    return sellers.agg(F.sum("num_price_change").alias("changes")).select(
        "changes", leaders.scalar().alias("top_changes")
    ).withColumn("share", S.ratio("top_changes", "changes"))


def rating_shares(sellers: DataFrame, above: float = 90.0, top: int = 100, cols: PanelColumns = PANEL) -> DataFrame:
    """Share of rated sellers above a rating, among all and among the most rated."""
    share = lambda c: F.avg(F.when(F.col("avg_rating").isNotNull(), S.flag(F.col("avg_rating") > above))).alias(c)
    of_top = top_rows(sellers, "avg_num_rating", top, cols.seller).agg(share("s"))
    return sellers.agg(share("share_above"), F.count("avg_rating").alias("rated")).withColumn(
        "top_share_above", of_top.scalar()
    )
