"""Product-level price measures, variability and covariates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions import scalars as S
from pricepanel.functions import weighted as W
from pricepanel.operators.cleaning import distinct_by_key
from pricepanel.operators.sellers import FRINGE_RATINGS
from pricepanel.schemas import PANEL, PanelColumns

# The rank bound of robust prices, the size of the low average,
# and the bounds of sane prices.
ROBUST_RANKS = 10
LOW_RANKS = 3
MIN_PRICE = 0.1
MAX_PRICE = 300.0
CLUSTERS = (1, 2, 3)


def lowest_quote(panel: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """The cheapest quote of each product-day."""
    return panel.filter(F.col(cols.rank) == 1).select(
        *cols.product_day, F.col(cols.seller).alias("seller_lowest"), F.col(cols.price).alias("price_lowest")
    )


def is_robust(anchor: str, min_ratings: float = FRINGE_RATINGS, cols: PanelColumns = PANEL) -> Column:
    """Well-rated sellers among the first ranks, or the anchor anywhere."""
    rated = (F.col("numrating") >= min_ratings) & (F.col(cols.rank) < ROBUST_RANKS)
    return F.coalesce(rated, F.lit(False)) | (F.col(cols.seller) == anchor)


def robust_lowest(panel: DataFrame, anchor: str, cols: PanelColumns = PANEL) -> DataFrame:
    """Lowest non-fringe price and mean of the three lowest, per product-day, in one pass."""
    return (
        panel.filter(is_robust(anchor, cols=cols) | (F.col(cols.rank) <= LOW_RANKS))
        .groupBy(*cols.product_day)
        .agg(
            F.min(F.when(is_robust(anchor, cols=cols), F.col(cols.price))).alias("price_lowest_minrat"),
            F.avg(F.when(F.col(cols.rank) <= LOW_RANKS, F.col(cols.price))).alias("price_lowest_avg3"),
        )
    )


def day_measures(panel: DataFrame, anchor: str, clusters: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """All price measures and seller counts of a product-day in one aggregate.

    Sellers found in ``clusters`` (one row per seller) count by cluster, the
    others as excluded.
    """
    anchored = F.col(cols.seller) == anchor
    robust = is_robust(anchor, cols=cols)
    non_fringe = F.coalesce(F.col("numrating") >= FRINGE_RATINGS, F.lit(False)) | anchored
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    price = F.col(cols.price)
    return (
        panel.join(clusters.select(cols.seller, "cluster"), [cols.seller], "left")
        .groupBy(*cols.product_day)
        .agg(
            F.min(F.when(F.col(cols.rank) == 1, price)).alias("price_lowest"),
            F.min(F.when(robust, price)).alias("price_lowest_minrat"),
            F.avg(F.when(F.col(cols.rank) <= LOW_RANKS, price)).alias("price_lowest_avg3"),
            F.min(F.when(anchored, price)).alias("price_anchor"),
            F.count(F.lit(1)).alias("num_sellers"),
            count(non_fringe).alias("num_sellers_minrat"),
            count(anchored | (F.col("fba") == 1)).alias("num_fba"),
            F.count("cluster").alias("num_clustered"),
            *[count(F.col("cluster") == k).alias(f"c{k}") for k in CLUSTERS],
            count(F.col("cluster").isNull()).alias("num_sellers_excluded"),
        )
    )


def seller_counts(days: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Mean sellers, non-fringe sellers and fulfilled sellers per day of each product."""
    return days.groupBy(cols.product).agg(
        *[F.avg(c).alias(c) for c in ("num_sellers", "num_sellers_minrat", "num_fba")]
    )


def cluster_counts(days: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Mean sellers by cluster, over the days with any clustered seller."""
    present = days.filter(F.col("num_clustered") > 0)
    return present.groupBy(cols.product).agg(*[F.avg(f"c{k}").alias(f"c{k}") for k in CLUSTERS])


def excluded_sellers(panel: DataFrame, clusters: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Mean number of sellers outside the clusters, over the days with any."""
    outside = panel.join(clusters.select(cols.seller), [cols.seller], "left_anti")
    daily = outside.groupBy(*cols.product_day).agg(F.count(F.lit(1)).alias("__n"))
    return daily.groupBy(cols.product).agg(F.avg("__n").alias("num_sellers_excluded"))


def covariates(days: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """`seller_counts`, `cluster_counts` and excluded sellers of a product in one aggregate."""
    clustered = F.col("num_clustered") > 0
    excluded = F.col("num_sellers_excluded")
    return days.groupBy(cols.product).agg(
        *[F.avg(c).alias(c) for c in ("num_sellers", "num_sellers_minrat", "num_fba")],
        *[F.avg(F.when(clustered, F.col(f"c{k}"))).alias(f"c{k}") for k in CLUSTERS],
        F.avg(F.when(excluded > 0, excluded)).alias("num_sellers_excluded"),
    )


def price_variability(weighted_days: DataFrame, min_price: float = MIN_PRICE, cols: PanelColumns = PANEL) -> DataFrame:
    """Spread of each product's daily price measures, weighted by days, with controls.

    Takes daily rows with ``days_bet``, the four price measures, and the
    profile columns ``reviews``, ``book_rating`` and ``sales_rank``.
    """
    w = "days_bet"
    spread = ["price_lowest", "sales_rank", "price_anchor", "price_lowest_minrat", "price_lowest_avg3"]
    mean, sd = (lambda c: W.weighted_mean(c, w)), (lambda c: W.weighted_sd(c, w))
    out = (
        W.with_centres(weighted_days, [cols.product], spread, w)
        .groupBy(cols.product)
        .agg(
            F.min("price_lowest").alias("price_lowest_min"),
            F.max("price_lowest").alias("price_lowest_max"),
            mean("price_lowest").alias("mean_lowest"),
            sd("price_lowest").alias("sd_lowest"),
            F.avg("reviews").alias("avg_num_reviews"),
            F.avg("book_rating").alias("avg_ratings"),
            mean("sales_rank").alias("avg_sales_rank"),
            sd("sales_rank").alias("sd_sales_rank"),
            mean("price_anchor").alias("avg_price_anchor"),
            sd("price_anchor").alias("sd_price_anchor"),
            F.min("price_lowest_minrat").alias("price_lowest_minrat_min"),
            F.max("price_lowest_minrat").alias("price_lowest_minrat_max"),
            mean("price_lowest_minrat").alias("mean_minrat"),
            sd("price_lowest_minrat").alias("sd_minrat"),
            mean("price_lowest_avg3").alias("mean_avg3"),
            sd("price_lowest_avg3").alias("sd_avg3"),
        )
    )
    pct_range = lambda c: S.ratio(F.col(f"{c}_max") - F.col(f"{c}_min"), f"{c}_min")
    return out.withColumns(
        {
            "pct_diff_max_min": pct_range("price_lowest"),
            "coeff_var": S.ratio("sd_lowest", "mean_lowest"),
            "coeff_var_anchor": S.ratio("sd_price_anchor", "avg_price_anchor"),
            "pct_diff_minrat": pct_range("price_lowest_minrat"),
            "coeff_var_minrat": S.ratio("sd_minrat", "mean_minrat"),
            "coeff_var_avg3": S.ratio("sd_avg3", "mean_avg3"),
        }
    ).filter(F.col("price_lowest_min") > min_price)


def mean_displacement(displaced: DataFrame, weighted_days: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Day-weighted mean of displaced places per product; days without a count drop out."""
    return (
        weighted_days.select(*cols.product_day, "days_bet")
        .join(displaced, cols.product_day, "left")
        .groupBy(cols.product)
        .agg(W.weighted_mean("displaced", "days_bet").alias("avg_displaced"))
    )


def product_attributes(products: DataFrame, master: DataFrame, bestsellers: DataFrame, list_prices: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """List name (or else source), list price and format of each product, one row each.

    Of several list names the first in alphabetical order stays.
    """
    named = distinct_by_key(bestsellers.select(cols.product, "display_name").distinct(), [cols.product], ["display_name"])
    return (
        products.join(master, [cols.product], "left")
        .join(named, [cols.product], "left")
        .join(list_prices.select(cols.product, "list_price", "format"), [cols.product], "left")
        .withColumn("display_name", F.coalesce("display_name", "source"))
        .drop("source")
    )


def repair_missing(products: DataFrame) -> DataFrame:
    """Indicators for what is missing, then zeros: no spread means the value never changed."""
    zeros = ["sd_lowest", "sd_sales_rank", "sd_price_anchor", "coeff_var", "coeff_var_anchor", "list_price"]
    return products.withColumns(
        {"no_anchor_change": S.null_flag("sd_price_anchor"), "no_list_price": S.null_flag("list_price")}
    ).withColumns({c: S.zero_if_null(c) for c in zeros})


def binned_variability(products: DataFrame, covariates: list[str]) -> DataFrame:
    """Mean variability by each covariate rounded half-even, all binnings in one pass."""
    binned = F.explode(
        F.array(*[F.struct(F.lit(c).alias("covariate"), S.half_even(F.col(c).cast("double")).alias("bin")) for c in covariates])
    )
    return (
        products.select("pct_diff_max_min", "coeff_var", binned.alias("__b"))
        .select("__b.*", "pct_diff_max_min", "coeff_var")
        .groupBy("covariate", "bin")
        .agg(
            F.avg("pct_diff_max_min").alias("pct_diff_max_min"),
            F.avg("coeff_var").alias("coeff_var"),
            F.count(F.lit(1)).alias("products"),
        )
    )


def robust_range(minrat_days: DataFrame, min_price: float = MIN_PRICE, max_price: float = MAX_PRICE, cols: PanelColumns = PANEL) -> DataFrame:
    """Range of the robust lowest price of each product, within sane prices."""
    return (
        minrat_days.groupBy(cols.product)
        .agg(F.min("price_lowest_minrat").alias("min_price"), F.max("price_lowest_minrat").alias("max_price"))
        .filter((F.col("min_price") > min_price) & (F.col("max_price") < max_price))
        .withColumn("pct_diff", S.ratio(F.col("max_price") - F.col("min_price"), "min_price"))
    )
