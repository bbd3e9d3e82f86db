"""The product variability dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.operators import cleaning as K
from pricepanel.operators import panel as P
from pricepanel.operators import products as R
from pricepanel.schemas import PANEL, PanelColumns
from pricepanel.session import stage


def eligible_panel(panel: DataFrame, profiles: DataFrame, master: DataFrame, check_days: list[str], cols: PanelColumns = PANEL) -> DataFrame:
    """Quotes of products that are in the master and had a sales rank on the check days."""
    ranked = K.drop_products(panel, K.unranked_products(profiles, check_days, cols), cols)
    return K.keep_products(ranked, master, cols)


def weighted_days(days: DataFrame, profiles: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Days with every price measure, weighted by the gap to the day before, with profile columns."""
    measures = ["price_lowest", "price_anchor", "price_lowest_minrat", "price_lowest_avg3"]
    full = days.select(*cols.product_day, *measures).dropna(subset=measures)
    wanted = profiles.select(*cols.product_day, "reviews", "book_rating", "sales_rank")
    return P.with_gap_weights(full.join(wanted, cols.product_day, "left"), cols)


def fluctuation(
    eligible: DataFrame,
    anchor: str,
    profiles: DataFrame,
    clusters: DataFrame,
    master: DataFrame,
    bestsellers: DataFrame,
    list_prices: DataFrame,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """One row per product: variability of its prices, seller counts, displacement and attributes.

    The quotes are read twice: once for everything a product-day needs, once
    for the places of the first page. What follows works on product-days.
    """
    days = stage(R.day_measures(eligible, anchor, clusters, cols), "days")
    weighted = weighted_days(days, profiles, cols)
    variability = R.price_variability(weighted, cols=cols)
    moved = R.mean_displacement(P.seller_displacement(eligible, cols=cols), weighted, cols)
    products = R.covariates(days, cols).join(variability, [cols.product])
    described = R.product_attributes(products, master, bestsellers, list_prices, cols)
    return R.repair_missing(described).join(moved, [cols.product])
