"""The regression models, each a coefficient table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricepanel.functions import scalars as S
from pricepanel.operators import mixed
from pricepanel.operators import models as M
from pricepanel.operators.panel import FIRST_PAGE_SIZE, pair_days
from pricepanel.schemas import PANEL, PanelColumns

# The samples of the models.
MAX_SALES_RANK = 1_000_000
MIN_SELLERS = 2
MIN_RATINGS = 100
RANK_OFFSET = 0.1

PRODUCT_TERMS = [
    "log_list_price", "no_list_price", "avg_ratings", "log_avg_sales_rank", "log_sd_sales_rank",
    "coeff_var_anchor", "num_sellers_excluded", "c1", "c2", "c3",
]


def product_sample(fluctuation: DataFrame) -> DataFrame:
    """Ranked products with several sellers, with the logs the models use."""
    return fluctuation.filter((F.col("avg_sales_rank") < MAX_SALES_RANK) & (F.col("num_sellers") >= MIN_SELLERS)).withColumns(
        {
            "log_list_price": S.safe_ln("list_price", 1.0),
            "log_avg_sales_rank": S.safe_ln("avg_sales_rank"),
            "log_sd_sales_rank": S.safe_ln("sd_sales_rank", 1.0),
        }
    )


def variability_model(fluctuation: DataFrame, response: str, by_list: bool = True, without: str | None = None) -> DataFrame:
    """Price variability in percent on product covariates, with list-name dummies unless told otherwise.

    ``without`` leaves out the products of one list.
    """
    sample = product_sample(fluctuation).withColumn("response", 100 * F.col(response))
    if without:
        sample = sample.filter(F.col("display_name") != without)
    return M.ols(sample, "response", PRODUCT_TERMS, ["display_name"] if by_list else None)


def pair_cv_model(pairs: DataFrame, fluctuation: DataFrame, profile: DataFrame, clusters: DataFrame, cluster: int = 1, cols: PanelColumns = PANEL) -> DataFrame:
    """CV of pairs of one seller class on product and seller covariates."""
    wanted = ["c1", "c2", "c3", "num_sellers_excluded", "avg_sales_rank", "sd_sales_rank", "list_price",
              "no_list_price", "coeff_var_anchor", "display_name"]
    seller_terms = ["num_listings", "avg_days_bet_change", "avg_tgt_rank", "avg_pct_inventory_changed"]
    members = clusters.filter(F.col("cluster") == cluster)
    sample = (
        pairs.join(members.select(cols.seller), [cols.seller], "left_semi")
        .join(fluctuation.select(cols.product, *wanted), [cols.product])
        .join(profile.select(cols.seller, *seller_terms), [cols.seller])
        .withColumns(
            {
                "response": 100 * F.col("cv"),
                "log_avg_sales_rank": S.safe_ln("avg_sales_rank", RANK_OFFSET),
                "log_sd_sales_rank": S.safe_ln("sd_sales_rank", RANK_OFFSET),
                "log_list_price": S.safe_ln("list_price", RANK_OFFSET),
                "log_num_listings": S.safe_ln("num_listings"),
            }
        )
    )
    terms = ["c1", "c2", "c3", "num_sellers_excluded", "log_avg_sales_rank", "log_sd_sales_rank", "log_list_price",
             "no_list_price", "coeff_var_anchor", "log_num_listings", *seller_terms[1:]]
    return M.ols(sample, "response", terms, ["display_name"])


def lifetime_model(lifetimes: DataFrame, descriptions: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Age of a fringe quote on its rank, prices and description."""
    sample = lifetimes.join(
        descriptions.select(*cols.pair, "num_words", "phrase_count"), cols.pair, "left"
    ).withColumn("log_mean_rank", S.safe_ln("mean_rank"))
    return M.ols(sample, "age", ["log_mean_rank", "still", "num_unique_prices", "num_words", "phrase_count"])


def change_sample(changes: DataFrame, page_size: int = FIRST_PAGE_SIZE, cols: PanelColumns = PANEL) -> DataFrame:
    """Change rows with the logs of gap, previous rank and rating count."""
    return changes.withColumns(
        {
            "log_days_bet_change": S.safe_ln("days_bet_change"),
            "log_rank_prev": S.safe_ln("rank_prev"),
            "log_numrating": S.safe_ln("numrating", 0.01),
            "first_page": S.flag(F.col(cols.rank) <= page_size),
        }
    )


def change_gap_model(changes: DataFrame, min_ratings: int = MIN_RATINGS, cols: PanelColumns = PANEL) -> DataFrame:
    """Log days between changes on rank, page, fulfilment and ratings."""
    sample = change_sample(changes, cols=cols).filter(F.col("numrating") > min_ratings)
    terms = ["first_change", "fba", "first_page", "log_rank_prev", "ranks_bumped", "log_numrating"]
    return M.ols(sample, "log_days_bet_change", terms)


def change_gap_effects(changes: DataFrame, probes: int = mixed.PROBES, cols: PanelColumns = PANEL) -> mixed.MixedFit:
    """Log days between changes on page, fulfilment, rank and ratings, with random intercepts of seller and product."""
    terms = ["first_change", "first_page", "fba", "log_rank_prev", "log_numrating"]
    return mixed.crossed_effects(change_sample(changes, cols=cols), "log_days_bet_change", terms, cols.seller, cols.product, probes)


def gap_size_model(profile: DataFrame) -> DataFrame:
    """Log mean gap between a seller's changes on its target rank, inventory share and size."""
    sample = profile.withColumns(
        {"log_gap": S.safe_ln("avg_days_bet_change", 0.01), "log_num_listings": S.safe_ln("num_listings")}
    )
    return M.ols(sample, "log_gap", ["avg_tgt_rank", "avg_pct_inventory_changed", "log_num_listings"])


def indicator_sample(ranked: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Panel rows with the change indicator and what a seller knew the day before.

    ``ranks_bumped`` is measured from the rank at the latest mark before the
    row; missing ratings are flagged and set to zero.
    """
    known_rank: Column = F.lag("rank_last_change").over(pair_days(cols))
    return ranked.withColumn("ranks_bumped", F.col("rank_prev") - known_rank).withColumns(
        {
            "days_bet": F.coalesce("days_bet", F.lit(1)),
            "no_rating": S.null_flag("rating"),
            "rating": S.zero_if_null("rating"),
            "numrating": S.zero_if_null("numrating"),
        }
    )


def probit_model(sample: DataFrame) -> DataFrame:
    """Probit of a price change on time, ratings, fulfilment and ranks lost."""
    return M.probit(sample, "indic_change", ["days_bet", "rating", "fba", "numrating", "no_rating", "ranks_bumped"])


def linear_change_model(sample: DataFrame, text_profile: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Linear probability of a price change, with the seller's text shares."""
    shares = text_profile.select(cols.seller, "pct_informative", "pct_generic")
    terms = ["days_bet", cols.rank, "no_rating", "numrating", "pct_informative", "pct_generic"]
    return M.ols(sample.join(shares, [cols.seller], "left"), "indic_change", terms)
