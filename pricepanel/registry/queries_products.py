"""Queries that collapse the panel to products, weeks and their models in closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.functions import scalars as S
from pricepanel.functions.quantiles import exact_quantiles
from pricepanel.operators import cleaning as K
from pricepanel.operators import panel as P
from pricepanel.operators import products as R
from pricepanel.operators import stats
from pricepanel.plans import clean, season, variability
from pricepanel.registry.core import query
from pricepanel.registry.fixture import ANCHOR
from pricepanel.session import stage

VARIABILITY = (
    "isbn price_lowest_min:f price_lowest_max:f mean_lowest:f sd_lowest:f avg_num_reviews:f avg_ratings:f avg_sales_rank:f "
    "sd_sales_rank:f avg_price_anchor:f sd_price_anchor:f price_lowest_minrat_min:f price_lowest_minrat_max:f mean_minrat:f "
    "sd_minrat:f mean_avg3:f sd_avg3:f pct_diff_max_min:f coeff_var:f coeff_var_anchor:f pct_diff_minrat:f coeff_var_minrat:f "
    "coeff_var_avg3:f"
)
FLUCTUATION = (
    f"{VARIABILITY} num_sellers:f num_sellers_minrat:f num_fba:f c1:f c2:f c3:f num_sellers_excluded:f no_anchor_change:i "
    "display_name list_price:f format no_list_price:i avg_displaced:f"
)
BINNED = ["num_sellers", "num_sellers_minrat", "num_fba", "num_sellers_excluded", "c1", "c2", "c3"]


@query(
    "isbn dateacc:d price_lowest_minrat:f price_lowest_avg3:f",
    f"""SELECT isbn, dateacc,
          min(CASE WHEN coalesce(numrating >= 415 AND rank < 10, false) OR seller = '{ANCHOR}' THEN price2 END) AS price_lowest_minrat,
          avg(CASE WHEN rank <= 3 THEN price2 END) AS price_lowest_avg3
        FROM panel GROUP BY ALL HAVING price_lowest_minrat IS NOT NULL OR price_lowest_avg3 IS NOT NULL""",
)
def robust_lowest(f):
    return R.robust_lowest(f.panel, ANCHOR)


@query(
    "isbn dateacc:d price_lowest:f price_anchor:f price_lowest_minrat:f price_lowest_avg3:f days_bet:i",
    "SELECT * FROM weighted_days",
)
def lowest_gap_weights(f):
    return f.weighted_days


@query(VARIABILITY, "SELECT * FROM variability")
def price_variability(f):
    return R.price_variability(f.weighted_days)


@query("isbn num_sellers:f num_sellers_minrat:f num_fba:f", "SELECT * FROM mean_sellers")
def seller_counts(f):
    return R.seller_counts(f.days)


@query("isbn c1:f c2:f c3:f", "SELECT * FROM mean_clusters")
def cluster_counts(f):
    return R.cluster_counts(f.days)


@query("isbn num_sellers_excluded:f", "SELECT * FROM mean_excluded")
def excluded_sellers(f):
    return R.excluded_sellers(f.eligible, f.clusters)


@query(
    "isbn dateacc:d days_bet:i num_ranked:i displaced:i avg_displaced:f",
    """SELECT isbn, dateacc, days_bet, num_ranked, displaced, avg_displaced
       FROM weighted_days LEFT JOIN moved USING (isbn, dateacc) JOIN mean_moved USING (isbn)""",
)
def displacement(f):
    eligible = stage(f.eligible, "eligible")
    days = stage(
        variability.weighted_days(R.day_measures(eligible, ANCHOR, f.clusters), f.profiles).select("isbn", "dateacc", "days_bet"),
        "days",
    )
    moved = stage(P.seller_displacement(eligible), "moved")
    daily = days.join(moved, ["isbn", "dateacc"], "left")
    return daily.join(R.mean_displacement(moved, days), ["isbn"])


@query("isbn display_name list_price:f format", "SELECT * FROM attributes")
def product_attributes(f):
    every = f.table("part").select(F.col("p_brand").alias("isbn")).distinct()
    return R.product_attributes(every, f.master, f.bestsellers, f.list_prices)


@query("display_name isbn", "SELECT DISTINCT display_name, isbn FROM bestsellers")
def distinct_products(f):
    return f.bestsellers.distinct()


@query("display_name isbn", "SELECT min(display_name) AS display_name, isbn FROM bestsellers GROUP BY isbn")
def distinct_by_key(f):
    return K.distinct_by_key(f.bestsellers, ["isbn"], ["display_name"])


@query(FLUCTUATION, "SELECT * FROM fluctuation")
def fluctuation(f):
    return f.fluctuation


@query(
    "covariate bin:f pct_diff_max_min:f coeff_var:f products:i",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS covariate, round_even({c}, 0) AS bin, avg(pct_diff_max_min) AS pct_diff_max_min,
                   avg(coeff_var) AS coeff_var, count(*) AS products FROM fluctuation GROUP BY ALL"""
        for c in BINNED
    ),
)
def binned_variability(f):
    return R.binned_variability(f.fluctuation, BINNED)


ROBUST_RANGE = """
SELECT isbn, min(price_lowest_minrat) AS min_price, max(price_lowest_minrat) AS max_price,
       (max(price_lowest_minrat) - min(price_lowest_minrat)) / min(price_lowest_minrat) AS pct_diff
FROM (SELECT isbn, dateacc, min(price2) AS price_lowest_minrat FROM eligible
      WHERE coalesce(numrating >= 415 AND rank < 10, false) OR seller = 'ANCHOR' GROUP BY ALL)
WHERE isbn IN (SELECT isbn FROM fluctuation) GROUP BY isbn HAVING min_price > 0.1 AND max_price < 2000
"""


@query(
    "isbn min_price:f max_price:f pct_diff:f median_pct_diff:f",
    f"SELECT *, (SELECT median(pct_diff) FROM ({ROBUST_RANGE})) AS median_pct_diff FROM ({ROBUST_RANGE})",
)
def variability_minrat(f):
    """Range of the robust lowest price by product, and the median over products."""
    eligible = stage(f.eligible, "eligible")
    robust = R.robust_lowest(eligible, ANCHOR).filter(F.col("price_lowest_minrat").isNotNull())
    ranges = stage(K.keep_products(R.robust_range(robust, max_price=2000.0), f.fluctuation), "ranges")
    median = exact_quantiles(ranges, ["pct_diff"], [0.5]).select("quantile").scalar()
    return ranges.withColumn("median_pct_diff", median)


@query("isbn week_elapsed:i avg_price_anchor:f avg_price_lowest:f", "SELECT * FROM weekly_kept")
def weekly_panel(f):
    return season.weekly_panel(f.panel, ANCHOR)


@query(
    "source week_elapsed:i anchor_initial_change:f lowest_initial_change:f products:i",
    """SELECT source, week_elapsed, avg(anchor_initial_change) AS anchor_initial_change,
              avg(lowest_initial_change) AS lowest_initial_change, count(*) AS products
       FROM initial_changes JOIN product_master USING (isbn) GROUP BY ALL""",
)
def seasonal_index(f):
    return season.seasonal_index(f.panel, ANCHOR, f.master)


def returns(f):
    daily = P.lowest_vs_anchor(f.panel, ANCHOR).join(f.profiles.select("isbn", "dateacc", "sales_rank"), ["isbn", "dateacc"], "left")
    return P.log_returns(daily, {"price_lowest": "log_diff_lowest", "price_anchor": "log_diff_anchor", "sales_rank": "log_diff_rank"})


@query("isbn dateacc:d log_diff_lowest:f log_diff_anchor:f log_diff_rank:f", "SELECT * FROM returns")
def log_returns(f):
    return returns(f)


def ols_two_sql(source: str, y: str, x1: str, x2: str) -> str:
    det = "(s11 * s22 - s12 * s12)"
    return f"""
      SELECT n, term, estimate FROM (
        SELECT *, (s1y * s22 - s2y * s12) / {det} AS b1, (s2y * s11 - s1y * s12) / {det} AS b2 FROM (
          SELECT count(*) AS n, avg({y}) AS my, avg({x1}) AS m1, avg({x2}) AS m2, var_samp({x1}) AS s11, var_samp({x2}) AS s22,
                 covar_samp({x1}, {x2}) AS s12, covar_samp({x1}, {y}) AS s1y, covar_samp({x2}, {y}) AS s2y
          FROM {source} WHERE {y} IS NOT NULL AND {x1} IS NOT NULL AND {x2} IS NOT NULL)),
      LATERAL (VALUES ('(Intercept)', my - b1 * m1 - b2 * m2), ('{x1}', b1), ('{x2}', b2)) AS t(term, estimate)"""


@query("n:i term estimate:f", ols_two_sql("returns", "log_diff_lowest", "log_diff_anchor", "log_diff_rank"))
def ols_log_returns(f):
    return stats.ols_two(returns(f), "log_diff_lowest", "log_diff_anchor", "log_diff_rank")


GAPS = """
SELECT seller, isbn, ln(days_bet_change) AS y, ln(rank_prev) AS x1, CAST(first_change AS DOUBLE) AS x2
FROM changes WHERE days_bet_change > 0 AND rank_prev > 0
"""
FIT = f"SELECT max(estimate) FILTER (WHERE term = '(Intercept)') AS b0, max(estimate) FILTER (WHERE term = 'x1') AS b1, max(estimate) FILTER (WHERE term = 'x2') AS b2 FROM ({ols_two_sql('gaps', 'y', 'x1', 'x2')})"


def effects_sql(source: str, group: str) -> str:
    return f"""
      SELECT level, n, CASE WHEN n * sb + sw <> 0 THEN n * sb / (n * sb + sw) * m END AS effect FROM (
        SELECT level, n, m, sw, greatest((msb - sw) / nullif(n0, 0), 0) AS sb FROM
          (SELECT {group} AS level, count(*) AS n, avg(r) AS m FROM {source} GROUP BY {group}),
          (SELECT sum((n - 1) * v) / nullif(sum(n) - count(*), 0) AS sw,
                  (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / nullif(count(*) - 1, 0) AS msb,
                  (sum(n) - sum(n * n) / sum(n)) / nullif(count(*) - 1, 0) AS n0
           FROM (SELECT count(*) AS n, avg(r) AS m, coalesce(var_samp(r), 0) AS v FROM {source} GROUP BY {group})))"""


def gap_residuals(f):
    """Residual of the log days between changes on the log previous rank and the first-change flag."""
    rows = clean.change_events(f.panel).select(
        "seller", "isbn",
        S.safe_ln("days_bet_change").alias("y"), S.safe_ln("rank_prev").alias("x1"), F.col("first_change").cast("double").alias("x2"),
    )
    return stage(stats.residuals_two(stage(rows.dropna(), "gaps"), "y", "x1", "x2"), "residuals")


@query(
    "factor level n:i effect:f",
    f"""SELECT * FROM (
          WITH gaps AS ({GAPS}), fit AS ({FIT}),
          residuals AS (SELECT seller, isbn, y - b0 - b1 * x1 - b2 * x2 AS r FROM gaps, fit),
          one AS ({effects_sql("residuals", "seller")}),
          rest AS (SELECT isbn, r - effect AS r FROM residuals JOIN one ON seller = level),
          two AS ({effects_sql("rest", "isbn")})
          SELECT 'seller' AS factor, * FROM one UNION ALL SELECT 'isbn', * FROM two)""",
)
def shrunken_effects(f):
    return stats.shrunken_effects(gap_residuals(f), "residual", "seller", "isbn")
