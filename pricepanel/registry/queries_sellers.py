"""Queries that collapse the panel to sellers, and statistics over sellers."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from pricepanel.operators import panel as P
from pricepanel.operators import sellers as L
from pricepanel.operators import stats
from pricepanel.plans import clean, profile
from pricepanel.plans.classes import OTHER_SELLER_LOGS, SELLER_FEATURES, logs_of
from pricepanel.plans.listings import StoredListings
from pricepanel.registry.core import query
from pricepanel.registry.fixture import ANCHOR
from pricepanel.registry.sql_blocks import CLASSIFY
from pricepanel.session import scratch_path, stage

TOTALS = (
    "seller num_price_inc:i num_price_dec:i num_price_change:i listings_no_change:i avg_days_observed:f avg_days_first_page:f "
    "avg_pct_first_page:f avg_changes_per_day:f avg_inc_per_day:f avg_dec_per_day:f prop_changes_inc:f"
)
MOMENTS = (
    "seller avg_days_bet_change:f sd_days_bet_change:f avg_ranks_bumped:f sd_ranks_bumped:f avg_abs_ranks_bumped:f "
    "sd_abs_ranks_bumped:f avg_pct_inc:f avg_pct_dec:f avg_pct_change:f avg_price_change:f"
)
TARGETS = (
    "seller avg_tgt_rank:f sd_tgt_rank:f avg_tgt_pct_diff_next_lowest:f avg_tgt_pct_diff_next_highest:f "
    "avg_tgt_pct_diff_lowest:f avg_tgt_pct_diff_anchor:f"
)
PROFILE = (
    f"{TOTALS} {MOMENTS.removeprefix('seller ')} {TARGETS.removeprefix('seller ')} num_listings:i avg_rating:f avg_num_rating:f "
    "avg_num_same_day_change:f avg_pct_inventory_changed:f pct_listings_no_change:f"
)
HISTOGRAM_COLUMNS = [
    "avg_days_observed", "avg_pct_first_page", "avg_changes_per_day", "prop_changes_inc", "avg_days_bet_change",
    "avg_ranks_bumped", "avg_abs_ranks_bumped", "avg_pct_inc", "avg_pct_dec", "avg_pct_change", "avg_tgt_rank",
    "avg_tgt_pct_diff_lowest", "avg_pct_inventory_changed",
]
PROFILE_COLUMNS = ["avg_tgt_rank", "avg_days_bet_change", "avg_abs_ranks_bumped", "avg_pct_change", "avg_pct_inventory_changed"]


def active(f):
    """Sellers with any price change, with the logs of their features and their given cluster."""
    sellers = f.seller_profile.filter(F.col("num_price_change") > 0).join(f.clusters, ["seller"], "left")
    return stats.log_features(sellers, {**SELLER_FEATURES, **OTHER_SELLER_LOGS})


def complete(f):
    return stage(stats.complete_rows(active(f), logs_of(SELLER_FEATURES)), "sellers")


@query(TOTALS, "SELECT * FROM totals")
def seller_totals(f):
    return L.seller_totals(profile.pair_profile(f.panel))


@query(MOMENTS, "SELECT * FROM moments")
def seller_change_moments(f):
    return L.seller_change_moments(clean.change_events(f.panel))


@query(TARGETS, "SELECT * FROM targets")
def seller_targets(f):
    placed = P.with_quote_distances(P.with_day_context(f.staged_panel, ANCHOR))
    return L.seller_targets(clean.change_events(placed))


@query("seller num_listings:i", "SELECT * FROM listing_counts")
def num_listings(f):
    return L.num_listings(f.panel)


@query(
    "seller year:i num_listings:i",
    "SELECT seller, year(dateacc) AS year, count(DISTINCT isbn) AS num_listings FROM panel GROUP BY ALL",
)
def listings_by_year(f):
    """Distinct products per seller and year from stored sketches that two batches add, the second one twice.

    Sketches of fewer than some hundred products are exact, so the counts are too on these tables.
    """
    stored = StoredListings.of(f.staged_panel, scratch_path(f.spark, "listings"))
    for part in (0, 1, 1):
        stored.add(f.staged_panel.filter(F.pmod(F.xxhash64("isbn"), F.lit(2)) == part), f"batch{part}")
    return stored.num_listings({"year": F.year("dateacc")})


@query("dateacc:d seller num_same_day_change:i avg_num_same_day_change:f", "SELECT * FROM synch JOIN mean_synch USING (seller)")
def change_synchronization(f):
    synch = stage(L.change_synchronization(clean.change_events(f.panel)), "synch")
    return synch.join(L.mean_synchronization(synch), ["seller"])


@query("seller avg_rating:f avg_num_rating:f", "SELECT * FROM ratings")
def seller_ratings(f):
    return L.seller_ratings(f.panel)


@query(PROFILE, "SELECT * FROM profile")
def seller_profile(f):
    return f.seller_profile


@query(
    "seller isbn first_day:d last_day:d num_unique_prices:i mean_rank:f still:i age:i",
    """SELECT *, CASE WHEN last_day >= DATE '2001-06-01' THEN 1 ELSE 0 END AS still,
              date_diff('day', first_day, last_day) + 1 AS age
       FROM (SELECT seller, isbn, min(dateacc) AS first_day, max(dateacc) AS last_day,
                    count(DISTINCT price2) AS num_unique_prices, avg(rank) AS mean_rank
             FROM panel WHERE numrating < 415 GROUP BY ALL)""",
)
def quote_lifetime(f):
    return L.quote_lifetime(f.panel, "2001-06-01")


@query(
    "seller pct_fba:f fba:i",
    """SELECT seller, avg(ever) AS pct_fba, CASE WHEN avg(ever) > 0.1 THEN 1 ELSE 0 END AS fba
       FROM (SELECT seller, isbn, max(fba) AS ever FROM panel GROUP BY ALL) GROUP BY seller""",
)
def fulfilled_share(f):
    return L.fulfilled_share(f.panel)


@query(
    "changes:i top_changes:i share:f",
    """SELECT *, top_changes / nullif(changes, 0) AS share FROM (SELECT (SELECT sum(num_price_change) FROM totals) AS changes,
       (SELECT sum(num_price_change) FROM (SELECT * FROM totals ORDER BY num_price_change DESC, seller LIMIT 20)) AS top_changes)""",
)
def change_concentration(f):
    return L.change_concentration(stage(L.seller_totals(profile.pair_profile(f.panel)), "totals"), 20)


@query(
    "share_above:f rated:i top_share_above:f",
    """SELECT avg(CASE WHEN avg_rating > 95 THEN 1 WHEN avg_rating IS NOT NULL THEN 0 END) AS share_above, count(avg_rating) AS rated,
         (SELECT avg(CASE WHEN avg_rating > 95 THEN 1 WHEN avg_rating IS NOT NULL THEN 0 END) FROM
           (SELECT * FROM ratings ORDER BY avg_num_rating DESC NULLS LAST, seller LIMIT 30)) AS top_share_above
       FROM ratings""",
)
def rating_shares(f):
    return L.rating_shares(stage(L.seller_ratings(f.panel), "ratings"), above=95.0, top=30)


@query("seller num_listings:i num_price_change:i", "SELECT * FROM profile ORDER BY num_price_change DESC, seller LIMIT 100")
def top_sellers(f):
    return L.top_rows(f.seller_profile, "num_price_change", 100, "seller")


@query(
    "seller " + " ".join(f"{c}:f" for c in logs_of({**SELLER_FEATURES, **OTHER_SELLER_LOGS})),
    "SELECT * FROM sellers_active",
)
def log_features(f):
    return active(f)


@query("seller " + " ".join(f"{c}:f" for c in CLASSIFY), "SELECT * FROM standardized")
def standardize(f):
    return stats.standardize(complete(f), logs_of(SELLER_FEATURES))


@query(
    "a b corr:f",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM sellers_complete"
        for a, b in combinations_with_replacement(CLASSIFY, 2)
    ),
)
def correlation_matrix(f):
    return stats.correlation_matrix(complete(f), logs_of(SELLER_FEATURES))


@query(
    "column_name bin:i count:i",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, least(coalesce(floor(({c} - lo) / nullif((hi - lo) / 20.0, 0)), 0), 19) AS bin, count(*) AS count
            FROM profile, (SELECT min({c}) AS lo, max({c}) AS hi FROM profile) WHERE {c} IS NOT NULL GROUP BY ALL"""
        for c in HISTOGRAM_COLUMNS
    ),
)
def histogram(f):
    profile_rows = stage(f.seller_profile.select(*HISTOGRAM_COLUMNS), "profile")
    return stats.histogram(profile_rows, HISTOGRAM_COLUMNS, 20).withColumnRenamed("column", "column_name")


@query(
    "column_name prob:f quantile:f",
    """SELECT 'avg_num_rating' AS column_name, 0.9 AS prob, quantile_cont(avg_num_rating, 0.9) AS quantile FROM profile
       UNION ALL SELECT 'num_price_change', 0.99, quantile_cont(num_price_change, 0.99) FROM profile""",
)
def quantile_thresholds(f):
    found = stats.quantile_thresholds(f.seller_profile, {"avg_num_rating": 0.9, "num_price_change": 0.99})
    return found.withColumnRenamed("column", "column_name")


@query(
    "cluster:i size:i feature mean:f sd:f",
    " UNION ALL ".join(
        f"""SELECT cluster, count(*) AS size, '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS sd
            FROM sellers_active WHERE cluster IS NOT NULL GROUP BY cluster"""
        for c in PROFILE_COLUMNS
    ),
)
def cluster_profile(f):
    return stats.group_profile(active(f).filter(F.col("cluster").isNotNull()), "cluster", PROFILE_COLUMNS)


@query(
    "seller cluster:i",
    """SELECT seller, label AS cluster FROM sellers_active JOIN (
         SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, cluster) AS label
         FROM sellers_active WHERE cluster IS NOT NULL GROUP BY cluster) USING (cluster)""",
)
def cluster_relabel(f):
    labelled = stage(active(f).filter(F.col("cluster").isNotNull()).select("seller", "cluster"), "labelled")
    return stats.relabel_by_size(labelled, "cluster")


@query(
    "seller cluster:i distance:f",
    f"""SELECT seller, arg_min(k, d) AS cluster, sqrt(min(d)) AS distance FROM (
          SELECT s.seller, c.k, {" + ".join(f"pow(s.{x} - c.{x}, 2)" for x in CLASSIFY)} AS d
          FROM standardized s, (SELECT cluster AS k, {", ".join(f"avg({x}) AS {x}" for x in CLASSIFY)}
                                FROM standardized WHERE cluster IS NOT NULL GROUP BY cluster) c)
        GROUP BY seller""",
)
def kmeans_assign(f):
    """Nearest of fixed centres, here the means of the given clusters."""
    columns = logs_of(SELLER_FEATURES)
    points = stage(stats.standardize(complete(f), columns).select("seller", "cluster", *columns), "points")
    centres = points.filter(F.col("cluster").isNotNull()).groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns])
    return stats.nearest_centre(points.drop("cluster"), columns, centres, "cluster")
