"""Queries that fit models on MLlib; checked by row count and by invariants in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.functions import text as TX
from pricepanel.operators import changes as C
from pricepanel.operators import models as M
from pricepanel.operators import sellers as L
from pricepanel.operators import stats
from pricepanel.operators import text as X
from pricepanel.plans import classes, clean, profile
from pricepanel.plans import regressions as G
from pricepanel.registry.core import query
from pricepanel.registry.queries_products import gap_residuals
from pricepanel.registry.queries_sellers import complete
from pricepanel.session import stage

TABLE = "term estimate:f std_error:f t_value:f p_value:f"


@query("seller cluster_3:i cluster_4:i")
def kmeans_sellers(f):
    """Sellers in three and in four strategy classes; the staged features serve both."""
    columns = classes.logs_of(classes.SELLER_FEATURES)
    sellers = stage(classes.active_sellers(f.seller_profile).select("seller", *columns), "sellers")
    three = M.cluster_rows(sellers, columns, 3).select("seller", F.col("cluster").alias("cluster_3"))
    four = M.cluster_rows(sellers, columns, 4).select("seller", F.col("cluster").alias("cluster_4"))
    return three.join(four, ["seller"])


@query("seller isbn cluster:i")
def kmeans_pairs(f):
    return classes.pair_classes(profile.pair_features(f.panel), f.clusters)


@query("seller pc1:f pc2:f pc3:f pc4:f pc5:f cluster:i")
def pca_scores(f):
    """Scores of the sellers on five components, and four classes found on the scores."""
    columns = classes.logs_of(classes.SELLER_FEATURES)
    scores = stage(M.pca_scores(complete(f).select("seller", *columns), columns), "scores")
    return M.score_classes(scores, [f"pc{i}" for i in range(1, 6)], 4)


def _variability(f, response, **options):
    return G.variability_model(stage(f.fluctuation, "fluctuation"), response, **options)


@query(TABLE)
def ols_variability(f):
    return _variability(f, "pct_diff_max_min")


@query(TABLE)
def ols_variability_cv(f):
    return _variability(f, "coeff_var")


@query(TABLE)
def ols_minrat(f):
    return _variability(f, "coeff_var_minrat")


@query(TABLE)
def ols_avg3(f):
    return _variability(f, "coeff_var_avg3")


@query(TABLE)
def ols_single_source(f):
    return _variability(f, "coeff_var_avg3", by_list=False, without="SOURCE0")


@query(TABLE)
def ols_pair_cv(f):
    return G.pair_cv_model(profile.pair_variability(f.staged_panel), f.fluctuation, f.seller_profile, f.clusters)


@query(TABLE)
def ols_lifetime(f):
    used = X.phrase_usage(X.clean_descriptions(f.pair_descriptions), stage(f.phrases, "phrases"))
    described = used.withColumn("num_words", TX.word_count("comments"))
    return G.lifetime_model(stage(L.quote_lifetime(f.panel, "2001-06-01"), "lifetimes"), described)


@query(TABLE)
def ols_change_gap(f):
    return G.change_gap_model(stage(clean.change_events(f.panel), "changes"))


@query(TABLE)
def ols_gap_size(f):
    return G.gap_size_model(stage(f.seller_profile, "profile"))


def _indicators(f):
    return stage(G.indicator_sample(C.with_last_changed_rank(f.panel)), "indicators")


@query(TABLE)
def probit_change(f):
    return G.probit_model(_indicators(f))


@query(TABLE)
def lpm_change(f):
    used = X.phrase_usage(X.clean_descriptions(f.pair_descriptions), stage(f.phrases, "phrases"))
    return G.linear_change_model(_indicators(f), stage(X.seller_text_profile(used), "text"))


@query("factor level n:i effect:f")
def crossed_effects(f):
    """Seller and product effects of the mixed model of the gaps between changes, fitted together."""
    return G.change_gap_effects(stage(clean.change_events(f.panel), "changes")).effects


@query("factor level effect:f position:i normal_quantile:f")
def qq_effects(f):
    """Sorted seller effects against normal quantiles, then the product effects."""
    effects = stage(stats.shrunken_effects(gap_residuals(f), "residual", "seller", "isbn"), "effects")
    parts = [M.normal_qq(effects.filter(F.col("factor") == k), "effect", ["level"]) for k in ("seller", "isbn")]
    return parts[0].unionByName(parts[1])
