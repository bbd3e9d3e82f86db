"""Seller profiles, product variability and the weekly panel on a small random panel."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from pricepanel.operators import cleaning as K
from pricepanel.operators import panel as P
from pricepanel.operators import products as R
from pricepanel.operators import seasonal as N
from pricepanel.operators import sellers as L
from pricepanel.plans import clean, profile, season, variability
from pricepanel.session import stage


@pytest.fixture(scope="module")
def panel(spark):
    """120 days, 3 products, 6 sellers and the anchor A, with gaps and repeated prices."""
    rng = random.Random(11)
    data = []
    for b in "xyz":
        for s in ["A", *"bcdefg"]:
            price = rng.choice([10.0, 12.0, 15.0])
            for n in range(0, 120, 3):
                if rng.random() < 0.3:
                    price = rng.choice([9.0, 10.0, 11.0, 12.0, 15.0])
                if rng.random() < 0.8:
                    d = dt.date(2012, 1, 1) + dt.timedelta(days=n)
                    data.append((s, b, d, price, 95.0 if s < "e" else None, 1000.0 if s < "d" else 20.0, int(s in "Ab")))
    quotes = spark.createDataFrame(
        data, "seller string, isbn string, dateacc date, price2 double, rating double, numrating double, fba int"
    )
    ranked = K.patch_anchor(K.snapshot_rank(quotes).drop("price_median"), "A")
    return stage(clean.screen_panel(ranked, "A", "2012-01-01"), "test-panel")


@pytest.fixture(scope="module")
def clusters(spark):
    return spark.createDataFrame([("A", 1), ("b", 2), ("c", 3), ("d", 1)], "seller string, cluster int")


def test_cleaned_panel_has_one_row_per_key(panel):
    assert panel.count() == panel.select("seller", "isbn", "dateacc").distinct().count()
    assert panel.count() == panel.select("rank", "isbn", "dateacc").distinct().count()


def test_pair_counts_in_one_pass_equal_the_full_join(panel):
    one = L.pair_counts(profile.pair_history(panel))
    two = L.merge_pair_counts(clean.change_events(panel), P.with_page_days(panel))
    names = sorted(one.columns)
    assert rows(one.select(*names), "seller", "isbn") == rows(two.select(*names), "seller", "isbn")
    only = L.merge_pair_counts(clean.change_events(panel), P.with_page_days(panel), only_changed=True)
    assert only.filter("num_price_change = 0").count() == 0


def test_days_observed_is_last_less_first_plus_one(panel):
    span = panel.groupBy("seller", "isbn").agg((F.datediff(F.max("dateacc"), F.min("dateacc")) + 1).alias("days_observed"))
    order = ("seller", "isbn")
    assert rows(L.days_observed(panel).select("seller", "isbn", "days_observed"), *order) == rows(span, *order)


def test_seller_profile_equals_its_separate_parts(panel):
    got = {r["seller"]: r for r in rows(profile.seller_profile(panel, "A"))}
    placed = P.with_quote_distances(P.with_day_context(panel, "A"))
    changes = clean.change_events(placed)
    parts = [
        L.seller_change_moments(changes), L.seller_targets(changes), L.num_listings(panel), L.seller_ratings(panel),
        L.mean_synchronization(L.change_synchronization(changes)), L.seller_totals(profile.pair_profile(panel)),
    ]
    for part in parts:
        for r in rows(part):
            for name, value in r.items():
                assert got[r["seller"]][name] == (pytest.approx(value) if isinstance(value, float) else value), name
    for r in got.values():
        assert r["avg_pct_inventory_changed"] == pytest.approx(r["avg_num_same_day_change"] / r["num_listings"])
        assert r["num_price_inc"] + r["num_price_dec"] == r["num_price_change"]


def test_fulfilled_share_and_concentration(panel):
    share = {r["seller"]: (r["pct_fba"], r["fba"]) for r in rows(L.fulfilled_share(panel))}
    assert share["A"] == (1.0, 1) and share["b"] == (1.0, 1) and share["g"] == (0.0, 0)
    totals = L.seller_totals(profile.pair_profile(panel))
    all_of_them = rows(L.change_concentration(totals, 100))[0]
    assert all_of_them["share"] == 1.0
    top = rows(L.top_rows(totals, "num_price_change", 1, "seller"))[0]
    assert rows(L.change_concentration(totals, 1))[0]["top_changes"] == top["num_price_change"]


def test_lifetime_takes_fringe_quotes_only(panel):
    assert {r["seller"] for r in rows(L.quote_lifetime(panel, "2012-04-01"))} == {"d", "e", "f", "g"}


def test_covariates_in_one_pass_equal_the_separate_counts(panel, clusters):
    days = stage(R.day_measures(panel, "A", clusters), "days")
    got = {r["isbn"]: r for r in rows(R.covariates(days))}
    for part in (R.seller_counts(days), R.cluster_counts(days), R.excluded_sellers(panel, clusters)):
        for r in rows(part):
            for name, value in r.items():
                assert got[r["isbn"]][name] == (pytest.approx(value) if isinstance(value, float) else value)


def test_day_measures_equal_the_separate_measures(panel, clusters):
    order = ("isbn", "dateacc")
    days = R.day_measures(panel, "A", clusters)
    robust = R.robust_lowest(panel, "A")
    assert rows(days.select(*robust.columns), *order) == rows(robust, *order)
    lowest = R.lowest_quote(panel).drop("seller_lowest")
    assert rows(days.select(*lowest.columns), *order) == rows(lowest, *order)


def test_fluctuation_has_one_complete_row_per_product(spark, panel, clusters):
    profiles = panel.select("isbn", "dateacc").distinct().withColumns(
        {"reviews": F.lit(4), "book_rating": F.lit(4.5), "sales_rank": F.dayofmonth("dateacc")}
    )
    master = spark.createDataFrame([("x", "S1"), ("y", "S1"), ("z", "S2")], "isbn string, source string")
    lists = spark.createDataFrame([("L2", "x"), ("L1", "x"), ("L1", "x")], "display_name string, isbn string")
    prices = spark.createDataFrame([("x", 20.0, "P"), ("y", None, "P")], "isbn string, list_price double, format string")
    eligible = variability.eligible_panel(panel, profiles, master, ["2012-01-01"])
    got = rows(variability.fluctuation(eligible, "A", profiles, clusters, master, lists, prices), "isbn")
    assert [r["isbn"] for r in got] == ["x", "y", "z"]
    assert [r["display_name"] for r in got] == ["L1", "S1", "S2"]
    assert [(r["list_price"], r["no_list_price"]) for r in got] == [(20.0, 0), (0.0, 1), (0.0, 1)]
    for r in got:
        assert r["coeff_var"] == pytest.approx(r["sd_lowest"] / r["mean_lowest"])
        assert r["price_lowest_min"] <= r["mean_lowest"] <= r["price_lowest_max"]
        assert 0 <= r["avg_displaced"] <= 15


def test_weekly_panel_is_dense_from_first_sight(panel):
    weekly = season.weekly_panel(panel, "A")
    week_max = rows(weekly.agg(F.max("week_elapsed").alias("m")))[0]["m"]
    products = weekly.select("isbn").distinct().count()
    assert weekly.count() == products * week_max
    changes = N.with_initial_change(weekly)
    first = changes.groupBy("isbn").agg(F.min_by("anchor_initial_change", "week_elapsed").alias("c"))
    assert {r["c"] for r in rows(first)} == {0.0}


def test_weeks_fill_forward_over_several_gaps(spark):
    weekly = spark.createDataFrame(
        [("x", 2, 5.0, 4.0), ("x", 6, 7.0, 6.0), ("y", 1, 1.0, 1.0)],
        "isbn string, week_elapsed int, avg_price_anchor double, avg_price_lowest double",
    )
    got = [r["avg_price_anchor"] for r in rows(N.fill_weeks(weekly), "isbn", "week_elapsed")]
    assert got == [None, 5.0, 5.0, 5.0, 5.0, 7.0] + [1.0] * 6
    assert {r["isbn"] for r in rows(N.keep_frequent(N.fill_weeks(weekly), 6))} == {"y"}


def test_binned_variability_rounds_half_to_even(spark):
    df = spark.createDataFrame([(2.5, 1.0, 0.1), (2.0, 3.0, 0.3), (3.5, 5.0, 0.5)], "n double, pct_diff_max_min double, coeff_var double")
    got = rows(R.binned_variability(df, ["n"]), "bin")
    assert [(r["bin"], r["pct_diff_max_min"], r["products"]) for r in got] == [(2.0, 2.0, 2), (4.0, 5.0, 1)]


def test_pair_features_zero_where_nothing_changed(make_panel):
    df = P.with_observation_lags(make_panel(("a", "x", 0, 5, 3), ("a", "x", 4, 5, 1), ("b", "x", 0, 4, 1), ("b", "x", 1, 8, 2)))
    a, b = rows(profile.pair_features(df), "seller")
    assert (a["num_change"], a["avg_pct_change"], a["coeff_var"], a["days_observed"]) == (0, 0.0, 0.0, 5)
    assert (b["num_change"], b["num_increase"], b["avg_tgt_rank"], b["num_unique_price"]) == (1, 1, 2.0, 2)
    assert [r["seller"] for r in rows(profile.pair_variability(make_panel(("a", "x", 0, 5, 1)).withColumn("days_bet", F.lit(1))))] == []
