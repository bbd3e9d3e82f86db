"""Lags, neighbours, gaps, displacement and returns."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import day, rows
from pricepanel.operators import cleaning as K
from pricepanel.operators import panel as P


def test_lags_start_null_and_stay_inside_the_pair(make_panel):
    df = make_panel(("a", "x", 0, 5, 3), ("a", "x", 2, 5, 1), ("a", "y", 3, 7, 2), ("b", "x", 1, 9, 4))
    got = rows(P.with_price_lags(P.with_observation_lags(df)), "seller", "isbn", "dateacc")
    assert [(r["rank_prev"], r["days_bet"], r["price2_change"], r["indic_change"]) for r in got] == [
        (None, None, None, None), (3, 2, 0.0, 0), (None, None, None, None), (None, None, None, None)
    ]


@pytest.mark.parametrize("slice_size", [1, 2, 5, 4096])
def test_day_context_is_the_same_for_every_slice_size(random_quotes, slice_size):
    ranked = K.snapshot_rank(random_quotes).drop("price_median").filter("rank % 4 != 2")  # gaps in the ranks
    w = Window.partitionBy("isbn", "dateacc").orderBy("rank")
    g = Window.partitionBy("isbn", "dateacc")
    plain = ranked.withColumns(
        {
            "price_next_lowest": F.lag("price2").over(w),
            "price_next_highest": F.lead("price2").over(w),
            "price_lowest": F.min(F.when(F.col("rank") == 1, F.col("price2"))).over(g),
            "price_anchor": F.min(F.when(F.col("seller") == "s3", F.col("price2"))).over(g),
        }
    )
    got = P.with_day_context(ranked, "s3", slice_size=slice_size).select(*plain.columns)
    key = ("isbn", "dateacc", "seller")
    assert rows(got, *key) == rows(plain, *key)


def test_quote_distances(make_panel):
    df = make_panel(("A", "x", 0, 10, 2), ("b", "x", 0, 8, 1), ("c", "x", 0, 20, 3))
    mid = rows(P.with_quote_distances(P.with_day_context(df, "A")), "rank")[1]
    assert mid["pct_diff_next_lowest"] == pytest.approx(0.2)
    assert mid["pct_diff_next_highest"] == pytest.approx(-1.0)
    assert mid["pct_diff_lowest"] == pytest.approx(0.2) and mid["pct_diff_anchor"] == 0.0


def test_special_prices_keep_days_without_the_anchor(make_panel):
    df = make_panel(("A", "x", 0, 10, 2), ("b", "x", 0, 8, 1), ("b", "x", 1, 7, 1), ("A", "x", 2, 5, 4))
    got = rows(P.special_prices(df, "A"), "dateacc")
    assert [(r["dateacc"], r["price_anchor"], r["price_lowest"]) for r in got] == [(day(0), 10.0, 8.0), (day(1), None, 7.0)]
    both = P.lowest_vs_anchor(df, "A")
    assert rows(both) == [{"isbn": "x", "dateacc": day(0), "price_lowest": 8.0, "price_anchor": 10.0}]


def test_lowest_vs_anchor_equals_the_natural_join(random_quotes):
    ranked = K.snapshot_rank(random_quotes)
    lowest = ranked.filter("rank = 1").select("isbn", "dateacc", F.col("price2").alias("price_lowest"))
    anchor = ranked.filter("seller = 's3'").select("isbn", "dateacc", F.col("price2").alias("price_anchor"))
    joined = P.natural_join(lowest, anchor)
    key = ("isbn", "dateacc")
    assert rows(P.lowest_vs_anchor(ranked, "s3"), *key) == rows(joined, *key)


def test_page_days_follow_the_row_to_the_next_sight(make_panel):
    df = make_panel(("a", "x", 0, 5, 15), ("a", "x", 3, 5, 16), ("a", "x", 4, 5, 1))
    got = rows(P.with_page_days(df), "dateacc")
    assert [(r["days_next"], r["days_first_page"]) for r in got] == [(3, 3), (1, 0), (None, None)]


def test_gap_weights_first_is_one(spark):
    df = spark.createDataFrame([("x", day(3)), ("x", day(7)), ("y", day(9))], "isbn string, dateacc date")
    assert [r["days_bet"] for r in rows(P.with_gap_weights(df), "isbn", "dateacc")] == [1, 4, 1]


def test_displacement_counts_changed_holders(make_panel):
    df = make_panel(
        ("a", "x", 0, 1, 1), ("b", "x", 0, 2, 2), ("b", "x", 1, 1, 1), ("a", "x", 1, 2, 2),
        ("b", "x", 2, 1, 1), ("a", "x", 2, 2, 2), ("c", "x", 2, 3, 16),
    )
    got = rows(P.seller_displacement(df), "dateacc")
    assert [(r["dateacc"], r["num_ranked"], r["displaced"]) for r in got] == [(day(1), 2, 2), (day(2), 2, 0)]


def test_log_returns_drop_the_first_day(spark):
    df = spark.createDataFrame([("x", day(0), 2.0), ("x", day(1), 4.0), ("x", day(5), 0.0)], "isbn string, dateacc date, p double")
    got = rows(P.log_returns(df, {"p": "r"}), "dateacc")
    assert got[0]["r"] == pytest.approx(math.log(2)) and got[1]["r"] is None and len(got) == 2


def test_observation_lags_use_one_shuffle(make_panel):
    from pricepanel.plans.profile import pair_profile

    df = make_panel(("a", "x", 0, 5, 3), ("a", "x", 2, 5, 1))
    plan = pair_profile(P.with_observation_lags(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(seller") == 1
