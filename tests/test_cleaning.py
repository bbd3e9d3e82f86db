"""Typing, deduplication, outliers, ranks and product screens on tiny panels."""

import re
import statistics

import pytest
from pyspark.sql import functions as F

from helpers import day, rows
from pricepanel.functions import scalars as S
from pricepanel import schemas
from pricepanel.operators import cleaning as K
from pricepanel.plans import clean
from pricepanel.plans.medians import StoredMedians
from pricepanel.session import scratch_path

RAW = "dateacc string, isbn string, seller string, rating string, fba int, numrating string, shipping double, price double, condition string"


def raw(spark, *data):
    return spark.createDataFrame(list(data), RAW)


def test_clean_quotes_types_and_fills(spark):
    df = raw(
        spark,
        ("2012-01-05", "01", "a", "95%", 0, "1,234", None, 10.0, "used"),
        ("not a date", "01", "b", "NA", 1, None, 3.99, 10.0, "used"),
        ("2012-01-05", "01", "", "95%", 0, "7", 0.0, 10.0, "used"),
    )
    a, b = rows(K.clean_quotes(df), "seller")
    assert a["dateacc"] == day(4) and a["isbn"] == "01" and a["price2"] == 10.0
    assert a["rating"] == 95.0 and a["numrating"] == 1234.0
    assert b["dateacc"] is None and b["rating"] is None and b["numrating"] == 0.0
    assert b["price2"] == pytest.approx(13.99)
    assert {"shipping", "price", "condition"}.isdisjoint(a)


def test_null_seller_is_dropped_like_a_where_clause(spark):
    df = raw(spark, ("2012-01-05", "01", None, None, 0, None, None, 1.0, None))
    assert K.clean_quotes(df).count() == 0


def test_nothing_to_remove_keeps_every_row(spark):
    df = raw(spark, ("2012-01-05", "01", "a", None, 0, None, None, 1.0, None))
    assert K.clean_quotes(df).count() == 1


def test_anchor_patch_and_capture_defaults(spark):
    df = raw(
        spark,
        ("2012-01-05", "01", "A", "50%", 0, "3", 9.0, 1.0, None),
        ("2012-01-05", "01", "b", "50%", 1, "3", 9.0, 1.0, None),
        ("2012-01-05", "01", "c", "50%", None, "3", None, 1.0, None),
    )
    a, b, c = rows(K.capture_defaults(df, "A"), "seller")
    assert (a["rating"], a["numrating"], a["fba"], a["shipping"]) == (None, None, 1, 0.0)
    assert (b["rating"], b["fba"], b["shipping"]) == ("50%", 1, 0.0)
    assert (c["fba"], c["shipping"]) == (0, None)
    a, b, _ = rows(K.patch_anchor(K.clean_quotes(df), "A"), "seller")
    assert (a["rating"], a["numrating"], a["fba"]) == (100.0, None, 1)
    assert (b["rating"], b["numrating"], b["fba"]) == (50.0, 3.0, 1)


def test_dedup_keeps_the_first_row_of_the_frame_and_one_per_key(spark):
    df = spark.createDataFrame(
        [("a", "x", day(0), 5.0, 2), ("a", "x", day(0), 5.0, 1), ("a", "x", day(1), 9.0, 1), ("a", "y", day(1), 9.0, 1)],
        "seller string, isbn string, dateacc date, price2 double, tie int",
    )
    kept = rows(K.dedup_seller_day(df, ["price2", "tie"]), "isbn", "dateacc")
    assert [(r["isbn"], r["dateacc"], r["tie"]) for r in kept] == [("x", day(0), 1), ("x", day(1), 1), ("y", day(1), 1)]


def test_rank_dedup_does_not_cross_products(make_panel):
    df = make_panel(("a", "x", 0, 5, 1), ("b", "x", 0, 4, 1), ("c", "y", 0, 6, 1))
    kept = rows(K.dedup_rank_day(df, ["price2"]), "isbn")
    assert [(r["isbn"], r["seller"]) for r in kept] == [("x", "b"), ("y", "c")]


def test_a_missing_price_never_beats_a_price(spark):
    schema = "seller string, isbn string, dateacc date, price2 double, tie int"
    df = spark.createDataFrame([("a", "x", day(0), None, 1), ("a", "x", day(0), 9.0, 2), ("b", "x", day(0), None, 1)], schema)
    kept = rows(K.dedup_seller_day(df, ["price2", "tie"]), "seller")
    assert [(r["seller"], r["price2"], r["tie"]) for r in kept] == [("a", 9.0, 2), ("b", None, 1)]


def test_quotes_without_a_captured_rank_all_stay(make_panel):
    df = make_panel(("a", "x", 0, 5, 1), ("b", "x", 0, 4, 1), ("c", "x", 0, 6, 2), ("d", "x", 0, 7, 3))
    df = df.withColumn("rank", F.when(F.col("seller") < "c", F.col("rank")))
    assert [r["seller"] for r in rows(K.dedup_rank_day(df, ["price2"]), "seller")] == ["b", "c", "d"]


def test_clean_panel_takes_the_raw_layout(spark):
    quote = lambda seller, price, rank, n: ("2012-01-0%d" % n, "01", seller, "90%", 0, "5", 0.0, price, "used", rank)
    data = [quote("A", 10.0, 1, 1), quote("b", 11.0, 1, 1), quote("c", 9.0, 2, 1), quote("c", None, 3, 1), quote("A", 10.0, 1, 2)]
    df = spark.createDataFrame(data, schemas.LISTINGS)
    prices = spark.createDataFrame([("01", 20.0)], "isbn string, list_price double")
    panel = lambda **mode: clean.clean_panel(df, prices, "A", "2011-08-30", ["price2"], **mode)
    counted, captured = panel(), panel(captured_rank=True)
    for got in (counted, captured):
        assert len(got.columns) == len(set(got.columns))
    place = lambda got: [(str(r["dateacc"]), r["seller"], r["price2"], r["rank"]) for r in rows(got, "dateacc", "seller")]
    assert place(counted) == [("2012-01-01", "A", 10.0, 2), ("2012-01-01", "b", 11.0, 3), ("2012-01-01", "c", 9.0, 1), ("2012-01-02", "A", 10.0, 1)]
    assert place(captured) == [("2012-01-01", "A", 10.0, 1), ("2012-01-01", "c", 9.0, 2), ("2012-01-02", "A", 10.0, 1)]


def test_first_by_holds_under_many_copies_of_one_key(spark):
    df = spark.range(20000, numPartitions=8).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 20000).alias("v"))
    assert rows(K.first_by(df, ["k"], ["v"])) == [{"k": "k", "v": 0}]
    assert "SinglePartition" not in K.first_by(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()


def brute_ranks(quotes):
    groups = {}
    for r in quotes:
        groups.setdefault((r["isbn"], r["dateacc"]), []).append((r["price2"], r["seller"]))
    return {(k, s): i for k, g in groups.items() for i, (_, s) in enumerate(sorted(g), 1)}


def test_snapshot_rank_matches_brute_force(random_quotes):
    want = brute_ranks(rows(random_quotes))
    got = {((r["isbn"], r["dateacc"]), r["seller"]): r["rank"] for r in rows(K.snapshot_rank(random_quotes))}
    assert got == want


def test_ladder_median_matches_brute_force(random_quotes):
    groups = {}
    for r in rows(random_quotes):
        groups.setdefault((r["isbn"], r["dateacc"]), []).append(r["price2"])
    got = {(r["isbn"], r["dateacc"]): r["price_median"] for r in rows(K.median_prices(random_quotes))}
    assert got == {k: statistics.median(v) for k, v in groups.items()}


def test_outlier_cuts_commute_with_the_rank(random_quotes):
    cut = random_quotes.join(K.median_prices(random_quotes), ["isbn", "dateacc"]).filter(K.below_median_cut()).drop("price_median")
    after = {(r["isbn"], r["dateacc"], r["seller"]): r["rank"] for r in rows(K.snapshot_rank(cut))}
    before = rows(K.snapshot_rank(random_quotes).filter(K.below_median_cut()))
    assert {(r["isbn"], r["dateacc"], r["seller"]): r["rank"] for r in before} == after


def test_list_price_cut_keeps_unknown_list_prices(spark, make_panel):
    prices = spark.createDataFrame([("x", 10.0), ("y", None)], "isbn string, list_price double")
    df = make_panel(("a", "x", 0, 18.98, 1), ("b", "x", 0, 19.5, 2), ("c", "y", 0, 999, 1), ("d", "z", 0, 999, 1))
    assert [r["seller"] for r in rows(K.drop_above_list(df, prices), "seller")] == ["a", "c", "d"]


def test_product_screens_agree_with_the_one_pass_form(make_panel):
    df = make_panel(
        ("A", "x", 0, 3, 1), ("A", "x", 1, 9, 1),  # under the floor on half its days: goes
        ("A", "y", 0, 9, 1), ("b", "y", 1, 3, 1), ("b", "y", 2, 9, 1),
        ("b", "z", 0, 9, 1),  # never quoted by the anchor
    )
    floor = {r["isbn"] for r in rows(K.floor_price_products(df, 4.24))}
    anchor = {r["isbn"] for r in rows(K.anchor_products(df, "A"))}
    assert floor == {"y", "z"} and anchor == {"x", "y"}
    assert {r["isbn"] for r in rows(K.screened_products(df, "A", 4.24))} == floor & anchor


def test_semi_and_anti_joins_split_the_panel(spark, make_panel):
    df = make_panel(("a", "x", 0, 1, 1), ("a", "y", 0, 1, 1))
    some = spark.createDataFrame([("x",), ("x",)], "isbn string")
    assert [r["isbn"] for r in rows(K.keep_products(df, some))] == ["x"]
    assert [r["isbn"] for r in rows(K.drop_products(df, some))] == ["y"]


def test_unranked_products_on_check_days(spark):
    df = spark.createDataFrame([("x", day(0), None), ("y", day(0), 3), ("z", day(1), None)], "isbn string, dateacc date, sales_rank int")
    assert [r["isbn"] for r in rows(K.unranked_products(df, ["2012-01-01"]))] == ["x"]


def test_scalar_guards(spark):
    df = spark.createDataFrame([(0.0, 2.5, "1,234"), (4.0, 3.5, "NA")], "x double, h double, t string")
    one, two = df.select(
        S.safe_ln("x").alias("ln"), S.ratio(F.lit(1.0), "x").alias("r"), S.half_even("h").alias("e"), S.thousands("t").alias("t")
    ).collect()
    assert one["ln"] is None and one["r"] is None and one["e"] == 2.0 and one["t"] == 1234.0
    assert two["r"] == 0.25 and two["e"] == 4.0 and two["t"] is None


def test_week_elapsed_starts_in_week_one(spark):
    df = spark.createDataFrame([(day(n),) for n in (0, 4, 5, 12)], "d date")
    got = [r[0] for r in df.select(S.week_elapsed("d", F.lit(day(0)))).collect()]
    assert got == [1, 1, 2, 3]


def test_medians_of_counts_follow_late_and_repeated_batches(spark, random_quotes):
    quotes = random_quotes.unionByName(random_quotes.filter("price2 < 9"))  # repeats count
    stored = StoredMedians.of(quotes, scratch_path(spark, "medians"))
    want = lambda df: rows(K.median_prices(df), "isbn", "dateacc")
    early, late = quotes.filter(F.col("dateacc") < day(3)), quotes.filter((F.col("dateacc") >= day(3)) & (F.col("seller") != "s3"))
    stored.add(early.filter("seller <> 's3'"), "one")
    stored.add(late, "two")
    assert rows(stored.medians([day(3), day(4)]), "isbn", "dateacc") == want(late)
    plan = stored.counts([day(3)])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*dateacc#\d+ = 2012-01-04", plan)  # other days' folders are left out
    for _ in range(2):  # a batch that is tried again counts once
        stored.add(quotes.filter("seller = 's3'"), "three")
    assert rows(stored.medians(), "isbn", "dateacc") == want(quotes)


def test_the_median_is_taken_before_repeats_and_nameless_sellers_go(spark):
    """Three quotes without a seller name and two repeats hold the median down; the dear quote goes though few sellers are cheap."""
    raw = spark.createDataFrame(
        [("2012-01-01", "b", s, "90%", 0, "5", 0.0, p, "new", n) for n, (s, p) in enumerate([("", 10.0)] * 3 + [("a", 10.0)] * 3 + [("c", 40.0), ("d", 41.0)])],
        "dateacc string, isbn string, seller string, rating string, fba int, numrating string, shipping double, price double, condition string, id int",
    )
    lists = spark.createDataFrame([("b", None)], "isbn string, list_price double")
    assert [(r["seller"], r["rank"]) for r in rows(clean.ranked_quotes(raw, lists, ["price2", "id"]), "rank")] == [("a", 1)]
    kept = K.drop_above_median(K.dedup_seller_day(K.clean_quotes(raw), ["price2", "id"]))
    assert sorted(r["seller"] for r in rows(kept)) == ["a", "c", "d"]
