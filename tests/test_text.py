"""Description cleaning, phrases and repeats."""

from helpers import rows
from pricepanel.functions import text as X
from pricepanel.operators import text as T


def descriptions(spark, *data):
    return spark.createDataFrame(list(data), "seller string, isbn long, used int, comments string, shipsfrom string")


def test_clean_text(spark):
    cases = {
        "Very GOOD, copy!": "very good copy ",
        "a 12 34 b 5": "a b 5",
        "a\t7\n8 z": "a z",
        "up &#171;Show less more text&#187;Read more end": "up end",
        "Été 1st": "été 1st",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select(X.clean_text("t").alias("c"))
    assert [r["c"] for r in df.collect()] == list(cases.values())


def test_word_count_of_a_single_word_is_two(spark):
    df = spark.createDataFrame([("one",), ("one two",), ("one two three",)], "t string").select(X.word_count("t").alias("n"))
    assert [r["n"] for r in df.collect()] == [2, 2, 3]


def test_ship_origin(spark):
    df = spark.createDataFrame([("NY, United States",), ("United States",), ("London, United Kingdom",), (None,)], "t string")
    assert [r["o"] for r in df.select(X.ship_origin("t").alias("o")).collect()] == ["NY", None, "London, UK", None]


def test_grams_and_phrases(spark):
    df = T.clean_descriptions(
        descriptions(spark, ("s", 1, 0, "like new copy", "x"), ("s", 2, 0, "like new", None), ("s", 3, 0, "one", None), ("", 4, 0, "like new", None))
    )
    assert rows(T.gram_counts(df, 2, 1)) == [{"gram": "like new", "count": 2, "n": 2}]
    two = spark.createDataFrame([("like new", 1), ("new copy", 0)], "gram string, content int")
    three = spark.createDataFrame([("ke new c", 1)], "gram string, content int")
    used = T.phrase_usage(df, T.informative_phrases(two, three))
    got = rows(T.phrase_matrix(used, ["like new", "ke new c"]), "isbn")
    assert [(r["phrase_count"], r["informative"], r["like new"], r["ke new c"]) for r in got] == [(2, 1, 1, 1), (1, 1, 1, 0), (0, 0, 0, 0)]


def test_repeats_stay_inside_a_seller_and_skip_the_first(spark):
    df = descriptions(
        spark, ("s", 1, 0, "same", None), ("s", 1, 1, "same", None), ("s", 2, 0, "same", None), ("t", 3, 0, "same", None), ("t", 4, 0, "own", None)
    )
    got = [(r["seller"], r["isbn"], r["used"], r["repeat_comment"]) for r in rows(T.with_repeats(df), "seller", "isbn", "used")]
    assert got == [("s", 1, 0, 0), ("s", 1, 1, 1), ("s", 2, 0, 1), ("t", 3, 0, 0), ("t", 4, 0, 0)]


def test_seller_shares_agree_with_the_row_flags(spark):
    df = descriptions(spark, *[("s" if n % 3 else "t", n, 0, f"copy {n % 4}", None) for n in range(40)])
    phrases = spark.createDataFrame([("copy 1", 1)], "gram string, content int")
    used = T.phrase_usage(df, phrases)
    got = {r["seller"]: r for r in rows(T.seller_text_profile(used))}
    flags = {}
    for r in rows(T.with_repeats(used)):
        n, i = flags.get(r["seller"], (0, 0))
        flags[r["seller"]] = (n + r["repeat_comment"], i + r["informative"])
    assert {k: (v["repeat_comment"], v["informative"]) for k, v in got.items()} == flags


def test_top_runs_are_counted_without_listing_every_run(spark, monkeypatch):
    """The most frequent runs of a gram list come from summaries; all runs are exploded only where all are asked for."""
    df = spark.createDataFrame([("a b a b c",), ("b c",), ("",), (None,), ("x",)], "comments string")
    every = T.gram_counts(df, 2)
    want = sorted(rows(every), key=lambda r: (-r["count"], r["gram"]))
    monkeypatch.setattr(T.X, "word_grams", None)
    assert sorted(rows(T.gram_counts(df, 2, 2)), key=lambda r: (-r["count"], r["gram"])) == want[:2]
    assert T.gram_counts(df, 2, 2).columns == every.columns
