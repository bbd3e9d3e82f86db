"""Frequent values by summaries, search for long phrase lists, and stored sketches, against plain counts."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import day, rows
from pricepanel.operators import frequent
from pricepanel.operators import phrase_search as S
from pricepanel.operators import text as T
from pricepanel.operators import word_runs
from pricepanel.plans.listings import StoredListings
from pricepanel.session import scratch_path


def top_of(values, top):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda r: (-r[1], r[0]))[:top]


def bag(spark, values, parts=5):
    return spark.createDataFrame([(v,) for v in values], "v string").repartition(parts)


def answer(df):
    return [(r["v"], r["count"]) for r in df.collect()]


def zipf(n, seed=3):
    rng = random.Random(seed)
    return [f"w{int(rng.paretovariate(0.7))}" for _ in range(n)] + [None] * 40


def test_a_cut_count_is_short_by_no_more_than_what_was_taken_off():
    rng = np.random.default_rng(1)
    true = Counter()
    hashes, counts, off = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for _ in range(20):
        new = rng.zipf(1.3, 500).astype(np.int64)
        true.update(new.tolist())
        hashes, counts, lost = frequent.cut(np.concatenate([hashes, new]), np.concatenate([counts, np.ones(500, np.int64)]), 50)
        off += lost
        assert len(hashes) <= 50
    held = dict(zip(hashes.tolist(), counts.tolist(), strict=True))
    assert off > 0 and all(held.get(v, 0) <= n <= held.get(v, 0) + off for v, n in true.items())
    assert off <= sum(true.values()) / 51


@pytest.mark.parametrize("counters", [64, 1 << 16])
def test_the_top_is_exact_with_few_counters_and_with_many(spark, counters, monkeypatch):
    monkeypatch.setattr(frequent, "PENDING", 500)
    values = zipf(6000)
    assert answer(frequent.most_frequent(bag(spark, values), "v", 5, counters)) == top_of(values, 5)


def test_a_flat_bag_is_counted_in_full_where_no_bound_holds(spark, monkeypatch):
    monkeypatch.setattr(frequent, "PENDING", 100)
    monkeypatch.setattr(frequent, "MOST", 64)
    values = [f"v{n % 700:03d}" for n in range(2100)]
    assert answer(frequent.most_frequent(bag(spark, values), "v", 10, 16)) == top_of(values, 10)


def test_equal_hashes_of_different_values_lose_nothing(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(12)))
    values = zipf(2000)
    assert answer(frequent.most_frequent(bag(spark, values), "v", 6)) == top_of(values, 6)


def test_few_empty_and_null_values(spark):
    assert answer(frequent.most_frequent(bag(spark, ["a", "b", "a", None, ""]), "v", 9)) == [("a", 2), ("", 1), ("b", 1)]
    assert answer(frequent.most_frequent(bag(spark, []), "v", 9)) == []
    assert answer(frequent.most_frequent(bag(spark, [None]), "v", 9)) == []


def test_frequent_grams_are_the_top_of_all_gram_counts(spark):
    rng = random.Random(9)
    texts = [(" ".join(f"w{int(rng.paretovariate(1.0))}" for _ in range(rng.randint(0, 60))),) for _ in range(200)]
    df = spark.createDataFrame([*texts, (None,), ("",)], "comments string").repartition(4)
    for n in (2, 3):
        got = T.frequent_grams(df, n, 30, counters=256)
        assert got.columns == T.gram_counts(df, n).columns
        assert rows(got) == rows(T.gram_counts(df, n, 30))


def test_runs_of_words_stay_whole_in_small_batches_and_pieces_and_stop_with_a_text(spark, monkeypatch):
    monkeypatch.setattr(word_runs, "PIECE", 8)
    words = [f"w{k * k % 7}" for k in range(300)]
    df = spark.createDataFrame([(" ".join(words),), ("w1",), ("w2 w3",), ("  w1  w2 ",), (None,)], "comments string").coalesce(1)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "2")
        for n in (1, 2, 4):
            assert rows(T.frequent_grams(df, n, 50), "gram") == rows(T.gram_counts(df, n, 50), "gram")
    finally:
        spark.conf.set(size, before)


def test_more_survivors_than_are_sent_are_all_counted(spark, monkeypatch):
    monkeypatch.setattr(word_runs, "SENT", 1)
    df = spark.createDataFrame([("a b a b c",), ("b c",)], "comments string")
    assert rows(T.frequent_grams(df, 2, 3)) == rows(T.gram_counts(df, 2, 3))


def usage(df):
    return [(r["isbn"], r["phrases"], r["phrase_count"], r["informative"]) for r in rows(df, "isbn")]


PHRASES = ["like new", "new", "new copy", "ke ne", "", "été", "like new copy of it", "absent", "new", None]
TEXTS = ["like new copy", "new new", "", None, "l'été like newer", "x" * 50_000 + " like new " + "y" * 50_000, "like new copy of it"]


@pytest.mark.parametrize("block_chars", [S.BLOCK_CHARS, 12])
def test_search_gives_the_rows_of_phrase_usage(spark, block_chars):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "isbn long, comments string")
    listed = spark.createDataFrame([(p,) for p in PHRASES], "gram string")
    found = S.search_phrases(df, listed, block_chars)
    assert found.columns == T.phrase_usage(df, listed).columns
    assert usage(found) == usage(T.phrase_usage(df, listed))


def test_search_without_phrases_or_texts(spark):
    df = spark.createDataFrame([(1, "a")], "isbn long, comments string")
    none = spark.createDataFrame([], "gram string")
    assert usage(S.search_phrases(df, none)) == [(1, [], 0, 0)]
    assert usage(S.search_phrases(df, none.unionAll(spark.createDataFrame([("",)], "gram string")))) == [(1, [""], 1, 1)]
    assert usage(S.search_phrases(df.limit(0), spark.createDataFrame([("a",)], "gram string"))) == []


def test_ten_thousand_phrases_cost_less_than_twice_a_hundred():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(400)) for _ in range(300)]
    listed = [f"{word()} {word()}" for _ in range(10_000)]

    def seconds(phrases):
        built = S.automaton(phrases)
        spent = []
        for _ in range(5):
            start = time.process_time()
            for text in texts:
                S._held(built, [], text)
            spent.append(time.process_time() - start)
        return min(spent)

    assert seconds(listed) < 2 * seconds(listed[:100]) + 0.01


def test_sketches_of_days_merge_to_the_distinct_products_within_their_error(spark):
    def quotes(seller, products, n):
        return [(seller, f"b{k}", day(n)) for k in products]

    first = quotes("big", range(12_000), 0) + quotes("small", range(5), 0) + [("small", None, day(0)), (None, "b1", day(0))]
    second = quotes("big", range(6_000, 30_000), 40) + quotes("small", range(3, 9), 40)
    schema = "seller string, isbn string, dateacc date"
    one, two = (spark.createDataFrame(part, schema) for part in (first, second))
    store = StoredListings.of(one, scratch_path(spark, "listings"))
    store.add(one, "a")
    store.add(two, "b/1")
    store.add(two, "b/1")
    store.add(one.filter("seller = 'small'"), "late")
    got = {r["seller"]: r["num_listings"] for r in rows(store.num_listings())}
    assert (got["small"], got[None]) == (9, 1)
    assert abs(got["big"] - 30_000) <= 4 * store.standard_error * 30_000
    months = {(r["seller"], r["month"]): r["num_listings"] for r in rows(store.num_listings({"month": F.month("dateacc")}))}
    assert (months["small", 1], months["small", 2]) == (5, 6)
    assert abs(months["big", 2] - 24_000) <= 4 * store.standard_error * 24_000
    assert {r["seller"]: r["num_listings"] for r in rows(store.num_listings(until=day(3)))}["small"] == 5
    scan = store.num_listings(since=day(10))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "dateacc" in scan.split("PartitionFilters")[1].split("]")[0]
