"""Listing descriptions: phrases, repeats and their shares per seller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricepanel.functions import scalars as S
from pricepanel.functions import text as X
from pricepanel.operators.frequent import COUNTERS
from pricepanel.operators.word_runs import top_runs


def clean_descriptions(descriptions: DataFrame) -> DataFrame:
    """Cleaned comments and normalised origin; descriptions without a seller go."""
    return descriptions.filter(F.col("seller") != "").withColumns(
        {"comments": X.clean_text("comments"), "shipsfrom": X.ship_origin("shipsfrom")}
    )


def gram_counts(descriptions: DataFrame, n: int, top: int | None = None) -> DataFrame:
    """Occurrences of each run of ``n`` words in cleaned comments; the ``top`` most frequent, ties by run, if asked.

    The most frequent runs are found without a shuffle of every distinct run of words; ``descriptions`` is then read twice.
    """
    if top is not None:
        return frequent_grams(descriptions, n, top)
    words = F.filter(F.split(F.col("comments"), " "), lambda w: w != "")
    grams = descriptions.select(words.alias("__w")).select(F.explode(X.word_grams(F.col("__w"), n)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("count")).withColumn("n", F.lit(n))


def frequent_grams(descriptions: DataFrame, n: int, top: int, counters: int = COUNTERS) -> DataFrame:
    """`gram_counts` with ``top``, by summaries of each task and an exact count of what they leave."""
    every = lambda: gram_counts(descriptions, n).select("gram", "count")
    return top_runs(descriptions, "comments", n, top, every, counters).withColumn("n", F.lit(n))


def informative_phrases(*lists: DataFrame) -> DataFrame:
    """All labelled lists together, content phrases only."""
    both = lists[0]
    for other in lists[1:]:
        both = both.unionByName(other)
    return both.filter(F.col("content") == 1).select("gram").distinct()


def phrase_usage(descriptions: DataFrame, phrases: DataFrame) -> DataFrame:
    """The phrases each description holds, their count, and an informative flag.

    The hand-labelled list rides along as one array per query; each text is
    searched as it is scanned, and nothing is shuffled.
    """
    listed = phrases.agg(F.array_sort(F.collect_set("gram"))).scalar()
    # The comment enters as a lambda variable: whatever computes it then runs once per row, not once per phrase.
    search = lambda text: F.filter(F.col("__list"), lambda gram: F.contains(text, gram))
    found = F.transform(F.array("comments"), search)[0]
    return (
        descriptions.withColumn("__list", listed)
        .withColumn("phrases", found)
        .withColumn("phrase_count", F.size("phrases"))
        .withColumn("informative", S.flag(F.col("phrase_count") > 0))
        .drop("__list")
    )


def phrase_matrix(usage: DataFrame, grams: list[str]) -> DataFrame:
    """One 0/1 column per phrase."""
    return usage.select("*", *[S.flag(F.array_contains("phrases", g)).alias(g) for g in grams])


def _comment_key() -> Column:
    return F.sha2("comments", 256)


def with_repeats(descriptions: DataFrame) -> DataFrame:
    """Flag comments a seller has used before, in the order of product and condition.

    The first listing of each (seller, comment) is found by a pre-aggregated
    minimum, so a text copied a million times never gathers in one task.
    """
    keyed = descriptions.withColumns({"__key": _comment_key(), "__at": F.struct("isbn", "used")})
    first = keyed.groupBy("seller", "__key").agg(F.min("__at").alias("__first"))
    return (
        keyed.join(first, ["seller", "__key"])
        .withColumn("repeat_comment", S.flag(F.col("__at") > F.col("__first")))
        .drop("__key", "__at", "__first")
    )


def seller_text_profile(usage: DataFrame) -> DataFrame:
    """Share of repeated and of informative descriptions per seller."""
    return (
        usage.groupBy("seller", _comment_key().alias("__key"))
        .agg(F.count(F.lit(1)).alias("__n"), F.sum("informative").alias("__i"))
        .groupBy("seller")
        .agg(
            F.sum(F.col("__n") - 1).alias("repeat_comment"),
            F.sum("__i").alias("informative"),
            F.sum("__n").alias("listing"),
        )
        .withColumns(
            {
                "pct_generic": S.ratio("repeat_comment", "listing"),
                "pct_informative": S.ratio("informative", "listing"),
            }
        )
    )
