"""Search of texts for long phrase lists: one pass over each text, whatever the number of phrases."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricepanel.functions import scalars as S
from pricepanel.session import stage

#: Characters of phrases in one automaton; a node takes some 30 bytes, so a task holds some 250 MB at most.
BLOCK_CHARS = 8_000_000


def automaton(phrases: list[str]):
    """The Aho-Corasick automaton of non-empty phrases; a match gives the phrase."""
    built = ahocorasick.Automaton()
    for phrase in phrases:
        built.add_word(phrase, phrase)
    built.make_automaton()
    return built


def phrase_blocks(phrases: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The distinct phrases with the ``block`` each falls in by its hash: one block for a list within ``block_chars``."""
    distinct = phrases.select("gram").filter(F.col("gram").isNotNull()).distinct()
    total = distinct.agg(F.coalesce(F.sum(F.length("gram")), F.lit(0))).first()[0]
    return stage(distinct.withColumn("block", F.pmod(F.xxhash64("gram"), F.lit(-(-total // block_chars) or 1))), "phrases")


def search_phrases(descriptions: DataFrame, phrases: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`text.phrase_usage` for long lists: the same columns and rows, in time that follows the texts and their matches.

    A block of phrases is sent to the tasks as it is, at most about ``block_chars`` characters; a task builds its
    automaton once. A longer list takes one pass for each block, written in between. A null comment holds no
    phrase, an empty phrase is in every other comment, and phrases may overlap or hold one another.
    """
    blocks = phrase_blocks(phrases, block_chars)
    numbers = sorted(r[0] for r in blocks.select("block").distinct().collect())  # one number for each 8 MB of list
    found = descriptions.withColumn("phrases", F.array().cast(T.ArrayType(T.StringType())))
    for done, number in enumerate(numbers):
        if done:
            found = stage(found, "phrase-pass")
        listed = [r["gram"] for r in blocks.filter(F.col("block") == number).select("gram").collect()]
        search = _search(listed)
        found = found.withColumn("phrases", F.concat("phrases", search(F.col("comments"))))
    return (
        found.withColumn("phrases", F.array_sort("phrases"))
        .withColumn("phrase_count", F.size("phrases"))
        .withColumn("informative", S.flag(F.col("phrase_count") > 0))
    )


def _search(listed: list[str]):
    """A column function: the phrases of the list that a text holds; Spark sends a large function to each executor once."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        built, everywhere = automaton([p for p in listed if p]), [""] if "" in listed else []
        for batch in texts:
            yield pd.Series([_held(built, everywhere, text) for text in batch], dtype=object)

    return search


def _held(built, everywhere: list[str], text: str | None) -> list[str]:
    if text is None:
        return []
    # an automaton without words cannot search
    return everywhere + (list({phrase for _, phrase in built.iter(text)}) if len(built) else [])
