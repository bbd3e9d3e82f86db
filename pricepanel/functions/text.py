"""Text expressions for listing descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricepanel.functions.scalars import column

# The expander overflow, ASCII punctuation, whitespace, and the
# country names that the source pages use.
OVERFLOW = r"&#171;Show less.+&#187;Read more"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
SPACE = r"[ \t\n\r\f]"
HOME_COUNTRY = "United States"
SHORT_COUNTRY = {"United Kingdom": "UK"}


def clean_text(c: str | Column) -> Column:
    """Lower-case words: overflow, punctuation and standalone numbers out, runs of space to one."""
    x = F.regexp_replace(column(c), OVERFLOW, " ")
    x = F.regexp_replace(x, PUNCTUATION, " ")
    x = F.regexp_replace(x, rf"(?<={SPACE})[0-9]+(?={SPACE})", " ")
    return F.regexp_replace(F.lower(x), rf"{SPACE}+", " ")


def word_count(c: str | Column) -> Column:
    """Runs of non-word characters plus one; a text without any such run also counts two."""
    runs = F.size(F.regexp_extract_all(column(c), F.lit(r"(\W+)"), F.lit(1)))
    return F.greatest(runs, F.lit(1)) + F.lit(1)


def ship_origin(c: str | Column) -> Column:
    """Origin with the home suffix cut, long names shortened, and home itself null."""
    x = F.replace(column(c), F.lit(f", {HOME_COUNTRY}"), F.lit(""))
    for long, short in SHORT_COUNTRY.items():
        x = F.replace(x, F.lit(long), F.lit(short))
    return F.when(x != HOME_COUNTRY, x)


def word_grams(words: Column, n: int) -> Column:
    """All runs of ``n`` successive words of an array of words, joined by one space."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - F.lit(n - 1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
