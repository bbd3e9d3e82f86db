"""Line-first cleaning of texts by rules, in built-in functions only.

Each line of a text is tested by itself: is it set in capitals, is it navigation, is it made
of symbols, does it stutter, is it a known boilerplate phrase, does it run on without any punctuation? Lines that
fail are removed, and a text that loses too much of its length is rejected. Counts over the whole
text (words, symbols, repeated lines and windows) reject texts beforehand.

All work stays in the row of a text: no shuffle, no join. Windows of words are compared by their
64-bit hashes; two different windows of one text meet by chance about once in 1e10 long texts.

Defined results: null text has no words and is rejected; empty likewise; very long texts are handled
whole in their row; repeated rows give repeated results; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricepanel.llm import tables

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A text that keeps a smaller share of its characters is rejected.
MIN_KEPT_PERCENT = 50
#: Phrases of short lines that are no prose.
BOILERPLATE = (
    "all rights reserved", "copyright", "cookie", "privacy policy", "terms of use", "terms of service", "licensed under", "released under",
    "sign in", "sign up", "log in", "subscribe", "newsletter", "click here", "read more", "share this", "javascript", "powered by", "back to top",
)
BOILERPLATE_WORDS = 20
#: Signs that prose holds few of, and those among them that separate the entries of a menu or table.
SIGNS, BARS = r"#*$%&|<>{}~^=@\\", "|"


def _only(text: Column, letters: str) -> Column:
    """The characters of ``text`` that belong to the class, in order."""
    return F.regexp_replace(text, f"[^{letters}]++", "")


def _without_blanks(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def _joined_with_later(k: int):
    """Combines each entry of a list with the one ``k`` places on."""
    return lambda h: F.zip_with(h, F.slice(h, F.lit(k + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))


def repeated_words(words: Column) -> Column:
    """How many words stand in windows that occur twice or more in the list."""
    n = F.size(words)
    # hashes of words, then of runs of 2, 4 and 8 of them; each list is bound once by a one-element array
    windows = F.array(F.transform(words, lambda w: F.xxhash64(w)))
    for k in (1, 2, 4):
        windows = F.transform(windows, _joined_with_later(k))
    # where a run goes beyond the text's end its hash is of no window
    windows = F.transform(windows, lambda h: F.slice(h, F.lit(1), n - (WINDOW - 1)))
    has = F.when(n >= WINDOW, F.get(windows, F.lit(0)))

    def covered(found: Column) -> Column:
        places = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = F.transform(F.array(places), lambda s: F.filter(
            s, lambda e, j: F.coalesce(F.get(s, j - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["x"] == e["x"], F.lit(False))
        ))
        starts = F.sort_array(F.transform(F.get(twice, F.lit(0)), lambda e: e["i"]))
        empty = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
        total = F.aggregate(starts, empty, lambda acc, i: F.struct(
            (acc["sum"] + i + WINDOW - F.greatest(acc["end"], i)).alias("sum"), (i + WINDOW).alias("end")
        ))
        return total["sum"]

    result = F.transform(F.array(has), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.coalesce(F.get(result, F.lit(0)), F.lit(0))


def line_facts(line: Column) -> Column:
    """What the rules ask about one line, found once."""
    return F.struct(
        line.alias("line"), F.length(_without_blanks(line)).alias("solid"), F.length(_only(line, "A-Z")).alias("capitals"),
        _only(line, SIGNS).alias("signs"),
    )


def line_fails(line: Column) -> Column:
    """The rules for the facts of one line that holds a word."""
    solid = line["solid"]
    words = F.length(line["line"]) - solid + 1
    lower = F.lower(line["line"])
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | F.contains(lower, F.lit(phrase))
    bars = F.length(_only(line["signs"], BARS))
    return (
        ((solid >= 10) & (line["capitals"] * 5 >= solid * 2))
        | ((bars >= 3) & (bars * 5 >= words))
        | (F.length(line["signs"]) * 8 >= solid)
        | ((words >= 12) & (F.size(F.array_distinct(F.split(line["line"], " "))) * 4 <= words))
        | ((words <= BOILERPLATE_WORDS) & boilerplate)
        | ((words >= 10) & ~line["line"].rlike(r"[.,;:!?]"))
    )


def measured(docs: DataFrame) -> DataFrame:
    """The counts of each text, its lines that pass, and the verdicts."""
    rows = tables.texts(docs).withColumn("words", F.array_remove(F.split("text", SPACE + "+"), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(_only(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
        F.filter(F.transform("lines", line_facts), lambda x: ~line_fails(x)).alias("good"),
    )
    rows = rows.withColumn("passed", F.transform("good", lambda x: x["line"]))
    rows = rows.withColumn("kept_chars", F.aggregate("good", F.lit(0).cast("long"), lambda a, x: a + x["solid"])).drop("good")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") * 100 >= F.col("word_chars") * MIN_KEPT_PERCENT))


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents with their passing lines as text: doc_id, text."""
    return measured(docs).where("kept").select("doc_id", F.array_join("passed", "\n").alias("text"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = measured(tables.table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", F.size("passed").cast("long").alias("n_kept_lines"), "kept_chars",
    )
