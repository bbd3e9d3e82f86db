"""Scalar expressions: text to number, guarded arithmetic, date buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_text(c: str | Column, mark: str) -> Column:
    """A number written with a mark to drop: ``'95%'`` or ``'1,234'``; null when it is not a number."""
    return F.replace(column(c), F.lit(mark), F.lit("")).try_cast("double")


def percent(c: str | Column) -> Column:
    return number_text(c, "%")


def thousands(c: str | Column) -> Column:
    return number_text(c, ",")


def iso_date(c: str | Column) -> Column:
    return F.try_to_date(column(c), "yyyy-MM-dd")


def as_dates(df: DataFrame, *names: str) -> DataFrame:
    """Parse ISO date text; columns that hold dates already stay as they are."""
    text = [n for n in names if df.schema[n].dataType == T.StringType()]
    return df.withColumns({n: iso_date(n) for n in text}) if text else df


def flag(condition: Column) -> Column:
    """A 0/1 integer, null where the condition is null."""
    return condition.cast("int")


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b``, null for a zero divisor."""
    return F.try_divide(column(a).cast("double"), column(b).cast("double"))


def safe_ln(c: str | Column, offset: float = 0.0) -> Column:
    """``ln(c + offset)``, null where the argument is not positive."""
    x = column(c) + F.lit(offset) if offset else column(c)
    return F.when(x > 0, F.ln(x))


def half_even(c: str | Column, digits: int = 0) -> Column:
    return F.bround(column(c), digits)


def week_elapsed(day: str | Column, first_day: Column) -> Column:
    """Week number of ``day`` counted from the first day of the data, which is day 2 of week 1."""
    return F.floor((F.datediff(column(day), first_day) + F.lit(2)) / F.lit(7) + F.lit(1)).cast("int")


def null_flag(c: str | Column) -> Column:
    return column(c).isNull().cast("int")


def zero_if_null(c: str | Column) -> Column:
    return F.coalesce(column(c), F.lit(0))
