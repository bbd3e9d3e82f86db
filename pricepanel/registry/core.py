"""Registration of queries with the columns they return and their DuckDB form."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricepanel.registry.fixture import Fixture
from pricepanel.registry.sql_blocks import BLOCKS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
# Both engines round the same way unless a value lies on a tie, where the last bit
# of a sum decides; means of prices in cents often do, so both are moved off the tie.
NUDGE = "1e-9"

# Kinds in a column list: no suffix text, :i whole number, :f number rounded, :d date.
SPARK_FORM = {
    "s": lambda c: F.col(c).cast("string"),
    "i": lambda c: F.col(c).cast("bigint"),
    "f": lambda c: F.round(F.col(c).cast("double") + F.lit(float(NUDGE)), DIGITS),
    "d": lambda c: F.col(c).cast("date"),
}
DUCKDB_FORM = {
    "s": "CAST({c} AS VARCHAR)",
    "i": "CAST({c} AS BIGINT)",
    "f": f"round(CAST({{c}} AS DOUBLE) + {NUDGE}, {DIGITS}) + 0.0",
    "d": "CAST({c} AS DATE)",
}


def parse_columns(spec: str) -> list[tuple[str, str]]:
    return [(c.partition(":")[0], c.partition(":")[2] or "s") for c in spec.split()]


def present(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[SPARK_FORM[kind](c).alias(c) for c, kind in parse_columns(spec)])


def with_blocks(body: str) -> str:
    """The statement with the named blocks it needs in front, in order of definition."""
    needed: set[str] = set()
    frontier = [body]
    while frontier:
        words = set(re.findall(r"\w+", frontier.pop()))
        for name in words & BLOCKS.keys() - needed:
            needed.add(name)
            frontier.append(BLOCKS[name])
    ctes = ",\n".join(f"{name} AS (\n{sql.strip()}\n)" for name, sql in BLOCKS.items() if name in needed)
    return f"WITH {ctes}\n{body}" if ctes else body


def duckdb_statement(body: str, spec: str) -> str:
    out = ", ".join(f"{DUCKDB_FORM[kind].format(c=c)} AS {c}" for c, kind in parse_columns(spec))
    return with_blocks(f"SELECT {out} FROM (\n{body.strip()}\n) AS answer")


def query(spec: str, sql: str | None = None, name: str | None = None):
    """Register a function of a Fixture under its name; without SQL it has no DuckDB form."""

    def register(fn: Callable[[Fixture], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(Fixture(spark, sf_dir)), spec)

        QUERIES[key] = run
        if sql:
            ORACLES[key] = duckdb_statement(sql, spec)
        return fn

    return register
