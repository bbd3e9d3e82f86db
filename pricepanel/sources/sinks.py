"""Sinks: CSV files and write-once tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricepanel.operators.cleaning import first_by
from pricepanel.session import stage
from pricepanel.sources.tables import NULL_MARK


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    df.write.csv(path, header=header, sep=sep, nullValue=NULL_MARK, dateFormat="yyyy-MM-dd")


def append_quoted(df: DataFrame, path: str) -> None:
    """Append rows to a CSV folder with every value quoted, no header."""
    df.write.mode("append").csv(path, header=False, quoteAll=True, nullValue=NULL_MARK, dateFormat="yyyy-MM-dd")


def create_store(spark: SparkSession, path: str, schema: T.StructType, partition_by: list[str] | None = None) -> None:
    """An empty write-once table."""
    spark.createDataFrame([], schema).write.partitionBy(*(partition_by or [])).parquet(path)


def _less_stored(fresh: DataFrame, stored: DataFrame, keys: list[str], day: str | None) -> DataFrame:
    """Rows whose key is not stored; a null in a key equals a null."""
    if day:  # one row for each day of the batch
        days = [r[0] for r in fresh.select(day).distinct().collect()]
        held = F.col(day).isin([d for d in days if d is not None])
        stored = stored.filter(held | F.col(day).isNull() if None in days else held)
    marks = stored.select(*[F.col(c).alias(f"__stored_{c}") for c in keys])
    same = [F.col(c).eqNullSafe(F.col(f"__stored_{c}")) for c in keys]
    return fresh.join(marks, same, "left_anti")


def unseen(batch: DataFrame, stored: DataFrame, keys: list[str], order: list, day: str | None = None) -> DataFrame:
    """First row per key of a batch, less the keys already stored; null keys count as equal.

    With ``day``, a column that partitions the store and is one of the keys,
    only the partitions of the batch's own days are read.
    """
    return _less_stored(first_by(batch, keys, order), stored, keys, day)


def insert_ignore(batch: DataFrame, path: str, schema: T.StructType, keys: list[str], order: list, day: str | None = None) -> None:
    """Append the rows whose key the table does not hold yet; the first write of a key stays.

    Running the same batch again adds nothing, so a retried batch is harmless.
    The batch is read once, and its first rows are written before they are compared, so a lost executor costs no
    second read. Without ``day`` the whole table is read; see `store.KeyedStore` for keys without one.
    """
    stored = batch.sparkSession.read.schema(schema).parquet(path)
    first = stage(first_by(batch, keys, order), "batch")
    fresh = _less_stored(first, stored, keys, day).select(*schema.names)
    fresh.write.mode("append").partitionBy(*([day] if day else [])).parquet(path)
