"""Distinct listings of sellers over any stretch of days, from stored sketches and without reading old quotes."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricepanel.schemas import PANEL, PanelColumns

LOG_K = 12


@dataclass(frozen=True)
class StoredListings:
    """HyperLogLog sketches of the products of each seller and day at ``path``, in a folder for each day and batch.

    Sketches of days and batches merge without loss, so a quote that comes twice, on two days or in two batches, counts
    once. A batch that is added again under its name replaces itself. Days must not be null; null sellers are a seller of
    their own, null products are not counted. Size: at most ``2 ** log_k`` bytes for each seller, day and batch.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    log_k: int = LOG_K
    cols: PanelColumns = PANEL

    @classmethod
    def of(cls, quotes: DataFrame, path: str, log_k: int = LOG_K, cols: PanelColumns = PANEL) -> StoredListings:
        """An empty store for quotes of this schema."""
        kinds = {f.name: f.dataType for f in quotes.schema.fields}
        own = {"products": T.BinaryType(), "__batch": T.StringType()}
        names = [cols.seller, "products", cols.day, "__batch"]
        schema = T.StructType([T.StructField(c, own.get(c) or kinds[c]) for c in names])
        quotes.sparkSession.createDataFrame([], schema).write.partitionBy(cols.day, "__batch").parquet(path)
        return cls(quotes.sparkSession, path, schema, log_k, cols)

    @property
    def standard_error(self) -> float:
        """Relative standard error of an estimate that is merged from many sketches."""
        return 1.04 / math.sqrt(2**self.log_k)

    def add(self, quotes: DataFrame, batch_id: str) -> None:
        """Sketch the products of a batch: one small row a seller and day, combined before the shuffle."""
        name = re.sub(r"[^A-Za-z0-9_-]", "_", batch_id)
        sketch = F.hll_sketch_agg(F.col(self.cols.product), F.lit(self.log_k)).alias("products")
        rows = quotes.filter(F.col(self.cols.day).isNotNull()).groupBy(self.cols.seller, self.cols.day).agg(sketch)
        writer = rows.withColumn("__batch", F.lit(name)).select(*self.schema.names).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(self.cols.day, "__batch").parquet(self.path)

    def sketches(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        """The stored sketches from ``since`` to ``until``, both included; folders of other days are not read."""
        held = self.spark.read.schema(self.schema).parquet(self.path)
        if since is not None:
            held = held.filter(F.col(self.cols.day) >= F.lit(since))
        return held if until is None else held.filter(F.col(self.cols.day) <= F.lit(until))

    def num_listings(self, by: dict[str, Column] | None = None, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        """Estimated distinct products per seller, and per further columns of the day such as a year or a month."""
        keys = [c.alias(name) for name, c in (by or {}).items()]
        merged = self.sketches(since, until).groupBy(self.cols.seller, *keys).agg(F.hll_union_agg("products").alias("__all"))
        return merged.withColumn("num_listings", F.hll_sketch_estimate("__all")).drop("__all")
