"""Product-day medians kept up to date as quotes come in, from counts of prices and without reading old quotes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricepanel.operators import cleaning as K
from pricepanel.schemas import PANEL, PanelColumns


@dataclass(frozen=True)
class StoredMedians:
    """Counts of prices by product and day at ``path``, in a folder for each day and batch.

    Counts of two batches add up, so the medians stay exact: a new day reads none of the older days, and a late
    quote reads the counts of its own day. A batch that is added again under its name replaces itself.
    Days must not be null. Size: the distinct prices of each product-day and batch, at most the quotes.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    cols: PanelColumns = PANEL

    @classmethod
    def of(cls, quotes: DataFrame, path: str, cols: PanelColumns = PANEL) -> StoredMedians:
        """An empty store for typed quotes of this schema."""
        kinds = {f.name: f.dataType for f in quotes.schema.fields}
        names = [cols.product, cols.price, "n_at", cols.day, "__batch"]
        own = {"n_at": T.LongType(), "__batch": T.StringType()}
        schema = T.StructType([T.StructField(c, kinds.get(c) or own[c]) for c in names])
        quotes.sparkSession.createDataFrame([], schema).write.partitionBy(cols.day, "__batch").parquet(path)
        return cls(quotes.sparkSession, path, schema, cols)

    def add(self, quotes: DataFrame, batch_id: str) -> None:
        """Count the prices of a batch of typed quotes."""
        name = re.sub(r"[^A-Za-z0-9_-]", "_", batch_id)
        counts = K.price_counts(quotes.filter(F.col(self.cols.day).isNotNull()), self.cols).withColumn("__batch", F.lit(name))
        writer = counts.select(*self.schema.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(self.cols.day, "__batch").parquet(self.path)

    def counts(self, days: list | None = None) -> DataFrame:
        """Quotes ``n_at`` each price, of all days or of the given ones; other days' folders are not read."""
        held = self.spark.read.schema(self.schema).parquet(self.path)
        if days is not None:
            held = held.filter(F.col(self.cols.day).isin(days))
        return held.groupBy(*self.cols.product_day, self.cols.price).agg(F.sum("n_at").alias("n_at"))

    def medians(self, days: list | None = None) -> DataFrame:
        return K.medians_of_counts(self.counts(days), self.cols)
