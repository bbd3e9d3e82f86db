"""User functions per group, for what the built-in aggregates cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _column(parts: list[pd.Series]) -> pd.Series:
    """One column from those of several groups; unlike types are kept value by value."""
    alike = len({p.dtype for p in parts}) == 1
    return pd.concat(parts if alike else [p.astype(object) for p in parts], ignore_index=True)


def _together(found: list[pd.DataFrame], names: list[str]) -> pd.DataFrame:
    """The results of several groups under the names of the schema: by label if labels are strings, else by place."""
    found = [f if all(isinstance(c, str) for c in f.columns) else f.set_axis(names, axis=1) for f in found if len(f)]
    return pd.DataFrame({c: _column([f[c] for f in found]) for c in names}, columns=names) if found else pd.DataFrame(columns=names)


def group_apply(
    df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """Run ``fn`` on each group as a pandas frame.

    A group must fit one task; group by keys with a bound on their rows, such as
    a pair's days, and use the built-in aggregates for everything else. Groups
    go to the full number of shuffle partitions: time is spent per group here,
    so merging partitions by their size in bytes would idle the other cores.

    Spark sorts the groups and marks where each begins; rows then travel in batches of many groups, since a
    transfer of its own for each group takes longer than most functions.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns, names = df.columns, spark.createDataFrame([], schema).columns
    # whole numbers and flags travel beside a mark for null, so that a null changes its own group's types alone
    marked = {f.name: f.dataType for f in df.schema.fields if f.nullable and isinstance(f.dataType, (T.IntegralType, T.BooleanType))}
    filled = {c: F.coalesce(c, F.lit(False if isinstance(k, T.BooleanType) else 0).cast(k)) for c, k in marked.items()}
    marks = {f"__null_{c}": F.col(c).isNull() for c in marked}
    begins = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) == 1
    dealt = df.repartition(partitions, *keys).withColumn("__begins", begins)
    dealt = dealt.withColumns(marks).withColumns(filled) if marked else dealt

    def group(pieces: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pieces[0].reset_index(drop=True) if len(pieces) == 1 else pd.concat(pieces, ignore_index=True)
        if not marked:
            return fn(rows)
        values = rows[columns]
        for c, kind in marked.items():
            empty = rows[f"__null_{c}"].to_numpy(dtype=bool)
            if empty.any():
                whole = values[c].astype(object if isinstance(kind, T.BooleanType) else float)
                values[c] = whole.where(~empty, None if isinstance(kind, T.BooleanType) else np.nan)
        return fn(values)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the group that may go on in the next batch
        for frame in frames:
            starts = np.flatnonzero(frame.pop("__begins").to_numpy(dtype=bool))
            edges = [*starts.tolist(), len(frame)]
            if edges[0]:
                held.append(frame.iloc[: edges[0]])
            found = []
            for a, b in zip(edges, edges[1:]):
                if held:
                    found.append(group(held))
                held = [frame.iloc[a:b]]
            if found:
                yield _together(found, names)
        if held:
            yield _together([group(held)], names)

    return dealt.mapInPandas(run, schema)
