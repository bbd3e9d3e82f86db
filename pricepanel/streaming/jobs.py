"""Streaming queries; each returns a started StreamingQuery."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pricepanel.sources.sinks import insert_ignore
from pricepanel.sources.store import KeyedStore
from pricepanel.streaming import instant

FILES_PER_BATCH = 100  # fixed value: the commit interval of collection
BUCKETS = 1 << 11  # states that the pairs of ordered changes share


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def _start(writer, checkpoint: str, continuous: str | None) -> StreamingQuery:
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def snapshot_ingest(
    stream: DataFrame, path: str, schema: T.StructType, keys: list[str], order: list, checkpoint: str,
    day: str | None = None, every: str | None = None,
) -> StreamingQuery:
    """Insert each micro-batch into a write-once table; replays and repeats change nothing."""

    def commit(batch: DataFrame, _: int) -> None:
        insert_ignore(batch, path, schema, keys, order, day)

    return _start(stream.writeStream.foreachBatch(commit), checkpoint, every)


def keyed_ingest(stream: DataFrame, store: KeyedStore, order: list, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Insert each micro-batch into a keyed store, once, whatever is retried.

    A batch is named by the checkpoint and its number, so a stream with a checkpoint of its own inserts anew.
    """
    source = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def commit(batch: DataFrame, number: int) -> None:
        store.insert(batch, order, f"{source}-{number}")

    return _start(stream.writeStream.foreachBatch(commit), checkpoint, every)


def deduplicated(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within the watermark, with state bounded by the delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def weekly_mean(stream: DataFrame, keys: list[str], value: str, event_time: str, delay: str, width: str = "7 days") -> DataFrame:
    """Tumbling mean of a value; the engine closes a window when the watermark passes its end."""
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, width), *keys)
        .agg(F.avg(value).alias(f"avg_{value}"), F.count(F.lit(1)).alias("quotes"))
        .select(F.col("window.start").alias("week_start"), F.col("window.end").alias("week_end"), *keys, f"avg_{value}", "quotes")
    )


def append_files(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return _start(stream.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, every)


def price_changes(stream: DataFrame, keys: list[str], order: list[str], price: str) -> DataFrame:
    """Price changes of each pair, with its last price and time as state.

    A key's rows in one micro-batch are sorted by event time; admission control
    on the source bounds them. Rows from before the last one seen are skipped.
    """
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    when = order[0]
    output = T.StructType(
        [T.StructField(c, kinds[c]) for c in [*keys, *order, price]]
        + [T.StructField(f"{price}_prev", T.DoubleType()), T.StructField(f"{price}_change", T.DoubleType())]
    )
    state = T.StructType([T.StructField("price", T.DoubleType()), T.StructField("seen", T.LongType())])

    def detect(key, chunks, held: GroupState):
        rows = pd.concat(list(chunks))
        sort = {c: rows[c].to_numpy() for c in order}
        at = np.lexsort([sort[c] for c in reversed(order)])
        times = sort[when].astype("datetime64[us]").astype("int64")
        last, seen = held.get if held.exists else (np.nan, None)
        if seen is not None:
            at = at[times[at] >= seen]
        if not len(at):
            return
        prices = rows[price].to_numpy()[at]
        before = np.concatenate([[last], prices[:-1]])
        held.update((float(prices[-1]), int(times[at[-1]])))
        change = prices - before
        moved = np.flatnonzero(np.nan_to_num(change) != 0)
        if len(moved):
            columns = {name: [key[i]] * len(moved) for i, name in enumerate(keys)}
            columns |= {c: sort[c][at[moved]] for c in order}
            columns |= {price: prices[moved], f"{price}_prev": before[moved], f"{price}_change": change[moved]}
            yield pd.DataFrame(columns)[output.names]

    return stream.select(*keys, *order, price).groupBy(*keys).applyInPandasWithState(
        detect, output, state, "append", GroupStateTimeout.NoTimeout
    )


def _ordinals(values: pd.Series) -> np.ndarray:
    """Numbers in the order of the values; equal values share one, and missing ones come last."""
    codes = pd.factorize(values, sort=True)[0]
    return np.where(codes < 0, codes.max(initial=0) + 1, codes)


def _packed(frame: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_pandas(date_as_object=True)


def _compare(rows: pd.DataFrame, pair: list[str], tie: list[str], passed: int, idle: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The changes among the rows of several pairs that the watermark has passed, and the rows to keep.

    ``us`` is a row's time; ``done`` marks the last compared row of a pair. To keep: waiting rows, and the last
    compared row of each pair that is not idle.
    """
    which = np.zeros(len(rows), np.int64)
    for c in pair:
        own = _ordinals(rows[c])
        which = np.unique(which * (int(own.max()) + 1) + own, return_inverse=True)[1]
    us = rows["us"].to_numpy()
    order = np.lexsort([*(_ordinals(rows[c]) for c in reversed(tie)), us, ~rows["done"].to_numpy(dtype=bool), us > passed, which])
    rows, which, us = rows.iloc[order].reset_index(drop=True), which[order], us[order]
    due, price = us <= passed, rows["price"].to_numpy()
    after = np.append(False, which[1:] == which[:-1])
    gap, before = np.diff(us, prepend=0), np.append(np.nan, price[:-1])
    moved = due & after & ~rows["done"].to_numpy(dtype=bool) & (gap <= idle) & (price != before)
    # the last due row of a pair
    last = due & ~np.append(due[1:] & after[1:], False) & (us + idle >= passed)
    changes = rows[moved].assign(before=before[moved])
    return changes, rows[~due | last].assign(done=due[~due | last])


def _plain(kinds: dict[str, T.DataType], columns: list[str], prefix: str) -> tuple[list[Column], list[T.StructField], list[Column]]:
    """Columns as pandas carries them unchanged: numbers get a flag for null. Also their fields, and the way back."""
    there, fields, back = [], [], []
    for i, c in enumerate(columns):
        kind, name = kinds[c], f"{prefix}{i}"
        fields.append(T.StructField(name, kind))
        if isinstance(kind, (T.IntegralType, T.FractionalType, T.BooleanType)):
            zero = F.lit(False if isinstance(kind, T.BooleanType) else 0).cast(kind)
            # adding zero makes the two zeros one value
            value = F.coalesce(c, zero) + zero if isinstance(kind, (T.FloatType, T.DoubleType)) else F.coalesce(c, zero)
            there += [value.alias(name), F.col(c).isNull().alias(f"{name}_null")]
            fields.append(T.StructField(f"{name}_null", T.BooleanType()))
            back.append(F.when(~F.col(f"{name}_null"), F.col(name)).alias(c))
        else:
            there.append(F.col(c).alias(name))
            back.append(F.col(name).alias(c))
    return there, fields, back


def ordered_price_changes(
    stream: DataFrame, keys: list[str], when: str, tie: list[str], price: str, delay: str, idle_seconds: int, buckets: int = BUCKETS
) -> DataFrame:
    """Price changes of each pair in order of event time, for rows that arrive in any order within ``delay``.

    A change comes out once the watermark has passed its row, so every row that could stand before it has
    arrived; rows behind the watermark are dropped by the engine. Rows without a price are passed
    over. A pair that is silent for more than ``idle_seconds`` starts anew, and its state ends when the watermark passes
    that time: state holds the rows of the last ``delay`` and the pairs that are not idle. ``when`` is a zone-less
    timestamp without nulls, keys and tie columns are plain values. The state store of the session is set to RocksDB.

    Pairs share ``buckets`` states by their hash, so a micro-batch hands each task few large groups, whose pairs are
    compared together; the number is part of the checkpoint and stays as a stream was started. One timeout a bucket
    stands at its first waiting row or, before that, where a pair counts as idle.
    """
    stream.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    pair_columns, pair_fields, pair_back = _plain(kinds, keys, "__key")
    tie_columns, tie_fields, tie_back = _plain(kinds, tie, "__tie")
    pair, idle = [f.name for f in pair_fields], idle_seconds * 1_000_000
    # the null flag leads its number, so nulls come last
    ranked = [name for f in tie_fields if not f.name.endswith("_null") for name in (f"{f.name}_null", f.name) if name in {t.name for t in tie_fields}]
    names = ["us", *pair, *[f.name for f in tie_fields], "price"]
    output = T.StructType([*pair_fields, T.StructField("at", T.TimestampNTZType()), *tie_fields, T.StructField("price", T.DoubleType()), T.StructField("before", T.DoubleType())])
    state = T.StructType([T.StructField("rows", T.BinaryType())])

    def detect(_, chunks, held: GroupState):
        fresh = [c[names] for c in chunks if len(c)]
        fresh = [c[c["price"].notna()].assign(done=False) for c in fresh]
        parts = ([_unpacked(held.get[0])] if held.exists else []) + [c for c in fresh if len(c)]
        if not parts:
            return
        watermark = held.getCurrentWatermarkMs()
        changes, kept = _compare(pd.concat(parts, ignore_index=True), pair, ranked, watermark * 1000, idle)
        if len(kept):
            held.update((_packed(kept),))
            # an instant is passed when the watermark reaches it; a timeout fires once the watermark is beyond it
            wake = (kept["us"] + np.where(kept["done"], idle + 1000, 0)).min()
            held.setTimeoutTimestamp(max(-(-int(wake) // 1000) - 1, watermark, 1))
        elif held.exists:
            held.remove()
        if len(changes):
            yield changes.assign(at=pd.to_datetime(changes["us"], unit="us"))[output.names]

    rows = stream.select(
        F.pmod(F.xxhash64(*pair_columns), F.lit(buckets)).alias("__bucket"), instant(when).alias("__at"), *pair_columns, *tie_columns,
        F.col(price).cast("double").alias("price"),
    )
    timed = rows.withWatermark("__at", delay).withColumn("us", F.unix_micros("__at"))
    found = timed.groupBy("__bucket").applyInPandasWithState(detect, output, state, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*pair_back, F.col("at").alias(when), *tie_back, F.col("price").alias(price), F.col("before").alias(f"{price}_prev"),
                        (F.col("price") - F.col("before")).alias(f"{price}_change"))


def late_counts(all_rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per window in the batch, rows the stream kept, and the late rest."""
    whole = all_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("quotes"))
    return (
        whole.join(kept.select(*keys, F.col("quotes").alias("kept")), keys, "left")
        .fillna(0, ["kept"])
        .withColumn("late", F.col("quotes") - F.col("kept"))
    )
