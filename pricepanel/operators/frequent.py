"""The most frequent values of a very large bag, exact, without shuffling every distinct value.

Each task keeps a frequent-item summary of its values: at most ``counters`` hashes with counts. Where more come up, the
count of the first hash past the limit is taken off all and the rest goes (the mergeable form of Space-Saving), so a kept
count is short by at most the sum of what was taken off. Counts of all tasks add up, and so do their errors.

A value outside the survivors can then have no more than a known number of occurrences; survivors are counted
exactly in a second scan, and the answer stands when its last count reaches that number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.session import stage

COUNTERS = 1 << 16
#: Rows of a task between two cuts of its summary.
PENDING = 1 << 20
#: Summaries are made anew with this many times the counters where the bound does not hold, up to `MOST` counters a task.
GROW = 4
MOST = 1 << 22

Reader = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]


def cut(hashes: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Add up equal hashes and keep at most ``counters``; the third value is what was taken off each count."""
    kept, at = np.unique(hashes, return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(kept)).astype(np.int64)  # exact below 2**53
    if len(kept) <= counters:
        return kept, total, 0
    off = int(np.partition(total, len(total) - counters - 1)[len(total) - counters - 1])
    over = total > off
    return kept[over], total[over] - off, off


def first_column(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    return (batch.column(0).to_numpy(zero_copy_only=False) for batch in batches)


def summaries(rows: DataFrame, counters: int = COUNTERS, hashes_of: Reader = first_column) -> DataFrame:
    """Rows (hash, count) of the merged summaries; the row with a null hash holds the largest possible shortfall.

    ``hashes_of`` makes arrays of hashes from the Arrow batches of ``rows``.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, off = np.empty(0, np.int64), np.empty(0, np.int64), 0
        pending, waiting = [], 0
        limit = max(PENDING, 2 * counters)

        def settle():
            nonlocal hashes, counts, off, pending, waiting
            ones = np.ones(waiting, np.int64)
            hashes, counts, lost = cut(np.concatenate([hashes, *pending]), np.concatenate([counts, ones]), counters)
            off, pending, waiting = off + lost, [], 0

        for found in hashes_of(batches):
            pending.append(found)
            waiting += len(found)
            if waiting >= limit:
                settle()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(counts, pa.int64())], ["hash", "count"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([off], pa.int64())], ["hash", "count"])

    return rows.mapInArrow(summarise, "hash long, count long").groupBy("hash").agg(F.sum("count").alias("count"))


def most_frequent(values: DataFrame, column: str, top: int, counters: int = COUNTERS) -> DataFrame:
    """The ``top`` values with their ``count``, ties by value; nulls are not counted.

    ``values`` is scanned twice, so it should be cheap to read again (a table, or a staged one). Rows shuffled: at most
    ``counters`` a task, then the survivors' counts.
    """
    held = values.select(column).filter(F.col(column).isNotNull())
    keyed = held.withColumn("hash", F.xxhash64(column))
    tally = lambda rows: rows.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return top_by_summaries(
        lambda size: summaries(keyed.select("hash"), size),
        lambda survivors: tally(keyed.join(survivors, ["hash"], "left_semi")),
        lambda: tally(held),
        column, top, counters,
    )


def top_by_summaries(
    summarise: Callable[[int], DataFrame],
    count: Callable[[DataFrame], DataFrame],
    count_all: Callable[[], DataFrame],
    column: str,
    top: int,
    counters: int = COUNTERS,
) -> DataFrame:
    """The ``top`` rows by count from summaries of a size, exact counts of given hashes, and, at worst, of all values.

    If the bound does not hold with ``MOST`` counters, as where no value is frequent, all values are counted.
    """
    ranked = lambda counts: counts.orderBy(F.desc("count"), column).limit(top)
    while counters <= MOST:
        merged = stage(summarise(counters), "summaries")
        # One row of three numbers: the shortfall, and the count that the last of the top has at least.
        short = merged.filter(F.col("hash").isNull()).agg(F.coalesce(F.max("count"), F.lit(0)).alias("short"))
        kept = merged.filter(F.col("hash").isNotNull())
        leaders = kept.orderBy(F.desc("count")).limit(top).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least"))
        bound = leaders.withColumn("short", short.scalar()).first()
        floor = bound["least"] if bound["n"] == top else 0
        while bound["short"] == 0 or floor > bound["short"]:
            survivors = stage(kept.filter(F.col("count") + bound["short"] >= floor).select("hash"), "survivors")
            answer = stage(ranked(count(survivors)), "frequent")
            last = answer.agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).first()
            reached = last["least"] if last["n"] == top else 0
            # Two values of one hash can hold the floor too high; it then falls to a count that was reached.
            if reached >= floor:
                return answer
            floor = reached
        counters *= GROW
    return ranked(count_all())
