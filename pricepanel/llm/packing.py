"""Packing of documents into sequences of one length by the configuration linear program.

A configuration is a set of piece lengths that fit one sequence. The program asks
for the fewest sequences that cover the histogram of lengths. It is solved by
multiplicative weights: lengths that are still poorly covered gain weight, and a
knapsack dynamic program over the capacity prices the configurations of most
weight. Their shares are rounded to whole numbers of sequences, what is left over
is solved again, and the last few pieces are placed one by one where they fit best.

Only the histogram (at most one number per length up to the capacity) reaches the
driver. Its answer, a list of configurations with their numbers of sequences,
turns into ranges of ranks per length; each piece finds its own by the rank that it
has among the pieces of its length. A task counts ranks for its own pieces, and
counts per task and length are summed, so a length that half of all pieces share is
never sorted or gathered.

Defined results: null text is empty and gives a piece of the end id alone; rows
with equal or null doc_id are packed each on its own; an empty table gives no rows;
other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.llm import tables, tokens
from pricepanel.session import stage

CAPACITY = 2048
END_ID = 0
#: Rounds of pricing per solution.
ROUNDS = 20
#: Room that a rounded configuration may leave, solution by solution; beyond the list any is taken.
SLACK = (0, 0, 1, 2, 4, 8, 32, 128, 512)
#: This many pieces or fewer are placed one by one.
REST = 2048
#: Configurations priced by one run of the dynamic program, each through another length.
THROUGH = 48
STEP = 0.1
LONGER = 1.0

PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long, task int, ordinal long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Encode every text, append the end id, and cut what is longer than a sequence.

    ``ordinal`` counts the pieces of one length inside the task ``task``.
    """
    path = tokenizer or tokens.tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, seen = TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part, ids, begin in tokens.encoded(batch, "text", path):
                sizes = np.diff(begin) + 1
                ids = np.insert(ids, begin[1:], np.array(end_id, ids.dtype)).astype("<u4")
                begin = np.cumsum(sizes) - sizes
                counts = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), counts)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = nth * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                place = begin[doc] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(place.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                sorted_lengths = length[order]
                firsts = np.searchsorted(sorted_lengths, sorted_lengths)
                ordinal = np.empty(len(length), np.int64)
                ordinal[order] = np.arange(len(length)) - firsts + seen[sorted_lengths]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.record_batch([
                    tables.row_numbers(task, rows, len(doc)), part.column("doc_id").take(pa.array(doc)), pa.array(nth, pa.int32()),
                    pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(ordinal),
                ], ["row_id", "doc_id", "piece", "start", "length", "ids_crc32", "task", "ordinal"])
                rows += len(doc)

    return tables.texts(docs).mapInArrow(cut, PIECES)


def knapsack(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest weight for each capacity, and the length that the best set for it takes last (0: none)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(weights > 0)
    values = weights[lengths]
    for c in range(1, capacity + 1):
        n = np.searchsorted(lengths, c, side="right")
        best[c], last[c] = best[c - 1], 0
        if n:
            sums = best[c - lengths[:n]] + values[:n]
            k = int(np.argmax(sums))
            if sums[k] > best[c - 1]:
                best[c], last[c] = sums[k], lengths[k]
    return best, last


def read_off(last: np.ndarray, capacity: int) -> list[int]:
    found = []
    while capacity > 0:
        if last[capacity]:
            found.append(int(last[capacity]))
            capacity -= int(last[capacity])
        else:
            capacity -= 1
    return found


def solve(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], float]]:
    """Configurations with fractional numbers of sequences, by multiplicative weights on the lengths."""
    present = np.flatnonzero(counts)
    cover = np.zeros(len(counts))
    weights = np.zeros(len(counts))
    shares: dict[tuple[int, ...], float] = {}
    for r in range(rounds):
        # a length's weight is its size, falling as it is covered beyond the least covered one; long
        # pieces weigh a little more than their size, so that short ones are kept for the last gaps
        weights[present] = present * (1 + LONGER * present / capacity) * np.exp(-STEP * (cover[present] - cover[present].min()))
        best, last = knapsack(weights, capacity)
        # complete a sequence through the lengths that are covered least, longest first
        through = sorted(present.tolist(), key=lambda n: (cover[n], -n))[:THROUGH]
        for n in through:
            if cover[n] > cover[present].min() + 1:
                continue
            config = [n]
            room = capacity - n
            for m in read_off(last, room):
                if config.count(m) < counts[m]:
                    config.append(m)
                    room -= m
            for m in reversed(present[present <= room].tolist()):
                if room < m:
                    continue
                free = int(counts[m]) - config.count(m)
                take = min(free, room // m)
                config += [m] * take
                room -= m * take
            key = tuple(sorted(config, reverse=True))
            used = np.bincount(key, minlength=len(counts))
            step = float((counts[used > 0] / used[used > 0]).min())
            shares[key] = shares.get(key, 0.0) + step
            cover += np.divide(used * step, counts, out=np.zeros(len(counts)), where=counts > 0)
        if cover[present].min() >= 1 and r >= rounds // 4:
            break
    most = max(1.0, float(cover.min(where=counts > 0, initial=np.inf)))
    return [(key, x / most) for key, x in shares.items()]


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Place pieces one by one, longest first, into the fullest sequence that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for n in range(capacity, 0, -1):
        for _ in range(int(counts[n])):
            room = next((r for r in range(n, capacity + 1) if by_room[r]), None)
            if room is None:
                bins.append([])
                room, at = capacity, len(bins) - 1
            else:
                at = by_room[room].pop()
            bins[at].append(n)
            by_room[room - n].append(at)
    return [tuple(b) for b in bins]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Configurations with whole numbers of sequences that hold exactly the pieces counted."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    made: list[tuple[tuple[int, ...], int]] = []
    phase = 0
    while phase < len(SLACK) or left.sum() > REST:
        if left.sum() <= 2 * THROUGH:
            break
        slack = SLACK[phase] if phase < len(SLACK) else capacity
        # fullest configurations first; each as often as its share says and the pieces allow
        for key, share in sorted(solve(left, capacity), key=lambda x: (-sum(x[0]), len(x[0]), -x[1], x[0])):
            used = np.bincount(key, minlength=len(left))
            n = min(int(np.ceil(share)), int((left[used > 0] // used[used > 0]).min()))
            if n > 0 and sum(key) >= capacity - slack:
                made.append((key, n))
                left -= used * n
        phase += 1
    rest: dict[tuple[int, ...], int] = {}
    for key in best_fit(left, capacity):
        rest[key] = rest.get(key, 0) + 1
    return made + list(rest.items())


def ranges(configurations: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Where the k-th piece of a length goes: length, ranks from and to, the sequence of the first, the offset in it."""
    taken: dict[int, int] = {}
    found, sequence = [], 0
    for key, n in configurations:
        offset = 0
        for length in key:
            first = taken.get(length, 0)
            found.append((length, first, first + n, sequence, offset))
            taken[length] = first + n
            offset += length
        sequence += n
    return found


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece of ``cut`` (see ``pieces``) a sequence and its offset there.

    ``cut`` is read several times and should be a written table. Pieces of full
    length have a sequence each (odd numbers) and take no part in the program.
    """
    spark = cut.sparkSession
    full = cut.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("row_id") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    short = cut.where(F.col("length") < capacity)
    by_task = stage(short.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length at most
        counts[r["length"]] = r["n"]
    slots = spark.createDataFrame(ranges(plan(counts, capacity)), "length long, low long, high long, sequence long, offset long")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    based = by_task.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # the slots that each task's pieces of a length fall into
    near = (
        based.join(slots, "length").where((F.col("low") < F.col("base") + F.col("n")) & (F.col("high") > F.col("base")))
        .groupBy("length", "task", "base")
        .agg(F.array_sort(F.collect_list(F.struct("low", "sequence", "offset"))).alias("slots"))
    )
    rank = F.col("base") + F.col("ordinal")
    slot = F.element_at("slots", F.size(F.filter("slots", lambda s: s["low"] <= rank)))
    packed = short.join(near, ["length", "task"]).withColumn("slot", slot).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        ((F.col("slot.sequence") + rank - F.col("slot.low")) * 2).alias("sequence_id"), F.col("slot.offset").alias("offset"),
    )
    return full.unionByName(packed)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(stage(pieces(tables.table(spark, sf_dir, "documents")), "pieces"))
