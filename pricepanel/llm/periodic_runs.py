"""Runs of words that repeat with a period, found by seeds and extension along diagonals, and texts without the repeats.

A run is a stretch of words with smallest period q (words q apart are equal) and a length of at least
``max(MIN_LENGTH, MIN_TURNS * q)`` that no neighbouring word extends. In the matrix of a text against itself
it is a diagonal of lag q with at least ``max(MIN_LENGTH - q, (MIN_TURNS - 1) * q)`` equal words.

1. Lags fall into classes. In each class the k-gram is no longer than any run's diagonal there and no shorter
   than the longest lag: 16 words for lags of 1 to 15, then twice the least lag of 16 to 31, 32 to 63 and so on.
2. K-grams are numbered exactly: two k-grams of equal numbers, k apart, make one number of twice the length.
3. Each occurrence is paired with the next one of the same k-gram. Where a run of period q holds a k-gram of at
   least q words again, the next occurrence lies exactly q further on: a shorter lag would, with q, be a period of
   a stretch long enough to give the run a smaller period. So the next occurrences of every class
   give every run, and a word repeated n times costs n pairs, not n * n.
4. A seed is extended to both sides along its lag. A table of the furthest word covered on each lag skips
   all seeds inside what is extended already.

Time grows as n log n with the words of a text, memory as n; texts are independent, so nothing is shuffled.

Defined results: null and empty texts have no words and no runs; rows with equal ids are rows of their own;
an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.llm import tables

MIN_LENGTH = 24
MIN_TURNS = 3
#: Words of the shortest seed; lags below it form the first class.
SEED = 16
#: Words compared at once while a seed is extended; doubled with each step.
STEP = 64

Run = tuple[int, int, int]


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the grams of ``2 * size`` words from those of ``size`` words."""
    _, twice = np.unique(names[:-size] * (int(names.max()) + 1) + names[size:], return_inverse=True)
    return twice


def _agreeing(words: np.ndarray, left: int, right: int, towards: int) -> int:
    """How many words agree from the two places on, in the direction ``towards`` (1 or -1)."""
    total, step = 0, STEP
    while True:
        room = len(words) - right if towards > 0 else left + 1
        width = min(step, room)
        if width <= 0:
            return total
        if towards > 0:
            same = words[left : left + width] == words[right : right + width]
        else:
            same = (words[left - width + 1 : left + 1] == words[right - width + 1 : right + 1])[::-1]
        if not same.all():
            return total + int(same.argmin())
        total, left, right, step = total + width, left + towards * width, right + towards * width, 2 * step


def seeds(names: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose gram occurs next ``low`` to ``high`` words further on, and that lag; one for each unbroken diagonal."""
    order = np.argsort(names, kind="stable")
    at, lag = order[:-1], np.diff(order)
    good = (names[at] == names[order[1:]]) & (lag >= low) & (lag <= high)
    at, lag = at[good], lag[good]
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    first = np.append(True, (np.diff(at) != 1) | (np.diff(lag) != 0))[: len(at)]
    return at[first], lag[first]


def runs(words: np.ndarray, min_length: int = MIN_LENGTH, min_turns: int = MIN_TURNS) -> list[Run]:
    """Start, length and period of every run, by start and period."""
    n = len(words)
    if n < min_length:
        return []
    if min_turns < 3 or min_length < SEED + 8:
        raise ValueError("runs of fewer than three turns or 24 words are not sure to hold a seed")
    found: list[Run] = []
    covered: dict[int, int] = {}
    names, size, low = words, 1, 1
    while True:
        while size < (SEED if low == 1 else 2 * low):
            names, size = doubled(names, size), 2 * size
        if int(names.max()) + 1 == len(names):
            break  # no gram occurs twice, nor does any longer one
        high = 2 * low - 1 if low > 1 else SEED - 1
        for at, lag in zip(*(x.tolist() for x in seeds(names, low, high))):
            if covered.get(lag, -1) >= at:
                continue
            start = at - _agreeing(words, at - 1, at + lag - 1, -1)
            end = at + lag + _agreeing(words, at, at + lag, 1)
            covered[lag] = end - lag - 1
            if end - start >= max(min_length, min_turns * lag):
                found.append((start, end - start, lag))
        low = high + 1
        if min_turns * low > n:
            break  # and so k-grams of 2 * low words exist in every round
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeats(n: int, found: list[Run]) -> np.ndarray:
    """Whether a run contains each of the words after that run's first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def strongest(found: list[Run]) -> Run | None:
    """The run of greatest exact ratio of length to period; then the smallest start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def words_of(text: str | None) -> list[bytes]:
    """The words between spaces and U+0009 to U+000D, as UTF-8."""
    return (text or "").encode().split()


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length, period), ``best`` of them, and ``collapsed``: the text's words without repeats."""
    run = "struct<start:long,length:long,period:long>"
    struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_row = lambda r: dict(zip(("start", "length", "period"), r)) if r else None
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for doc, given in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = words_of(given.as_py())
                found = runs(numbered(words))
                if found:
                    gone = repeats(len(words), found)
                    kept = [w for w, drop in zip(words, gone.tolist()) if not drop]
                else:
                    kept = words
                collapsed = b" ".join(kept)
                held.append((doc, len(words), [as_row(r) for r in found], as_row(strongest(found)), collapsed))
                size += len(collapsed)
                if size > 1 << 24:
                    yield record(held)
                    held, size = [], 0
            if held:
                yield record(held)

    def record(held: list[tuple]) -> pa.RecordBatch:
        doc, n, found, best, collapsed = zip(*held)
        return pa.record_batch(
            [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.list_(struct)), pa.array(best, struct),
             pa.array(collapsed, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "best", "collapsed"],
        )

    return tables.texts(docs, key=key, text=text).mapInArrow(find, f"doc_id long, n_words long, runs array<{run}>, best {run}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of every tenth document by hash repeat from some word on with some period."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            marks = [None if i is None else zlib.crc32(str(i).encode()) for i in ids]
            texts = []
            for mark, given in zip(marks, batch.column("text")):
                if mark is None or mark % 10:
                    texts.append(given.as_py())
                    continue
                words = words_of(given.as_py())
                n, g = len(words), mark // 10
                if n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    words = words[:a] + [words[a + k % p] for k in range(n - a)]
                texts.append(b" ".join(words).decode())
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tables.texts(docs).mapInArrow(plant, "doc_id long, text string")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(tables.table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
