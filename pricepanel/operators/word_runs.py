"""The most frequent runs of words: hashes of runs from hashes of words, and texts of the survivors alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.operators.frequent import COUNTERS, summaries, top_by_summaries

#: Survivors that the tasks are sent as an array of 8 MB; with more, all runs are counted.
SENT = 1 << 20
#: Bytes of text whose words are held at once: about ten times as much in arrays.
PIECE = 4 << 20
#: Fixed odd factor by which the hashes of a run's words are combined.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The texts in slices of about `PIECE` bytes; a longer text is a slice of its own with what precedes it."""
    for batch in batches:
        texts = batch.column(0)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + PIECE)) + 1
            yield texts.slice(start, stop - start)
            start = stop


def runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """For each piece of texts: where runs start, their hashes, and the words of all its texts."""
    for piece in pieces(batches):
        lists = pc.split_pattern(piece, " ")
        words, text = pc.list_flatten(lists), pc.list_parent_indices(lists)
        some = pc.not_equal(words, "")
        words, text = words.filter(some), text.filter(some).to_numpy()
        starts = len(words) - n + 1
        if starts <= 0:
            continue
        coded = words.dictionary_encode()  # each distinct word of a piece is hashed once
        known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
        hashes = known[coded.indices.to_numpy()]
        at = np.flatnonzero(text[n - 1 :] == text[:starts])
        combined = hashes[at]
        for k in range(1, n):
            combined = combined * FACTOR + hashes[at + k]
        yield at, combined.view(np.int64), words


def _reader(n: int) -> Callable:
    return lambda batches: (hashes for _, hashes, _ in runs(batches, n))


def top_runs(texts: DataFrame, column: str, n: int, top: int, every: Callable[[], DataFrame], counters: int = COUNTERS) -> DataFrame:
    """The ``top`` runs of ``n`` words as (gram, count), ties by gram; ``every`` counts all runs where no bound holds.

    Words are split by spaces; ``texts`` is read twice. A task holds its summary and the words of one piece.
    """
    found = texts.select(column).filter(F.col(column).isNotNull())

    def count(survivors: DataFrame) -> DataFrame:
        if survivors.count() > SENT:
            return every()
        held = np.sort(np.array([r["hash"] for r in survivors.collect()], np.int64))

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not len(held):
                return
            for at, hashes, words in runs(batches, n):
                near = np.minimum(np.searchsorted(held, hashes), len(held) - 1)
                hits = at[held[near] == hashes]
                if len(hits):
                    taken = [words.take(pa.array(hits + k)) for k in range(n)]
                    counted = pc.binary_join_element_wise(*taken, " ").value_counts()
                    yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["gram", "count"])

        return found.mapInArrow(tally, "gram string, count long").groupBy("gram").agg(F.sum("count").alias("count"))

    return top_by_summaries(lambda size: summaries(found, size, _reader(n)), count, every, "gram", top, counters)
