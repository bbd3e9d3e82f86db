"""Words, lines and hashes of a batch of texts, computed on the UTF-8 bytes of an Arrow column.

All functions work on the bytes of many texts laid end to end, so that no step
runs per word in Python. Hashes are 64 bits wide: equal words give equal hashes,
and two different words of one batch meet by chance about once in 1e7 batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: space and U+0009 to U+000D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: A slice of a batch holds about this many bytes, or one longer text.
SLICE_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of the splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers that depend on ``seed`` only."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(steps) | np.uint64(1)


_BYTE_CODES = constants(256, 11)
_BYTE_CODES[SPACES] = 0
_WORD_CODES = constants(8, 23)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into slices of bounded text: the slice, its text bytes, and the offsets of its texts (null is empty)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > SLICE_BYTES:
            part = batch.slice(first, i - first)
            yield part, *utf8(part.column(column))
            first, held = i, 0
        held += int(size)
    if first < len(sizes):
        part = batch.slice(first)
        yield part, *utf8(part.column(column))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more entry at the end)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true positions; no run crosses from one text into the next."""
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, codes: np.ndarray = _BYTE_CODES) -> np.ndarray:
    """A hash of the bytes from each start up to the next one; bytes whose code is 0 do not count at the end."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = data[starts[0] :]
    starts = starts - starts[0]
    lengths = np.diff(starts, append=len(data))
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    places = np.arange(len(data), dtype=kind) - np.repeat(starts.astype(kind), lengths)
    with np.errstate(over="ignore"):
        terms = codes[data]
        terms *= constants(int(lengths.max()), 37)[places]
        return mix(np.add.reduceat(terms, starts))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each text (one more entry at the end)."""
    starts, ends = runs(~SPACES[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in order, and the index of the first word of each text (one more entry at the end)."""
    starts, _, first = words(data, offsets)
    return span_hashes(data, starts), first


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size``-word windows of one text; a shorter text gives one for all its words, none if it has none."""
    n = len(hashes)
    if not n:
        return hashes
    codes = _WORD_CODES if size <= len(_WORD_CODES) else constants(size, 23)
    width = min(size, n)
    with np.errstate(over="ignore"):
        total = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
        for k in range(width):
            total += hashes[k : n - width + 1 + k] * codes[k]
    return mix(total)
