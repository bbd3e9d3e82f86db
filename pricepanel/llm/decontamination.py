"""Passages of documents within a small edit distance of benchmark items, by CGK embedding and bit sampling.

The CGK walk reads a string character by character and, at each of its steps, writes the character it
stands on and moves on or stays as a random function of step and character says. Strings of small edit
distance fall back into step after an edit, so their walks differ in few places: edit distance turns into
Hamming distance. Samples of a few places of the walk are the keys of a locality-sensitive hash; how
many samples are needed for the target recall follows from the agreement of the items' walks with walks of
randomly edited copies.

Per slice of texts, on lower-cased bytes with every run of other signs as one space:

1. The q-gram lemma says how many 10-grams a passage within the distance must share with its item. Places
   whose next item-sized stretch holds fewer 10-grams of the items cannot start one and are left out. The
   lemma is exact, so this loses nothing.
2. At every word start that is left, windows of each class of item sizes are walked, sampled and looked up
   among the items' samples.
3. Every meeting is verified by the exact edit distance of the item to the best passage around the window.

The items are sent to all tasks in blocks of bounded size, one pass over the documents for each block.
Recall: a passage is lost only if none of its samples agrees (at most 1 - ``RECALL`` at the largest distance,
never for exact copies).

Items of fewer than ``MIN_ITEM`` bytes after normalising are matched exactly, from word bound to word bound, by hashes
of their words and then their bytes.

Defined results: null texts and items are empty, and so are items without a letter or digit, which have no matches;
of several places of a short item the first one counts; equal items are matched each under its id; rows with equal or null
doc_id are matched each; empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.llm import tables
from pricepanel.llm import textbytes as tb

#: Largest edit distance as a share of an item's length.
RATE = 0.06
GRAM = 10
MIN_ITEM = 32
#: Windows start at word starts inside steps of this many bytes.
GRID = 16
#: Item sizes of one class differ by this factor at most.
CLASS_RATIO = 1.25
#: Sampled places for each key, the stretch of steps they come from, the walks they are spread over,
#: and the share of the largest-distance passages to find.
PLACES = 8
STRETCH = 24
WALKS = 2
RECALL = 0.97
MOST_SAMPLES = 256
#: Windows walked together.
WINDOWS = 20_000
#: Bytes of items that one pass over the documents carries.
BLOCK_BYTES = 8 << 20

_KEPT = np.full(256, 32, dtype=np.uint8)
_KEPT[48:58] = np.arange(48, 58)
_KEPT[65:91] = np.arange(97, 123)
_KEPT[97:123] = np.arange(97, 123)
_KEPT[128:] = np.arange(128, 256)
_GRAM_CODES = tb.constants(4, 71)
_HITS = "doc_id long, item_id long, distance int, start long, end long"


def normalized(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalized bytes of all texts, where each text begins in them, and the place in ``data`` of each byte."""
    plain = _KEPT[data]
    blank = plain == 32
    again = np.append(False, blank[:-1]) & blank
    edges = offsets[:-1]
    edges = edges[edges < len(data)]
    again[edges] = blank[edges]
    places = np.flatnonzero(~again)
    return plain[places], np.searchsorted(places, offsets), places


def normal_text(text: str) -> bytes:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return normalized(data, np.array([0, len(data)]))[0].tobytes().rstrip(b" ")


def gram_codes(data: np.ndarray) -> np.ndarray:
    """A code for each window of ``GRAM`` bytes, put together from windows of 2, 4 and 8."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        two = data.astype(np.uint64)
        two = two[:-1] + two[1:] * _GRAM_CODES[0]
        four = two[:-2] + two[2:] * _GRAM_CODES[1]
        eight = four[:-4] + four[4:] * _GRAM_CODES[2]
        return eight[:-2] + two[8:] * _GRAM_CODES[3]


def edits_allowed(length: int, rate: float = RATE) -> int:
    return int(rate * length)


def walk(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, moves: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What the walk writes at the given places, for each window [start, stop); 0 beyond its end."""
    at, wanted = starts.astype(np.int64).copy(), {int(p): k for k, p in enumerate(places)}
    out = np.zeros((len(starts), len(places)), np.uint8)
    for step in range(int(places[-1]) + 1 if len(places) else 0):
        sign = data[np.minimum(at, len(data) - 1)]
        sign = np.where(at < stops, sign, 0).astype(np.uint8)
        if step in wanted:
            out[:, wanted[step]] = sign
        at += moves[step][sign]
    return out


def _moves(steps: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2, (steps, 256), dtype=np.int8)


@dataclass
class SizeClass:
    """Items of similar length: how to sieve, walk and sample for them."""

    items: np.ndarray
    need: int
    width: int
    moves: list[np.ndarray]
    places: list[np.ndarray]
    samples: list[np.ndarray]
    known: list[np.ndarray]
    owners: list[np.ndarray]


@dataclass
class Index:
    ids: list[int | None]
    texts: list[bytes]
    grams: np.ndarray
    shift: int
    classes: list[SizeClass]
    rate: float
    own_grams: list[np.ndarray]
    #: Short items by their number of words: their sorted hashes, and the items of each.
    short: dict[int, tuple[np.ndarray, list[list[int]]]]


def _keys(signs: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """For each window and sample, the sampled signs as one number."""
    chosen = signs[:, samples].astype(np.uint64)
    weights = np.uint64(1) << (np.arange(samples.shape[1], dtype=np.uint64) * np.uint64(8))
    return (chosen * weights).sum(axis=2, dtype=np.uint64)


def _edited(text: bytes, edits: int, rng: np.random.Generator) -> bytes:
    out = bytearray(text)
    for _ in range(edits):
        at, kind = int(rng.integers(0, len(out))), int(rng.integers(0, 3))
        sign = out[int(rng.integers(0, len(out)))]
        if kind == 0:
            out[at] = sign
        elif kind == 1:
            out.insert(at, sign)
        else:
            del out[at]
    return bytes(out)


def build_index(items: list[tuple[int | None, str]], rate: float = RATE, recall: float = RECALL, seed: int = 7) -> Index:
    """The items of one block with their 10-grams and the samples of their walks."""
    plain = [(i, normal_text(t)) for i, t in items]
    kept = [(i, t) for i, t in plain if len(t) >= MIN_ITEM]
    brief = [(i, t) for i, t in ((i, t.strip(b" ")) for i, t in plain if len(t) < MIN_ITEM) if t]
    ids, texts = [i for i, _ in kept], [t for _, t in kept]
    codes = np.concatenate([*(gram_codes(np.frombuffer(t, np.uint8)) for t in texts), np.zeros(0, np.uint64)])
    bits = max(16, int(64 * max(1, len(codes)) - 1).bit_length())
    grams = np.zeros(1 << bits, dtype=bool)
    grams[(tb.mix(codes) >> np.uint64(64 - bits)).astype(np.int64)] = True
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    rng, classes = np.random.default_rng(seed), []
    left = np.sort(np.unique(lengths))
    while len(left):
        low = int(left[0])
        inside = np.flatnonzero((lengths >= low) & (lengths < max(low + 1, low * CLASS_RATIO)))
        left = left[left >= max(low + 1, low * CLASS_RATIO)]
        longest = int(lengths[inside].max())
        need = min(n - GRAM + 1 - GRAM * edits_allowed(n, rate) for n in lengths[inside].tolist())
        steps = int(1.6 * low)
        moves = [_moves(steps, seed * 1000 + 100 * w + len(classes)) for w in range(WALKS)]
        data = np.frombuffer(b"".join(texts[i] for i in inside), np.uint8)
        stops = np.cumsum(lengths[inside])
        every = np.arange(steps)
        # agreement of walks at the largest distance, measured on edited copies of items of this class
        trial = [texts[i] for i in inside[:64]]
        copies = [_edited(t, edits_allowed(len(t), rate), rng) for t in trial for _ in range(4)]
        first = np.repeat(np.arange(len(trial)), 4)
        flat, ends = np.frombuffer(b"".join(copies), np.uint8), np.cumsum([len(c) for c in copies])
        signs = walk(data, stops - lengths[inside], stops, moves[0], every)
        same = signs[first] == walk(flat, ends - np.array([len(c) for c in copies]), ends, moves[0], every)
        # a walk that is in step stays so for a while: a sample's chance is that of a whole stretch to agree,
        # and it differs from copy to copy, so the mean over copies decides
        run = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
        span = min(STRETCH, steps)
        chance = np.clip((run[:, span:] - run[:, :-span] == span).mean(axis=1), 0.0, 0.999)
        pools = chance.reshape(-1, 4).mean(axis=1)  # walks are independent: a copy's chance is near its item's mean
        count = WALKS
        while float(((1 - pools) ** count).mean()) > 1 - recall and count < MOST_SAMPLES:
            count += WALKS
        per_walk = count // WALKS
        places, samples, known, owners = [], [], [], []
        for w in range(WALKS):
            # stretches are spread evenly over the walk, so that edits in one part leave others
            bases = np.linspace(0, steps - span, per_walk + 1)[:-1] + rng.uniform(0, max(1, (steps - span) / per_walk))
            chosen = np.stack([int(min(b, steps - span)) + rng.choice(span, min(PLACES, span), replace=False) for b in bases])
            used, where = np.unique(chosen, return_inverse=True)
            keys = _keys(walk(data, stops - lengths[inside], stops, moves[w], used), where.reshape(chosen.shape))
            places.append(used)
            samples.append(where.reshape(chosen.shape))
            order = np.argsort(keys, axis=0, kind="stable")
            known.append(np.take_along_axis(keys, order, axis=0))
            owners.append(order)
        classes.append(SizeClass(inside, max(1, need), longest + edits_allowed(longest, rate), moves, places, samples, known, owners))
    own = [np.unique(gram_codes(np.frombuffer(t, np.uint8))) for t in texts]
    short = short_items([t for _, t in brief], len(texts))
    return Index(ids + [i for i, _ in brief], texts + [t for _, t in brief], grams, 64 - bits, classes, rate, own, short)


def short_items(texts: list[bytes], first: int) -> dict[int, tuple[np.ndarray, list[list[int]]]]:
    """Items by their number of words, as sorted hashes with the items of each; items are numbered from ``first`` on."""
    owners: dict[int, dict[int, list[int]]] = {}
    for k, text in enumerate(texts):
        hashes, _ = tb.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        owners.setdefault(len(hashes), {}).setdefault(int(tb.shingle_hashes(hashes, len(hashes))[0]), []).append(first + k)
    return {n: (np.array(sorted(of), np.uint64), [of[h] for h in sorted(of)]) for n, of in owners.items()}


def short_passages(index: Index, plain: np.ndarray, begins: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The first exact place of each short item in each text, as ``passages`` gives them."""
    found: list[tuple[int, int, int, int, int]] = []
    if not index.short:
        return found
    starts, ends, _ = tb.words(plain, begins)
    hashes, text_of = tb.span_hashes(plain, starts), np.searchsorted(begins, starts, side="right") - 1
    for n, (known, owners) in index.short.items():
        if len(hashes) < n:
            continue
        keys = tb.shingle_hashes(hashes, n)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = np.flatnonzero((known[at] == keys) & (text_of[: len(keys)] == text_of[n - 1 :]))
        _, one = np.unique(np.stack([text_of[hit], at[hit]]), axis=1, return_index=True)
        for k in hit[one].tolist():
            a, b = int(starts[k]), int(ends[k + n - 1])
            value = plain[a:b].tobytes()
            found += [(int(text_of[k]), item, 0, int(places[a]), int(places[b - 1]) + 1) for item in owners[int(at[k])] if index.texts[item] == value]
    return found


def meetings(found: SizeClass, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Pairs (window, item) of which some sample agrees, as rows of two numbers."""
    pairs = []
    for w in range(len(found.moves)):
        keys = _keys(walk(data, starts, stops, found.moves[w], found.places[w]), found.samples[w])
        for r in range(keys.shape[1]):
            known = found.known[w][:, r]
            low, high = np.searchsorted(known, keys[:, r]), np.searchsorted(known, keys[:, r], side="right")
            hit = np.flatnonzero(high > low)
            if len(hit):
                size = high[hit] - low[hit]
                step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                pairs.append(np.stack([np.repeat(hit, size), found.items[found.owners[w][np.repeat(low[hit], size) + step, r]]], axis=1))
    return np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)


def best_passage(item: bytes, text: bytes) -> tuple[int, int, int]:
    """Least edit distance of the item to a stretch of the text, with the stretch's start and end (bit-parallel)."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)

    def end_of(pattern: bytes, stretch: bytes, free: bool) -> tuple[int, int]:
        n, full = len(pattern), (1 << len(pattern)) - 1
        masks: dict[int, int] = {}
        for k, c in enumerate(pattern):
            masks[c] = masks.get(c, 0) | 1 << k
        up, down, score, best, where, top = full, 0, n, n, 0, 1 << (n - 1)
        for j, c in enumerate(stretch):
            eq = masks.get(c, 0)
            x = eq | down
            d = ((((x & up) + up) ^ up) | x) & full
            right_up, right_down = (down | ~(d | up)) & full, d & up
            score += bool(right_up & top) - bool(right_down & top)
            right_up, right_down = (right_up << 1) & full, (right_down << 1) & full
            if not free:
                right_up |= 1
            up, down = (right_down | ~(d | right_up)) & full, d & right_up
            if score < best:
                best, where = score, j + 1
        return best, where

    distance, stop = end_of(item, text, True)
    # read backwards from the end, the same distance gives the start
    _, back = end_of(item[::-1], text[:stop][::-1], False)
    return distance, stop - back, stop


def passages(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Text, item, distance, and first and last byte (end exclusive) in ``data`` of each passage found; best one per item."""
    if not len(data) or not index.classes and not index.short:
        return []
    plain, begins, places = normalized(data, offsets)
    found = short_passages(index, plain, begins, places)
    if not index.classes or len(plain) < GRAM:
        return found
    codes = gram_codes(plain)
    held = index.grams[(tb.mix(codes) >> np.uint64(index.shift)).astype(np.int64)]
    before = np.append(0, np.cumsum(held, dtype=np.int32))
    grid = np.arange(0, len(plain), GRID)
    word = np.append(True, plain[:-1] == 32) & (plain != 32)
    word[begins[:-1][begins[:-1] < len(plain)]] = True
    starts = np.flatnonzero(word)
    text_of = np.searchsorted(begins, starts, side="right") - 1
    regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for one in index.classes:
        last = np.minimum(grid + GRID + one.width, len(held))
        alive = before[last] - before[np.minimum(grid, len(held))] >= one.need
        here = np.flatnonzero(alive[starts // GRID])
        for lo in range(0, len(here), WINDOWS):
            chosen = here[lo : lo + WINDOWS]
            stops = begins[text_of[chosen] + 1]
            for k, item in meetings(one, plain, starts[chosen], stops).tolist():
                text, s = int(text_of[chosen[k]]), int(starts[chosen[k]])
                size = len(index.texts[item])
                edits = edits_allowed(size, index.rate)
                regions.setdefault((text, item), []).append((max(int(begins[text]), s - edits), min(int(stops[k]), s + size + 2 * edits)))
    raw = plain.tobytes() if regions else b""
    for (text, item), spans in regions.items():
        pattern, best = index.texts[item], None
        edits = edits_allowed(len(pattern), index.rate)
        merged: list[list[int]] = []
        for low, high in sorted(spans):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(high, merged[-1][1])
            else:
                merged.append([low, high])
        for low, high in merged:
            # the lemma once more, now for this item alone
            shared = np.isin(codes[low : max(low, high - GRAM + 1)], index.own_grams[item]).sum()
            if shared < len(pattern) - GRAM + 1 - GRAM * edits or best and best[2] == 0:
                continue
            distance, a, b = best_passage(pattern, raw[low:high])
            if distance <= edits and (best is None or distance < best[2]):
                best = (text, item, distance, int(places[low + a]), int(places[low + b - 1]) + 1)
        if best:
            found.append(best)
    return found


def indexes(benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> Iterator[Index]:
    """The benchmark in blocks of bounded size, one index each; an empty benchmark gives one without items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        yield build_index([(r["item_id"], r["text"]) for r in part.collect()], rate, recall)


def _search(documents: DataFrame, index: Index) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in tb.slices(batch, "text"):
                hits = passages(index, data, offsets)
                points = np.append(0, np.cumsum((data & 0xC0) != 0x80)) if hits else None
                rows = [
                    (piece.column("doc_id")[t].as_py(), index.ids[i], d, int(points[a] - points[offsets[t]]), int(points[b] - points[offsets[t]]))
                    for t, i, d, a, b in hits
                ]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "distance", "start", "end"])

    return documents.mapInArrow(search, _HITS)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, start and end (code points of the text)."""
    documents = tables.texts(docs)
    found = [_search(documents, index) for index in indexes(benchmark, rate, recall)]
    return reduce(DataFrame.unionByName, found)


def _without(docs: DataFrame, index: Index) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in tb.slices(batch, "text"):
                hit = {h[0] for h in passages(index, data, offsets)}
                yield piece.take(pa.array([k for k in range(piece.num_rows) if k not in hit], pa.int64())) if hit else piece

    return docs.mapInArrow(keep, docs.schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item was found, with all their columns; rows are judged each by its own text."""
    return reduce(_without, indexes(benchmark), docs)


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "benchmark"))
