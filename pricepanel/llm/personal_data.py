"""Personal data in whole texts: fixed forms, and spans that a trained tagger adds.

The tagger is a character-level bidirectional LSTM with CRF transitions. It learns from labelled spans: passages
around the fixed forms of a bounded sample of documents, as they stand and rewritten into every other way of writing
the same thing, with and without digits in an address, and from passages that hold none, with digits, or with the word
at. It takes at least ``STEPS`` steps, however few passages there are. Texts are cut into overlapping windows; the windows' tag scores are
averaged where they overlap, weighted towards each window's middle, and one best path is decoded for the whole
stretch, so that a span at a window's edge is found once and whole.

A span that ``plausible`` accepts holds a digit, an at sign, or another way of writing one ((at), [at], the word at)
with a dot form behind it. Windows that none of these reaches cannot hold a span and are not run; all other windows of
every text are, around an at form with one more on both sides, so that a span is scored there as in a run of all windows.
A span of the tagger that meets a fixed form gives way to it.

Defined results: null text is empty; rows with equal or null doc_id are rows of their own; an empty table, or a sample
without any span, adds nothing and gives the fixed forms alone; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.llm import tables
from pricepanel.llm.bilstm_crf import Tagger
from pricepanel.session import stage

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile("[0-9@]")
#: Longest e-mail that the tagger may add, and the place in it that every form has.
LONGEST = 80
AT = re.compile(rf"@|[( \[](?=(?:(?<=\()at\)|(?<=\[)at\]|(?<= )at ) ?\S{{1,{LONGEST}}}? ?(?:\.|\(dot\)|\[dot\]| dot ) ?\S)")
WINDOW, STRIDE = 96, 48
#: Passages with a digit or an at sign, and plain ones, for training at most.
SAMPLE = 1200
PLAIN = 300
#: Steps of training, each on ``BATCH`` rows, and passes over all rows at least.
STEPS, BATCH = 600, 64
EPOCHS = 2
#: Rows for training at least: passages, and their values in other forms and varied.
ROWS = 8000
PATHS = 4096

_SIGNS = "\n .@-+()_%:/,'\"=#"
_SIGN = np.full(128, 1, np.int64)
for _k, _c in enumerate(_SIGNS):
    _SIGN[ord(_c)] = 3 + _k
_SIGN[48:58] = 3 + len(_SIGNS)
_SIGN[97:123] = 4 + len(_SIGNS) + np.arange(26)
_SIGN[65:91] = _SIGN[97:123]
N_SIGNS = 4 + len(_SIGNS) + 26
N_TAGS = 1 + 2 * len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind, start and end of the fixed forms, by kind and start."""
    found = []
    if "@" in text:
        found += [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def signs_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _SIGN[np.minimum(codes, 127)], 2)


def stretches(text: str) -> list[tuple[int, int]]:
    """Runs of grid windows that may hold a span: starts and ends, which lie on the grid."""
    found: list[list[int]] = []
    places = [(m.start(), m.start()) for m in TRIGGER.finditer(text)]
    places += [(m.start() - LONGEST, m.start() + LONGEST) for m in AT.finditer(text)]
    for first, last in sorted(places):
        low = max(0, (first // STRIDE - 1) * STRIDE)
        high = min(-(-len(text) // STRIDE) * STRIDE, (last // STRIDE + 2) * STRIDE)
        if found and low <= found[-1][1]:
            found[-1][1] = max(high, found[-1][1])
        else:
            found.append([low, high])
    return [(a, b) for a, b in found]


def plausible(kind: int, value: str) -> bool:
    digits = len(re.sub("[^0-9]", "", value))
    if kind == 0:
        return bool(re.fullmatch(r"\S+ ?(@|\(at\)|\[at\]| at ) ?\S+( ?(\.|\(dot\)|\[dot\]| dot ) ?\S+)+", value)) and len(value) <= LONGEST
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}([ .:,()\[\]-]|dot){1,5}[0-9]{1,3}(([ .:,()\[\]-]|dot){1,5}[0-9]{1,3}){2}", value)) and all(int(x) <= 255 for x in re.findall("[0-9]+", value))
    if not re.fullmatch(r"[+(]?[0-9][0-9 ().\-/]*[0-9]", value):
        return False
    return 16 <= digits <= 19 and luhn(re.sub("[^0-9]", "", value)) if kind == 2 else 8 <= digits <= 15 and digits < len(value)


def tag_texts(tagger: Tagger | None, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans (kind, start, end) of each text."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if tagger is None:
        return found
    runs = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
    weights = 1 - np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2) / WINDOW
    runs.sort(key=lambda r: r[2] - r[1])
    lo = 0
    while lo < len(runs):
        # runs of similar length together, in groups of bounded size
        width, hi = runs[lo][2] - runs[lo][1], lo
        while hi < len(runs) and runs[hi][2] - runs[hi][1] <= max(2 * width, width + STRIDE) and (hi - lo + 1) * (runs[hi][2] - runs[hi][1]) <= PATHS * WINDOW:
            hi += 1
        hi = max(hi, lo + 1)
        group, lo = runs[lo:hi], hi
        width = max(max(b - a for _, a, b in group), WINDOW)
        signs = np.zeros((len(group), width), np.int64)
        lengths = np.zeros(len(group), np.int64)
        for k, (i, a, b) in enumerate(group):
            part = signs_of(texts[i][a:b])
            signs[k, : len(part)], lengths[k] = part, len(part)
        starts = np.arange(0, width - WINDOW + 1, STRIDE)
        total, weight = np.zeros((len(group), width, N_TAGS), np.float32), np.zeros((len(group), width, 1), np.float32)
        for s in starts:
            live = np.flatnonzero(lengths > s)
            if len(live):
                total[live, s : s + WINDOW] += tagger.emissions(signs[live, s : s + WINDOW]) * weights[None, :, None].astype(np.float32)
                weight[live, s : s + WINDOW] += weights[None, :, None].astype(np.float32)
        tags = tagger.decode(total / np.maximum(weight, 1e-6), lengths)
        for k, (i, a, _) in enumerate(group):
            row = tags[k, : lengths[k]]
            for s in np.flatnonzero((row % 2 == 1) & (row > 0)).tolist():
                kind, e = (int(row[s]) - 1) // 2, s + 1
                while e < len(row) and row[e] == row[s] + 1:
                    e += 1
                if plausible(kind, texts[i][a + s : a + e]):
                    found[i].append((kind, a + s, a + e))
    return found


def forms(kind: int, value: str) -> list[str]:
    """Other ways of writing a value of a fixed form."""
    digits = re.sub("[^0-9]", "", value)
    if kind == 0:
        name, _, host = value.partition("@")
        ways = ((" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", "."))
        found = [name + at + host.replace(".", dot) for at, dot in ways]
    elif kind == 1:
        found = [value.replace(".", dot) for dot in (" . ", "[.]", "-", " dot ")]
    elif kind == 2:
        found = [mark.join(digits[k : k + 4] for k in range(0, len(digits), 4)) for mark in " -./"]
    else:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        found = [f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"]
    return found


def varied(kind: int, value: str, words: list[str], rng: np.random.Generator) -> str:
    """A value of the same form: other digits, and in an address other words, fewer labels, or no digits."""
    if kind == 1:
        return ".".join(str(int(rng.integers(0, 256)) if rng.random() < 0.8 else int(rng.integers(0, 10))) for _ in range(4))
    if kind != 0:
        return re.sub("[0-9]", lambda _: str(int(rng.integers(0, 10))), value)
    other = lambda part: words[int(rng.integers(0, len(words)))] if words and rng.random() < 0.5 else part
    name, _, host = value.partition("@")
    labels = host.split(".")
    if len(labels) > 2 and rng.random() < 0.5:
        del labels[int(rng.integers(0, len(labels) - 1))]
    address = re.sub("[A-Za-z]+", lambda m: other(m[0]), name) + "@" + ".".join([*(other(x) for x in labels[:-1]), labels[-1]])
    signs = ("0123456789", "0123456789", "abcdefghijklmnopqrstuvwxyz", "")[int(rng.integers(0, 4))]
    address = re.sub("[0-9]", lambda _: signs[int(rng.integers(0, len(signs)))] if signs else "", address)
    return re.sub(r"(^|[.@])(?=[.@])", r"\1x", address)


def _placed(passage: str, start: int, end: int, kind: int, value: str, others: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The passage with ``value`` in place of a stretch, and its spans: the value's, and the others moved along."""
    by = len(value) - (end - start)
    return passage[:start] + value + passage[end:], [(k, a, b) if b <= start else (k, a + by, b + by) for k, a, b in others] + [(kind, start, start + len(value))]


def training_rows(passages: list[tuple[str, list[tuple[int, int, int]]]], rng: np.random.Generator) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The passages, each of their spans in every other form, and more of them with varied values up to ``ROWS``.

    Plain passages take values of every kind, or the word at before a full stop, which is none.
    """
    rows = list(passages)
    spans = [(p, s, [o for o in all_spans if o != s]) for p, all_spans in passages for s in all_spans]
    for passage, (kind, a, b), others in spans:
        rows += [_placed(passage, a, b, kind, value, others) for value in forms(kind, passage[a:b])]
    by_kind = [[p[a:b] for p, (kind, a, b), _ in spans if kind == want] for want in range(len(KINDS))]
    kinds = [k for k, values in enumerate(by_kind) if values]
    words = sorted({w.lower() for p, found in passages if not found for w in re.findall(r"\b[A-Za-z]{3,12}\b", p)})
    plain = [(p, gaps) for p, found in passages if not found and (gaps := [m.start() + 1 for m in re.finditer(" ", p[: WINDOW // 2])])]
    for passage, gaps in plain:
        gap = gaps[int(rng.integers(0, len(gaps)))]
        word = re.match(r"\S*", passage[gap:])[0]
        rows.append((f"{passage[:gap]}at {word}. {passage[gap:]}", []))
    while len(rows) < ROWS:
        kind = kinds[int(rng.integers(0, len(kinds)))]
        if plain and rng.random() < 0.5:
            passage, gaps = plain[int(rng.integers(0, len(plain)))]
            a = gaps[int(rng.integers(0, len(gaps)))]
            b, others = a + len(re.match(r"\S*", passage[a:])[0]), []
        else:
            passage, (kind, a, b), others = spans[int(rng.integers(0, len(spans)))]
        value = varied(kind, by_kind[kind][int(rng.integers(0, len(by_kind[kind])))], words, rng)
        ways = [value, *forms(kind, value)]
        rows.append(_placed(passage, a, b, kind, ways[int(rng.integers(0, len(ways)))], others))
    return rows


def labelled_passages(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Passages with their spans, those of smallest hash.

    At most ``sample`` lie around fixed forms and other digits; at most ``PLAIN`` begin a text and hold neither.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = fixed_spans(text)
                covered = np.zeros(len(text) + 1, bool)
                for _, a, b in spans:
                    covered[a:b] = True
                bare = [m.start() for m in TRIGGER.finditer(text) if not covered[m.start()]]
                places = [a for _, a, b in spans] + bare[:: max(1, len(bare) // 2)][:2]
                for place in places:
                    low = max(0, place - 20 - place % 41)
                    high = min(len(text), low + WINDOW)
                    inside = [(k, a - low, b - low) for k, a, b in spans if low <= a and b <= high]
                    if not any(low < b and a < high and not (low <= a and b <= high) for _, a, b in spans):
                        rows.append((text[low:high], [x for s in inside for x in s]))
                if not TRIGGER.search(text[:WINDOW]):
                    rows.append((text[:WINDOW], []))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["passage", "spans"])

    holding = docs.where(F.col("text").rlike("[0-9]{3}|@")).select("text")
    rows = stage(holding.mapInArrow(cut, "passage string, spans array<long>").distinct(), "passages")
    plain = ~F.col("passage").rlike("[0-9@]")
    found = tables.sampled(rows.where(~plain), sample) + tables.sampled(rows.where(plain), PLAIN)
    return [(r["passage"], [tuple(r["spans"][k : k + 3]) for k in range(0, len(r["spans"]), 3)]) for r in found]


def fit(passages: list[tuple[str, list[tuple[int, int, int]]]], epochs: int | None = None, seed: int = 0) -> Tagger | None:
    """Train a tagger on passages with spans, for ``STEPS`` steps if ``epochs`` is not stated; none if there is no span."""
    if not any(spans for _, spans in passages):
        return None
    rows = training_rows(passages, np.random.default_rng(seed))
    if epochs is None:
        epochs = max(EPOCHS, -(-STEPS * BATCH // len(rows)))
    signs, tags = np.zeros((len(rows), WINDOW), np.int64), np.zeros((len(rows), WINDOW), np.int64)
    for i, (passage, spans) in enumerate(rows):
        # the last span as whole as a window can hold it; spans that the window cuts are tagged as far as they go
        start, end = max(((a, b) for _, a, b in spans), key=lambda s: s[1], default=(0, 0))
        low = max(0, min(start, end - WINDOW))
        part = signs_of(passage[low : low + WINDOW])
        signs[i, : len(part)] = part
        for kind, a, b in spans:
            tags[i, max(a - low, 0) : max(b - low, 0)] = 2 + 2 * kind
            if a >= low:
                tags[i, a - low : a - low + 1] = 1 + 2 * kind
    tagger = Tagger.create(N_SIGNS, N_TAGS, seed)
    tagger.train(signs, tags, epochs, BATCH)
    return tagger


def spans_of(text: str, tagged: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The fixed spans, and the tagger's that meet none of them."""
    fixed = fixed_spans(text)
    taken = sorted((a, b) for _, a, b in fixed)
    return fixed, [(k, a, b) for k, a, b in tagged if not any(x < b and a < y for x, y in taken)]


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """One row per document: numbers of fixed forms, their digest, and all spans."""

    def written(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column("text").to_pylist()
                both = [spans_of(t, g) for t, g in zip(texts, tag_texts(tagger, texts))]
                base = [written(f) for f, _ in both]
                yield pa.record_batch([
                    part.column("doc_id"), *(pa.array([sum(k == kind for k, _, _ in f) for f, _ in both], pa.int64()) for kind in range(4)),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()), pa.array([written(f + m) for f, m in both], pa.string()),
                    pa.array([len(m) for _, m in both], pa.int64()),
                ], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = tables.texts(tables.table(spark, sf_dir, "documents"))
    return find(docs, fit(labelled_passages(docs)))
