"""Token ids of whole texts by a public tokenizer, with a cache of encoded words.

The word-level tokenizer drops white space and never joins two words, so a text's
ids are the ids of its words in order. A task therefore encodes each distinct word
once and assembles the ids of a slice of texts with array operations. Two more
rules hold for this tokenizer and shorten the list of distinct words: words of
Latin letters (U+0041 to U+00FF) may be lower-cased first, and a full stop or comma
after such a letter is a token of its own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pricepanel.llm import textbytes as tb

TOKENIZER = "word_bpe_49k.json"
#: A worker forgets its encoded words when it holds more than this many; they are then encoded anew.
CACHE_WORDS = 2_000_000

_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
#: The lead byte of U+00C0 to U+00FF, and the second bytes that make a letter of it (two of them are signs).
_LATIN = 0xC3
_LATIN_SECOND = np.zeros(256, dtype=bool)
_LATIN_SECOND[0x80:0xC0] = True
_LATIN_SECOND[[0x97, 0xB7]] = False
_MARKS = (ord("."), ord(","))


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed package of public tokenizers keeps a vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def letters_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to Latin letters, and the same bytes with those letters in lower case."""
    lead = data[:-1] == _LATIN
    lead &= _LATIN_SECOND[data[1:]]
    letter, lower = _ASCII_LETTER[data], tb.ASCII_LOWER[data]
    letter[:-1] |= lead
    letter[1:] |= lead
    second = lower[1:]
    second[lead & (second <= 0x9E)] += 0x20
    return letter, lower


class WordEncoder:
    """Encodes slices of texts; keeps the ids of words it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.word_end = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.word_end[i] = token.endswith("</w>")
        self.marks = {m: self._encode([chr(m)])[0][0] for m in _MARKS}
        self._forget()

    def _forget(self) -> None:
        # a large table and a small recent one, both sorted by hash, over one list of ids
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_letters(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of words of a-z: one call for all, cut where a token ends a word."""
        if not found:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        ids = np.concatenate([
            np.array(self.tokenizer.encode(b" ".join(found[i : i + 2000]).decode(), add_special_tokens=False).ids, dtype=self.dtype)
            for i in range(0, len(found), 2000)
        ])
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(found):
            raise ValueError("this tokenizer does not end each word with a token of its own")
        return ids, np.diff(ends, prepend=0)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the list of ids (-1: unknown) and length, for each hash."""
        place, length = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for known, offsets, lengths in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                place[hit], length[hit] = offsets[at[hit]], lengths[at[hit]]
        return place, length

    def _learn(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), self.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        offsets = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        large, recent = self.tables
        recent = tuple(np.concatenate(p) for p in zip(recent, (hashes, offsets, lengths)))
        if len(recent[0]) > 50_000 + len(large[0]) // 4:
            large, recent = tuple(np.concatenate(p) for p in zip(large, recent)), tuple(p[:0] for p in recent)
            order = np.argsort(large[0])
            large = tuple(p[order] for p in large)
        else:
            order = np.argsort(recent[0])
            recent = tuple(p[order] for p in recent)
        self.tables = [large, recent]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin (one more entry at the end)."""
        if len(self.tables[0][0]) + len(self.tables[1][0]) > CACHE_WORDS:
            self._forget()
        starts, ends, first = tb.words(data, offsets)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        letter, lower = letters_of(data)
        last = data[ends - 1]
        marked = ((last == _MARKS[0]) | (last == _MARKS[1])) & (ends - starts > 1) & letter[np.maximum(ends - 2, 0)]
        ends = ends - marked
        letters = np.add.reduceat(letter, starts, dtype=np.int32) == ends - starts
        data = np.where(np.repeat(np.append(False, letters), np.diff(starts, append=len(data), prepend=0)), lower, data)
        data[ends[marked]] = 32
        keys = tb.span_hashes(data, starts)
        order = np.argsort(keys)
        hashes = keys[order]
        change = np.append(True, hashes[1:] != hashes[:-1])
        hashes, where = hashes[change], order[change]
        back = np.empty(len(keys), np.int32)
        back[order] = np.cumsum(change, dtype=np.int32) - 1
        place, length = self._find(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            plain = letters[where[new]]
            raw = data.tobytes()
            s, e = starts[where[new]], ends[where[new]]
            ids, n = self._encode_letters([raw[a:b] for a, b in zip(s[plain], e[plain])])
            self._learn(hashes[new[plain]], ids, n)
            other = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(s[~plain], e[~plain])])
            flat = np.array([i for one in other for i in one], dtype=self.dtype)
            self._learn(hashes[new[~plain]], flat, np.array([len(one) for one in other], dtype=np.int64))
            place, length = self._find(hashes)
        place, length = place[back].astype(np.int32), length[back].astype(np.int32)
        counts = length + marked
        stops = np.cumsum(counts)
        begin = stops - counts
        # every word takes its ids and one more where a mark follows; the mark is then written over it
        step = np.arange(int(stops[-1]), dtype=np.int32)
        out = self.ids[np.minimum(np.repeat((place - begin).astype(np.int32), counts) + step, max(self.used - 1, 0))]
        for mark, i in self.marks.items():
            out[stops[marked & (last == mark)] - 1] = i
        return out, np.append(begin, stops[-1])[first]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process; it outlives a task, so that words are encoded once per worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encoded(batch: pa.RecordBatch, column: str, path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The slices of a batch with the ids of their texts and where each text's ids begin."""
    for part, data, offsets in tb.slices(batch, column):
        yield part, *encoder(path).encode(data, offsets)
