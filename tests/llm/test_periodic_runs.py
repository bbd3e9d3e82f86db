"""Runs found by seeds against a search over all periods and starts."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricepanel.llm import periodic_runs as pr

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """All maximal stretches of some period, kept where no smaller period fits the whole stretch."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            stretch = words[start : i + q]
            if len(stretch) >= max(24, 3 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.append((start, len(stretch), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = SPACES.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    dropped = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{l},{q}\n" for s, l, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def repetitive(seed, n):
    """Words with planted repeats of many periods, some inside others and some next to others."""
    rng = random.Random(seed)
    words = []
    while len(words) < n:
        block = [rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 31, 33, 40]))]
        if rng.random() < 0.4:
            block = block * rng.randint(2, 5) + [rng.choice("abcd") for _ in range(rng.randint(0, 3))]
        words += (block * 9)[: int(len(block) * rng.choice([1, 1.5, 2.9, 3, 3.4, 6]))]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    words = repetitive(seed, 150 + 10 * (seed % 20))
    assert pr.runs(pr.numbered([w.encode() for w in words])) == brute_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=36), st.integers(1, 8)), max_size=6))
def test_runs_of_two_words_equal_brute_force(blocks):
    words = [w for block, times in blocks for w in block * times]
    assert pr.runs(pr.numbered([w.encode() for w in words])) == brute_runs(words)


def test_long_periods_and_long_texts():
    rng = random.Random(4)
    block = [str(rng.randrange(50)) for _ in range(700)]
    words = [str(rng.randrange(50)) for _ in range(333)] + block * 3 + block[:10] + ["x"] * 20000 + ["y"]
    found = pr.runs(pr.numbered([w.encode() for w in words]))
    assert [r[2] for r in found] == [700, 1] and found[1] == (333 + 2110, 20000, 1)
    assert found[0][0] <= 333 and found[0][1] >= 2110


def test_shorter_turns_are_refused():
    with pytest.raises(ValueError):
        pr.runs(pr.numbered([b"a"] * 40), min_turns=2)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "long " * 30000), (None, "a b " * 20), (None, None), (6, "é\x1f \x85 " * 30)]


def test_query_columns_equal_brute_force(docs_of, monkeypatch):
    rows = [(i, t) for i, t in ODD if i != 5] + [(100 + k, "\n".join(repetitive(k, 90)) + (" é\x85" * 30 if k % 3 == 0 else "")) for k in range(120)]
    monkeypatch.setattr(pr.tables, "table", lambda *_: docs_of(*rows))
    found = [tuple(r) for r in pr.op12_periodic_runs(None, "").collect()]
    assert sorted(found, key=str) == sorted((expected(i, t) for i, t in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_operator_keeps_texts_without_runs_and_handles_odd_rows(docs_of):
    found = pr.periodic_runs(docs_of(*ODD)).collect()
    assert len(found) == len(ODD)
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by[1]["n_words"] == 0 and by[1]["collapsed"] == "" and by[2]["best"] is None and by[4]["collapsed"] == "word"
    assert by[5]["best"].asDict() == {"start": 0, "length": 30000, "period": 1} and by[5]["collapsed"] == "long"
    assert by[6]["collapsed"] == "é\x1f \x85"
    assert {(r["collapsed"], r["n_words"]) for r in found if r["doc_id"] is None} == {("a b", 40), ("", 0)}
    assert pr.periodic_runs(docs_of()).count() == 0
