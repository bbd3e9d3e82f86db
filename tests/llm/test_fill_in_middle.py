"""Fill-in-middle forms against plain string operations, and the way back."""

import hashlib
import re

import numpy as np
import pytest

from pricepanel.llm import fill_in_middle as fm
from pricepanel.llm import textbytes as tb

TEXTS = [
    None, "", "one line", "\n", "\n\n\n", "a\nb", "a\nb\n", "é\nüñ𝄞x\n東京\n\nlast 𝄞", "tail<", "<P", "holds <S> a mark\nline", "<M>", "x\r\ny\x0bz\x85\u2028w\n", "𝄞",
    "S>\n<\nP>\n<\nM>\n", "\n".join(f"line é{k}" for k in range(500)), "long " * 40000 + "\n" + "é" * 70000,
]


def expected(doc_id, text, unit, rate=100, back=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < back:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit, rate, back, seed", [("line", 100, 50, 7), ("char", 100, 50, 7), ("line", 40, 0, 3), ("char", 70, 100, 3)])
def test_forms_and_the_way_back(docs_of, unit, rate, back, seed):
    rows = [(17 * k + i, t) for k in range(8) for i, t in enumerate(TEXTS)] + [(None, "no\nid\nhere"), (5, "twice\nsaid"), (5, "twice\nsaid")]
    made = fm.with_restored(fm.fill_in_middle(docs_of(*rows), unit, rate, back, seed)).collect()
    key = lambda r: str(r[:1] + r[-1:])
    assert sorted((tuple(r)[:6] for r in made), key=key) == sorted((expected(i, t, unit, rate, back, seed) for i, t in rows), key=key)
    assert sorted((str(r["doc_id"]), r["restored"]) for r in made) == sorted((str(i), t or "") for i, t in rows)


def test_unknown_units_and_empty_tables(docs_of):
    assert fm.with_restored(fm.fill_in_middle(docs_of())).count() == 0
    with pytest.raises(ValueError):
        fm.fill_in_middle(docs_of(), "word")


def test_exception_index_records_multibyte_characters_only():
    texts = [t or "" for t in TEXTS]
    whole = "".join(texts)
    known = fm.Exceptions(np.frombuffer(whole.encode(), np.uint8))
    assert len(known.places) == sum(ord(c) > 127 for c in whole)
    bytes_before = np.concatenate([[0], np.cumsum([len(c.encode()) for c in whole])])
    points = np.arange(len(whole) + 1)
    assert (known.byte(points) == bytes_before).all() and (known.point(bytes_before) == points).all()
    assert len(fm.Exceptions(np.frombuffer(b"plain ascii", np.uint8)).places) == 0


def test_lines_of_a_slice():
    import pyarrow as pa

    data, offsets = tb.utf8(pa.array(TEXTS))
    _, first = fm.line_ends(data, offsets)
    assert np.diff(first).tolist() == [len(re.findall(r"[^\n]*\n|[^\n]+", t or "")) for t in TEXTS]
