"""Fill-in-middle form of texts: prefix, middle and suffix, with the suffix moved before the middle.

A text is cut at two of its units (lines or characters), drawn by a hash of seed and id, so a rerun cuts
alike. All work is done on the UTF-8 bytes of a batch. Code points and bytes are converted by a sparse index:
only the places of multibyte characters and their excess bytes, summed up, are recorded, and a cut is
looked up among them by binary search; where a text is ASCII the two counts are equal and nothing is stored.

Defined results: null and empty texts are plain, as are texts that hold one of the marks and the share of texts
that ``rate`` leaves as they are. A row without an id is drawn by the seed alone. Rows of equal id and text are
cut alike and all stay; an empty table gives no rows; other columns play no part. Every text can be rebuilt
from its output and form: marks do not occur in the text, and none can begin in one part and end in the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.llm import tables
from pricepanel.llm import textbytes as tb

SEED = 7
#: Percent of texts that are cut, and of those that begin with the suffix.
RATE = 100
SUFFIX_FIRST = 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


class Exceptions:
    """Where a batch's bytes hold multibyte characters, and how many bytes beyond one per character come before."""

    def __init__(self, data: np.ndarray):
        self.places = np.flatnonzero(data >= 0xC0)
        lead = data[self.places]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(extra)])
        #: the code points, counted over the whole batch, of the multibyte characters
        self.points = self.places - self.excess[:-1]

    def point(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte; every byte given begins a character or ends the data."""
        return byte - self.excess[np.searchsorted(self.places, byte)]

    def byte(self, point: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        return point + self.excess[np.searchsorted(self.points, point)]


def draws(seed: int, doc: int | None) -> tuple[int, ...]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def line_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte after each line, and the index of the first line of each text (one more entry at the end)."""
    last = offsets[1:][np.diff(offsets) > 0]
    ends = np.union1d(np.flatnonzero(data == 10) + 1, last)
    return ends, np.searchsorted(ends, offsets, "right")


def fill_in_middle(
    docs: DataFrame, unit: str = "line", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output."""
    if unit not in ("line", "char"):
        raise ValueError("unit must be line or char")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tb.slices(batch, "text"):
                yield rows(part, data, offsets)

    def rows(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        ids = part.column("doc_id").to_pylist()
        known = Exceptions(data)
        begin, end = offsets[:-1], offsets[1:]
        if unit == "line":
            ends, first = line_ends(data, offsets)
            n = np.diff(first)
        else:
            n = np.diff(known.point(offsets))
        drawn = np.array([draws(seed, i) for i in ids], np.int64).reshape(len(ids), 4)
        low, high = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1).T

        def byte_of(units: np.ndarray) -> np.ndarray:
            if unit == "char":
                return known.byte(known.point(begin) + units)
            place = np.maximum(first[:-1] + units - 1, 0)
            return np.where(units > 0, np.append(ends, 0)[np.minimum(place, len(ends))], begin)

        a, b = byte_of(low), byte_of(high)
        prefix, middle = known.point(a) - known.point(begin), known.point(b) - known.point(a)
        spm, drawn_plain = drawn[:, 3] % 100 < suffix_first, drawn[:, 2] % 100 >= rate
        forms, outputs = [], []
        raw = data.tobytes()
        for x, y, z, e, back, plain in zip(begin.tolist(), a.tolist(), b.tolist(), end.tolist(), spm.tolist(), drawn_plain.tolist()):
            whole = raw[x:e]
            if plain or x == e or any(mark in whole for mark in (PREFIX, SUFFIX, MIDDLE)):
                forms.append("plain")
                outputs.append(whole)
            elif back:
                forms.append("spm")
                outputs.append(b"".join([SUFFIX, raw[z:e], PREFIX, raw[x:y], MIDDLE, raw[y:z]]))
            else:
                forms.append("psm")
                outputs.append(b"".join([PREFIX, raw[x:y], SUFFIX, raw[z:e], MIDDLE, raw[y:z]]))
        none = np.array([f == "plain" for f in forms], bool)
        return pa.record_batch(
            [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(forms, pa.string()), pa.array(prefix.astype(np.int64), mask=none),
             pa.array(middle.astype(np.int64), mask=none), pa.array(outputs, pa.binary()).cast(pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    return tables.texts(docs, key=key, text=text).mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def original(output: str, form: str) -> str:
    """The text that gave an output of some form."""
    if form == "plain":
        return output
    first, second, third = (m.decode() for m in ((PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)))
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(third)
    return one + middle + two if form == "psm" else two + middle + one


def with_restored(formed: DataFrame) -> DataFrame:
    """With ``restored``: the text rebuilt from output and form alone."""
    names = formed.columns

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [original(o.as_py(), f.as_py()) for o, f in zip(batch.column("output"), batch.column("form"))]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*names, "restored"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formed.schema.fields)
    return formed.mapInArrow(rebuild, f"{kinds}, restored string")


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    formed = with_restored(fill_in_middle(tables.table(spark, sf_dir, "documents")))
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(F.col("restored"), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS z, CAST('0x' || h[25:32] AS BIGINT) % 100 AS w FROM cut),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS p, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS m,
         coalesce(array_to_string(u[greatest(x, y) + 1:], ''), '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR z >= 100 THEN 'plain'
              WHEN w < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
