"""Quality scores by Bradley-Terry ranking of pairs of texts.

Each pair of a good and a bad labelled text says that the good one wins. The chance of that is
modelled as the logistic function of the difference of two scores, a score being a weighted sum
of features of the text; the weights come from the logistic loss on feature differences. The
threshold is a quantile of the training scores, and a published score is the logistic function of
the distance to it, so that the threshold stands at 0.7.

Features are counted over whole texts in one pass and written out; labels meet only these small rows.
Training uses every distinct labelled row and every pair of a good and a bad one. A pair's loss depends on the
two scores alone, so each Newton step reduces the rows to counts, sums and products of features by label and cell of
score; the loss between cells is expanded about their mean scores, with its first-order term. At most ``2 * CELLS``
such rows reach the driver, whatever the number of texts. The threshold is found over all scores in order.

Defined results: null text is empty; empty texts have features of zero and get a score like any other; rows with
equal doc_id are scored each; a null doc_id is never held out; labels other than 0 and 1 are ignored; without labels of
both kinds every text scores 0.7; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.llm import tables
from pricepanel.llm import textbytes as tb
from pricepanel.session import stage

#: Cells of score of one label at most, and their least width.
CELLS = 2048
WIDTH = 1 / 64
#: Distinct scores that one task may sort.
CELL_ROWS = 1_000_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
RIDGE = 1e-3
#: Standardised features are cut off here.
FAR = 8
#: Newton steps end when no weight moves by more, or after so many.
STILL = 1e-6
MOST_STEPS = 40

FEATURES = (
    "capitals", "digits", "symbols", "bars", "exclamations", "stops", "other_marks", "repeats", "distinct", "word_length", "long_words", "line_length",
    "repeated_lines", "size",
)
_CLASSES = {
    "capital": np.arange(65, 91), "small": np.arange(97, 123), "digit": np.arange(48, 58), "symbol": np.frombuffer(b"#*$%&<>@^~\\{}=+_", np.uint8),
    "bar": np.frombuffer(b"|", np.uint8), "exclamation": np.frombuffer(b"!", np.uint8), "stop": np.frombuffer(b".,;:?", np.uint8),
    "mark": np.frombuffer(b"\"'()[]/-`", np.uint8), "line": np.frombuffer(b"\n", np.uint8), "head": np.array([*range(0xC0, 0x100)]),
}
_LINE_CODES = tb.constants(256, 5)


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive bounds."""
    return np.diff(np.append(0, np.cumsum(flags))[bounds])


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The features of each text of a slice, one row each."""
    n = {}
    for name, members in _CLASSES.items():
        table = np.zeros(256, dtype=bool)
        table[members] = True
        n[name] = _per_text(table[data], offsets).astype(np.float64)
    starts, ends, first = tb.words(data, offsets)
    hashes = tb.span_hashes(data, starts)
    total = np.diff(first).astype(np.float64)
    same = np.append(False, hashes[1:] == hashes[:-1])
    same[first[:-1][first[:-1] < len(same)]] = False
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:])], dtype=np.float64)
    length = ends - starts
    line_starts, _ = tb.runs(data != 10, offsets)
    lines = tb.span_hashes(data, line_starts, _LINE_CODES)
    line_first = np.searchsorted(line_starts, offsets)
    n_lines = np.diff(line_first).astype(np.float64)
    distinct_lines = np.array([len(np.unique(lines[a:b])) for a, b in zip(line_first[:-1], line_first[1:])], dtype=np.float64)
    words, letters = np.maximum(total, 1), np.maximum(n["capital"] + n["small"] + n["head"], 1)
    chars = np.maximum(_per_text((data & 0xC0) != 0x80, offsets), 1)
    return np.stack([
        n["capital"] / letters, n["digit"] / chars, np.minimum(n["symbol"] / words, 4), np.minimum(n["bar"] / words, 2), np.minimum(n["exclamation"] / words, 2),
        np.minimum(n["stop"] / words, 1), np.minimum(n["mark"] / words, 1), _per_text(same, first) / words, distinct / words,
        np.minimum(_per_text(length, first) / words / 10, 3), _per_text(length > 20, first) / words, np.log1p(total / np.maximum(n_lines, 1)) / 5,
        (n_lines - distinct_lines) / np.maximum(n_lines, 1), np.log1p(np.minimum(total, 200)) / 5,
    ], axis=1) * (total > 0)[:, None]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and features (an array in the order of ``FEATURES``) of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tb.slices(batch, "text"):
                found = text_features(data, offsets)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(FEATURES), pa.int32()), pa.array(found.ravel()))
                yield pa.record_batch([part.column("doc_id"), values], ["doc_id", "features"])

    return tables.texts(docs).mapInArrow(rows, "doc_id long, features array<double>")


@dataclass
class Ranking:
    """Weights on standardised features, and the line from raw score to published score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    level: float
    slope: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -FAR, FAR)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.threshold) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))


def _added(rows: DataFrame, parts) -> dict[int, np.ndarray]:
    """Sums by slot of the vectors that ``parts`` gives for a batch (slots, one vector each); the driver gets one row a slot.

    Partial sums are added in the order of their tasks, so a run repeats to the last bit.
    """

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for slot, vector in zip(*parts(batch)):
                    total[int(slot)] = total[int(slot)] + vector if int(slot) in total else vector
        if total:
            yield pa.record_batch([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["slot", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, total = None, None
        for batch in batches:
            vectors = batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, -1)
            for found, vector in zip(batch.column("slot").to_pylist(), vectors):
                if found != slot and slot is not None:
                    yield pa.record_batch([pa.array([slot]), pa.array([total.tolist()])], ["slot", "sums"])
                slot, total = found, vector if found != slot else total + vector
        if slot is not None:
            yield pa.record_batch([pa.array([slot]), pa.array([total.tolist()])], ["slot", "sums"])

    partial = rows.mapInArrow(reduce_rows, "slot long, sums array<double>").withColumn("task", F.spark_partition_id())
    dealt = partial.repartition("slot").sortWithinPartitions("slot", "task").select("slot", "sums")
    return {r["slot"]: np.array(r["sums"]) for r in dealt.mapInArrow(add, "slot long, sums array<double>").collect()}


def _moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each label: its rows, then the sums and the squares of the features."""

    def parts(batch: pa.RecordBatch):
        x, y = _matrix(batch), batch.column("quality").to_numpy()
        kinds = np.unique(y)
        return kinds, [np.concatenate([[(y == k).sum()], x[y == k].sum(axis=0), (x[y == k] ** 2).sum(axis=0)]) for k in kinds]

    return _added(rows, parts)


def _cells(rows: DataFrame, ranking: Ranking) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For label 0 and 1: counts, sums and products of standardised features, by cell of score."""
    width = max(WIDTH, 2 * FAR * float(np.abs(ranking.weights).sum()) / (CELLS - 2))
    n = len(FEATURES)

    def parts(batch: pa.RecordBatch):
        z = ranking.standard(_matrix(batch))
        slot = np.floor(z @ ranking.weights / width).astype(np.int64) * 2 + batch.column("quality").to_numpy()
        order = np.argsort(slot, kind="stable")
        slots, first = np.unique(slot[order], return_index=True)
        blocks = np.split(z[order], first[1:])
        return slots, [np.concatenate([[len(block)], block.sum(axis=0), (block.T @ block).ravel()]) for block in blocks]

    found = _added(rows, parts)
    both = [np.array([found[s] for s in sorted(found) if s % 2 == y]) for y in (0, 1)]
    return [(t[:, 0], t[:, 1 : 1 + n], t[:, 1 + n :].reshape(-1, n, n)) for t in both]


def _newton(bad, good, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature at ``w`` of the mean logistic loss over all pairs of a good and a bad row."""
    (m, lost, lost2), (n, won, won2) = bad, good
    low, high = lost @ w / m, won @ w / n
    p = 1 / (1 + np.exp(np.clip(high[:, None] - low, -500, 500)))  # chance that the bad one wins
    q = p * (1 - p)
    pull, push = q @ m, n @ q
    # sums of features times the distance from the cell's mean score
    won_slope, lost_slope = won2 @ w - high[:, None] * won, lost2 @ w - low[:, None] * lost
    up = (p @ m) @ won - pull @ won_slope
    down = (n @ p) @ lost + push @ lost_slope
    cross = won.T @ q @ lost
    curve = np.tensordot(pull, won2, 1) + np.tensordot(push, lost2, 1) - cross - cross.T
    pairs = n.sum() * m.sum()
    return (down - up) / pairs + RIDGE * w, curve / pairs + RIDGE * np.eye(len(w))


def _best_cut(rows: DataFrame, ranking: Ranking, bad: float, good: float) -> tuple[float, float]:
    """The quantile of all scores with the best balance of bad rows caught and good ones lost, in the middle of its gap; its level."""

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(ranking.raw(_matrix(batch)) + 0.0), batch.column("quality")], ["raw", "quality"])

    known = rows.mapInArrow(raws, "raw double, quality int")
    counted = known.groupBy("raw").agg(F.sum(1 - F.col("quality")).alias("bad"), F.sum("quality").alias("good"))
    parts = int((bad + good) // CELL_ROWS) + 1
    ranged = stage(counted.repartitionByRange(parts, "raw").withColumn("part", F.spark_partition_id()), "raws")
    upward, inside = Window.orderBy("part"), Window.partitionBy("part").orderBy("raw")  # one row for each part; a part's scores
    sizes = ranged.groupBy("part").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    lower = sizes.select("part", *[(F.sum(c).over(upward) - F.col(c)).alias(f"lower_{c}") for c in ("bad", "good")])
    upto = ranged.join(lower, "part").select("raw", *[(F.sum(c).over(inside) + F.col(f"lower_{c}")).alias(c) for c in ("bad", "good")])
    balance = F.col("bad") / F.lit(bad) - F.col("good") / F.lit(good)
    best = upto.withColumn("balance", balance).orderBy(F.desc("balance"), "raw").limit(1).first()
    if best["balance"] <= 0:
        return float(ranged.agg(F.min("raw")).first()[0]), 0.0
    above = ranged.where(F.col("raw") > best["raw"]).agg(F.min("raw")).first()[0]
    return float((best["raw"] + (best["raw"] if above is None else above)) / 2), (best["bad"] + best["good"]) / (bad + good)


def fit(rows: DataFrame) -> Ranking:
    """Learn from all rows of features and quality 0/1; ``rows`` is a written table."""
    width, found = len(FEATURES), _moments(rows)
    if len(found) < 2:
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.0, 1.0)
    total, (bad, good) = found[0] + found[1], (float(found[y][0]) for y in (0, 1))
    mean = total[1 : 1 + width] / total[0]
    scale = np.sqrt(np.maximum(total[1 + width :] / total[0] - mean**2, 0))
    ranking = Ranking(mean, np.where(scale > 1e-7, scale, 1.0), np.zeros(width), 0.0, 0.0, 1.0)
    for _ in range(MOST_STEPS):
        cells = _cells(rows, ranking)
        step = np.linalg.solve(*reversed(_newton(*cells, ranking.weights)))
        ranking.weights = ranking.weights - step
        if np.abs(step).max() < STILL:
            break
    w = ranking.weights
    first = sum(cell[1].sum(axis=0) for cell in cells) @ w / total[0]
    second = w @ sum(cell[2].sum(axis=0) for cell in cells) @ w / total[0]
    spread = float(np.sqrt(max(second - first**2, 0))) or 1.0
    ranking.threshold, ranking.level = _best_cut(rows, ranking, bad, good)
    ranking.slope = 4 / spread
    return ranking


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def learnt(labels: DataFrame) -> DataFrame:
    """doc_id and quality of the labels that training may use."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return known.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))


def train(found: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on all distinct labelled rows outside the held-out fold; ``found`` is a table of features."""
    known = found.join(learnt(labels), "doc_id").distinct()
    return fit(stage(known.sortWithinPartitions("doc_id", "quality", "features"), "labelled"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    found = stage(features(docs), "features")
    ranking = train(found, labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(ranking.score(_matrix(batch)))], ["doc_id", "score"])

    return found.mapInArrow(rows, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the ranking accepts, with all their columns; rows are judged each by its own text.

    Texts are not shuffled to meet the labels: features are counted once for training and once more where a text is judged.
    """
    ranking = train(stage(features(docs), "features"), labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tb.slices(batch, "text"):
                yield part.filter(pa.array(ranking.score(text_features(data, offsets)) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def op10_quality_ranking(spark, sf_dir: str) -> DataFrame:
    return scored(tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels"))
