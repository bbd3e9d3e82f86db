"""Links between vectors of one label by collision counting on sorted projections, and the groups that they form.

1. Vectors of a label with equal components form one class and go on as one point with a weight.
2. The points of a label are dealt to blocks by hash, and pairs of blocks to tiles, so that every pair
   of points of a label meets in one tile and a tile holds two blocks at most.
3. In a tile, ``PROJECTIONS`` Gaussian projections of the points are sorted. The window of a query is a
   range of ranks around its own value. Each rank has a bitmap of the points before it, so the points of
   a window are the difference of two bitmaps, and bit-sliced counters add the windows of all projections.
4. For a pair at distance d a projected difference is normal with deviation d, so a pair at the threshold
   falls into a window of ``WINDOW`` deviations with a known chance. The count that a pair must reach is the
   largest one that such a pair reaches with a chance of ``RECALL`` at least; nearer pairs reach it more often.
5. Pairs that pass are verified by their cosine in double precision.

A tile gives the weighted number of links of each point and a spanning forest of its links, never all pairs
of a group; `components` joins the forests. All pairs of a label are counted, so time grows with the square
of a label's distinct vectors; one-dimensional windows cannot give less at this recall, since
about as many collisions as pairs are needed. The rows sent to tiles grow as n * n / BLOCK for a label of n.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, and a vector
without a label, links with nothing. Vectors of different lengths are not compared. Rows with
equal ids are rows of their own, and a copy counts as a link. A group is named by its smallest non-null id (null
if it has none); a row is kept if its id names its group. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricepanel.llm import tables
from pricepanel.llm.components import components
from pricepanel.llm.textbytes import constants, mix
from pricepanel.session import stage

COSINE = 0.93
#: Number of projections; at most 31, so that a count has five bits.
PROJECTIONS = 31
#: Half width of a window in deviations of a pair at the threshold.
WINDOW = 1.8
#: Least chance that a pair at the threshold passes the count.
RECALL = 0.9999
#: Points of a block (a task holds two), and of the parts in which a tile is worked through.
BLOCK = 16384
QUERIES = 512
POINTS = 2048
#: Above this share of candidates in a part, its cosines are taken as one matrix product.
DENSE = 0.03

_CLASS = ["label", "dim", "h1", "h2"]


def least_count(projections: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count of windows that a pair at the threshold reaches with at least the chance ``recall``."""
    inside = math.erf(window / math.sqrt(2))
    chance, count = 0.0, projections + 1
    while chance < recall and count:
        count -= 1
        chance += math.comb(projections, count) * inside**count * (1 - inside) ** (projections - count)
    return count


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, projections))


class Prefixes:
    """Sorted projections of some points, with the bitmap of the points before each rank."""

    def __init__(self, projected: np.ndarray):
        self.n = projected.shape[1]
        order = np.argsort(projected, axis=1)
        self.values = np.take_along_axis(projected, order, axis=1)
        words = -(-self.n // 64)
        self.before = np.zeros((len(projected), self.n + 1, words), np.uint64)
        rank = np.arange(1, self.n + 1)
        for table, at in zip(self.before, order):
            table[rank, at >> 6] = np.uint64(1) << (at & 63).astype(np.uint64)
            np.bitwise_or.accumulate(table, axis=0, out=table)

    def colliding(self, queries: np.ndarray, radius: float, least: int) -> np.ndarray:
        """Bitmaps of the points that lie in at least ``least`` of each query's windows."""
        planes: list[list[np.ndarray]] = [[] for _ in range(int(len(queries)).bit_length() + 1)]

        def add(bits: np.ndarray, weight: int) -> None:
            planes[weight].append(bits)
            if len(planes[weight]) == 3:  # a full adder: the sum stays, the carry weighs twice as much
                a, b, c = planes[weight]
                either = a ^ b
                planes[weight] = [either ^ c]
                add((a & b) | (c & either), weight + 1)

        for values, before, centre in zip(self.values, self.before, queries):
            low, high = np.searchsorted(values, centre - radius), np.searchsorted(values, centre + radius, "right")
            add(before[high] ^ before[low], 0)
        reached = np.full((queries.shape[1], self.before.shape[2]), ~np.uint64(0))
        for weight in range(len(planes)):
            if len(planes[weight]) == 2:
                a, b = planes[weight]
                planes[weight] = [a ^ b]
                add(a & b, weight + 1)
            bits = planes[weight][0] if planes[weight] else np.zeros_like(reached)
            reached = bits & reached if least >> weight & 1 else bits | reached
        return reached


class Forest:
    """Groups of a tile's points as links come in, and the links that joined two groups."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[np.ndarray] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            new = ra != rb
            if not new.any():
                return
            a, b = a[new], b[new]
            high, low = np.maximum(ra[new], rb[new]), np.minimum(ra[new], rb[new])
            # each root takes one link to a smaller root, so no two of them close a circle
            high, one = np.unique(high, return_index=True)
            self.links.append(np.stack([a[one], b[one]]))
            to = np.arange(len(self.root))
            to[high] = low[one]
            while (to[to] != to).any():
                to = to[to]
            self.root = to[self.root]


def _verified(x: np.ndarray, y: np.ndarray, bits: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y whose pairs the bitmaps allow and whose cosine reaches the threshold."""
    if int(np.bitwise_count(bits).sum()) > DENSE * len(x) * len(y):
        allowed = np.unpackbits(bits.view(np.uint8), axis=1, count=len(y), bitorder="little").view(bool)
        return np.nonzero(allowed & (x @ y.T >= cosine))
    row, word = np.nonzero(bits)
    which, bit = np.nonzero(np.unpackbits(bits[row, word][:, None].view(np.uint8), axis=1, bitorder="little"))
    i, j = row[which], word[which] * 64 + bit
    near = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
    return i[near], j[near]


def tile_links(units: np.ndarray, weight: np.ndarray, split: int, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """The weighted number of links of each point, and a spanning forest of the links as a pair of rows.

    The first ``split`` points are compared with the rest; where there is no rest, with each other.
    """
    n = len(units)
    radius, least = WINDOW * math.sqrt(max(2 - 2 * cosine, 0.0)), least_count()
    projected = np.ascontiguousarray((units @ directions(units.shape[1])).T)
    within = split == n
    counts, forest = np.zeros(n, np.int64), Forest(n)
    for start in range(0 if within else split, n, POINTS):
        stop = min(start + POINTS, n)
        sorted_points = Prefixes(projected[:, start:stop])
        for first in range(0, stop if within else split, QUERIES):
            last = min(first + QUERIES, stop if within else split)
            bits = sorted_points.colliding(projected[:, first:last], radius, least)
            i, j = _verified(units[first:last], units[start:stop], bits, cosine)
            i, j = i + first, j + start
            if within:
                ahead = i < j
                i, j = i[ahead], j[ahead]
            if len(i):
                counts += np.bincount(i, weight[j], n).astype(np.int64) + np.bincount(j, weight[i], n).astype(np.int64)
                forest.join(i, j)
    return counts, np.concatenate([*forest.links, np.zeros((2, 0), np.int64)], axis=1)


def vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, dim, two hashes of the components, and the components as bytes; label is null where nothing can link."""
    element = df.schema[vector].dataType.elementType
    kind = np.float32 if isinstance(element, T.FloatType) else np.float64
    given = df.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<float>" if kind is np.float32 else "array<double>").alias("vector"),
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            values = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # null is NaN, -0 is 0
            total = lambda x: (lambda upto: upto[begin[1:]] - upto[begin[:-1]])(np.concatenate([x[:0], np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)]))
            sound = (total((~np.isfinite(values)).astype(np.int64)) == 0) & (total((values != 0).astype(np.int64)) > 0)
            place = np.arange(len(values)) - np.repeat(begin[:-1], sizes)
            bits = values.view(np.uint32 if kind is np.float32 else np.uint64).astype(np.uint64)
            width = int(sizes.max(initial=0))
            with np.errstate(over="ignore"):
                hashes = [mix(total(mix(bits ^ constants(width, seed)[place]))).view(np.int64) for seed in (41, 43)]
            label = pc.if_else(pa.array(sound), batch.column("label"), pa.scalar(None, pa.string()))
            rows = [values[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
            yield pa.record_batch(
                [batch.column("vec_id"), label, pa.array(sizes), *map(pa.array, hashes), pa.array(rows, pa.binary())],
                ["vec_id", *_CLASS, "vector"],
            )

    return given.mapInArrow(measure, "vec_id long, label string, dim long, h1 long, h2 long, vector binary")


def tiles(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """From (label, dim, h1, node, k, vector): every point once for each block of its label, with the tile of the two blocks."""
    sizes = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = stage(sizes.select("label", "dim", F.ceil(F.col("n") / block).alias("m"), F.monotonically_increasing_id().alias("part")), "sizes")
    dealt = points.join(sizes, ["label", "dim"]).withColumn("i", F.pmod("h1", "m"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    return dealt.select("part", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "i", "dim", "node", "k", "vector")


def links_of_tiles(tiled: DataFrame, width: int, cosine: float = COSINE) -> DataFrame:
    """Links that join the points of each tile (kind 0: a, b), and the links of each point (kind 1: node a, number b)."""
    by = ["part", "low", "high"]
    names = [*by, "i", "dim", "node", "k"]
    kind = np.float32 if width == 4 else np.float64

    def solve(cols: list[np.ndarray], data: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, low, high, block, dim, node, k = cols
        order = np.argsort(block, kind="stable")
        split = int(np.count_nonzero(block == low[0]))
        if low[0] != high[0] and split in (0, len(data)):
            return  # one of the two blocks is empty
        units = np.frombuffer(b"".join(data), kind).reshape(len(data), int(dim[0])).astype(np.float64)[order]
        units /= np.abs(units).max(axis=1, keepdims=True)  # squares stay finite
        units /= np.sqrt((units * units).sum(axis=1, keepdims=True))
        counts, links = tile_links(units, k[order].astype(np.float64), split, cosine)
        node = node[order]
        some = np.flatnonzero(counts)
        kinds = np.repeat(np.array([0, 1], np.int32), [links.shape[1], len(some)])
        a, b = np.concatenate([node[links[0]], node[some]]), np.concatenate([node[links[1]], counts[some]])
        yield pa.record_batch([pa.array(kinds), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the tile that is being read
        data: list[bytes] = []
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            rows = batch.column("vector").to_pylist()
            if not rows:
                continue
            edge = np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)
            if held and any(c[0] != h[-1] for c, h in zip(cols[:3], held[-1])):
                yield from solve([np.concatenate(x) for x in zip(*held)], data)
                held, data = [], []
            starts = [0, *(np.flatnonzero(edge) + 1).tolist(), len(rows)]
            for lo, hi in zip(starts[:-1], starts[1:]):
                if lo:
                    yield from solve([np.concatenate(x) for x in zip(*held)], data)
                    held, data = [], []
                held.append([c[lo:hi] for c in cols])
                data = data + rows[lo:hi]
        if held:
            yield from solve([np.concatenate(x) for x in zip(*held)], data)

    dealt = tiled.repartition(*by).sortWithinPartitions(*by).select(*names, "vector")
    return dealt.mapInArrow(scan, "kind int, a long, b long")


def linked(
    df: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (the smallest id that links reach) and kept."""
    width = 4 if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else 8
    rows = stage(vectors(df, key, vector, label), "vectors")
    points = rows.where("label is not null").groupBy(*_CLASS).agg(
        F.count(F.lit(1)).alias("k"), F.min("vec_id").alias("least"), F.first("vector").alias("vector")
    )
    points = stage(points.withColumn("node", F.monotonically_increasing_id()), "points")
    found = stage(links_of_tiles(tiles(points.drop("least"), block), width, cosine), "found")
    numbers = found.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    roots = components(found.where("kind = 0").select("a", "b"))
    named = points.drop("vector").join(numbers, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    verdicts = named.join(least, "root").select(*_CLASS, (F.coalesce("others", F.lit(0)) + F.col("k") - 1).alias("n_links"), "component_id")
    lone = F.col("label").isNull()
    judged = rows.where(~lone).drop("vector").join(verdicts, _CLASS).select("vec_id", "n_links", "component_id")
    alone = rows.where(lone).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return judged.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_embedding_links(spark, sf_dir: str) -> DataFrame:
    return linked(tables.table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE sound AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM sound a JOIN sound b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.93),
reach(a, b) AS (
  SELECT r, r FROM sound UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT reach.a AS r, min(s.vec_id) AS component_id FROM reach JOIN sound s ON reach.b = s.r GROUP BY reach.a),
counted AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM sound JOIN named USING (r) LEFT JOIN counted USING (r)
UNION ALL
SELECT vec_id, 0, vec_id, true FROM embeddings
WHERE label IS NULL OR embedding IS NULL OR len(list_filter(embedding, lambda x: x <> 0)) = 0
   OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
"""
