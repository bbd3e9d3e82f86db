"""Linear models with crossed random intercepts of two factors, fitted by restricted maximum likelihood (REML).

With ``l_k`` the ratio of the residual variance to the variance of factor k, the mixed-model equations of both
factors are ``(Z'Z + diag(l)) u = Z'r``. Rows enter only as counts and sums by cell (level, level), so a
round costs two aggregates over the cells whatever the number of rows.

* The factor with more levels is absorbed. Where the other one has at most ``DENSE`` levels, their equations are summed up
  over the levels of the absorbed one, each with its counts in one row, and solved on the driver: a round is two scans
  without a shuffle. With more levels conjugate gradients solve for them. An iteration is one
  aggregate for each factor, and its state is written, so a lost executor costs one iteration.
* All right sides are solved at once: the response, the regressors and the probes of the traces.
* Traces of the inverse are taken with ``probes`` signed columns of a Hadamard matrix: level i has row ``i mod probes``.
  Levels of different rows don't disturb each other, so the traces are exact where the levels of both factors
  number ``probes`` at most; with more they are unbiased, their noise falls with ``probes``, and it is the same in
  every run, so the rounds converge.
* REML's equations ``variance_k = u'u / (levels - l_k * trace_k)`` are solved as a fixed point in log ``l`` with Anderson's mixing.

The driver sees sums of the size of (regressors + probes) squared, and at most ``DENSE`` levels. Rows with a null in any used column
play no part. A factor without variance gets effects of zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.session import stage

PROBES = 16
#: The rounds end when no log ratio moves by more.
TOLERANCE = 1e-6
MAX_ROUNDS = 60
MAX_STEPS = 400
#: A ratio of residual to factor variance of this many times the mean rows of a level counts as no variance:
#: effects are then a hundredth of the levels' means.
NO_VARIANCE = 100
#: Levels of the smaller factor up to which its equations are solved directly.
DENSE = 128
_TASK_BITS = 33  # monotonically_increasing_id: the task number stands above these bits


@dataclass
class MixedFit:
    """``effects``: factor, level, n, effect. ``fixed``: term, estimate, std_error, t_value. ``components``: variances."""

    effects: DataFrame
    fixed: list[tuple[str, float, float | None, float | None]]
    components: dict[str, float]
    #: for each round: the ratios, the steps of the solver, and how far the ratios moved
    rounds: list[dict] = field(default_factory=list)


def _numbered(df: DataFrame, label: str) -> DataFrame:
    """A written table with ``index``: the numbers from 0 on without gaps."""
    rows = stage(df.withColumn("__id", F.monotonically_increasing_id()), label)
    task = F.shiftright("__id", _TASK_BITS)
    sizes = rows.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))  # one row for each task that wrote
    before = sizes.select("__task", (F.sum("__n").over(Window.orderBy("__task")) - F.col("__n")).alias("__before"))
    placed = rows.withColumn("__task", task).join(before, "__task")
    inside = F.col("__id").bitwiseAND(F.lit((1 << _TASK_BITS) - 1))
    return stage(placed.withColumn("index", F.col("__before") + inside).drop("__id", "__task", "__before"), label)


def _level_table(cells: DataFrame, factor: str, columns: int, probes: int, offset: int) -> DataFrame:
    """level, n and ``rhs``: the sums of the response and the regressors, then the probes."""
    sums = cells.groupBy(F.col(factor).alias("level")).agg(
        F.sum("n").cast("double").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"__s{k}") for k in range(columns)]
    )
    rows = _numbered(sums, "levels")
    own = 1 - 2 * F.xxhash64(F.lit(factor), F.col("level")).bitwiseAND(F.lit(1))
    place = F.col("index") + offset
    signs = ", ".join(f"CAST(own * (1 - 2 * (bit_count(place & {h}L) % 2)) AS DOUBLE)" for h in range(probes))
    rhs = F.expr(f"array({', '.join(f'__s{k}' for k in range(columns))}, {signs})")
    return stage(rows.withColumns({"own": own, "place": place}).select("level", "n", rhs.alias("rhs")), "levels")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _arrays(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def _with_vectors(df: DataFrame, names: list[str], make) -> DataFrame:
    """``level``, ``n`` and the named arrays, made from a batch's columns by ``make`` (dict of matrices to list of matrices).

    Numbers that change from round to round stay out of the plan's code, so it is compiled once.
    """
    arrays = [c for c in df.columns if c not in ("level", "n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                given = {c: _matrix(batch.column(c)) for c in arrays} | {"n": batch.column("n").to_numpy()[:, None]}
                yield pa.record_batch([batch.column("level"), batch.column("n"), *map(_arrays, make(given))], ["level", "n", *names])

    kind = df.schema["level"].dataType.simpleString()
    return df.mapInArrow(run, f"level {kind}, n double, " + ", ".join(f"{c} array<double>" for c in names))


def _summed(df: DataFrame, make) -> np.ndarray:
    """Sums over all rows of the columns of a matrix that ``make`` gives for a batch; the driver gets one row per column."""
    arrays = [c for c in df.columns if c not in ("level", "n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                given = {c: _matrix(batch.column(c)) for c in arrays} | {"n": batch.column("n").to_numpy()[:, None]}
                part = make(given)
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["k", "value"])

    sums = df.mapInArrow(run, "k long, value double").groupBy("k").agg(F.sum("value").alias("value"))
    return np.array([r["value"] for r in sorted(sums.collect())])


class _Equations:
    """The equations of one model: ``small`` is solved for, ``large`` is absorbed."""

    def __init__(self, cells: DataFrame, small: str, large: str, columns: int, probes: int):
        self.cells, self.names, self.columns, self.probes = cells, (small, large), columns, probes
        self.width = columns + probes
        self.small = _level_table(cells, small, columns, probes, 0)
        self.sizes = (self.small.count(), cells.select(large).distinct().count())
        self.large = _level_table(cells, large, columns, probes, self.sizes[0])
        if self.sizes[0] <= DENSE:
            self._gather()

    def _gather(self) -> None:
        """The small factor's levels, and beside each level of the large one its counts ``c`` by level of the small one."""
        small, large = self.names
        self.levels = self.small.collect()
        kind = self.small.schema["level"].dataType.simpleString()
        places = self.cells.sparkSession.createDataFrame([(r["level"], k) for k, r in enumerate(self.levels)], f"{small} {kind}, __place int")
        entries = F.map_from_entries(F.collect_list(F.struct("__place", F.col("n").cast("double"))))
        held = self.cells.join(places, small).groupBy(F.col(large).alias("level")).agg(entries.alias("__held"))
        row = F.transform(F.sequence(F.lit(0), F.lit(len(self.levels) - 1)), lambda k: F.coalesce(F.try_element_at("__held", k), F.lit(0.0)))
        self.profiles = stage(self.large.join(held, "level").select("level", "n", "rhs", row.alias("c")), "profiles")

    def _solve_directly(self, ratios: tuple[float, float]) -> tuple[DataFrame, DataFrame, int]:
        own, other = ratios
        m = len(self.levels)
        n, rhs = (np.array([r[c] for r in self.levels], float) for c in ("n", "rhs"))

        def part(g: dict) -> np.ndarray:
            weighted = (g["c"] / (g["n"] + other)).T
            return np.concatenate([(weighted @ g["c"]).ravel(), (weighted @ g["rhs"]).ravel()])

        found = _summed(self.profiles, part)
        v = np.linalg.solve(np.diag(n + own) - found[: m * m].reshape(m, m), rhs - found[m * m :].reshape(m, -1))
        rows = [(r["level"], r["n"], r["rhs"], x) for r, x in zip(self.levels, v.tolist())]
        kind = self.small.schema["level"].dataType.simpleString()
        small = self.cells.sparkSession.createDataFrame(rows, f"level {kind}, n double, rhs array<double>, v array<double>")
        large = _with_vectors(self.profiles, ["rhs", "v"], lambda g: [g["rhs"], (g["rhs"] - g["c"] @ v) / (g["n"] + other)])
        return small, large, 1

    def _crossed(self, vectors: DataFrame, source: str, target: str) -> DataFrame:
        """``level`` of the target with ``sums``: the vectors of the source's levels, weighted by the cells' counts."""
        joined = self.cells.select("n", source, F.col(target).alias("__to")).join(
            vectors.select(F.col("level").alias(source), "v"), source
        )
        sums = ", ".join(f"sum(n * v[{k}])" for k in range(self.width))
        return joined.groupBy(F.col("__to").alias("level")).agg(F.expr(f"array({sums})").alias("sums"))

    def absorbed(self, x: DataFrame, ratio: float, rhs: bool) -> DataFrame:
        """The large factor's solution for given values ``v`` of the small one (without right sides: the sums over its levels)."""
        crossed = self.large.join(self._crossed(x, *self.names), "level")
        part = (lambda g: [(g["rhs"] - g["sums"]) / (g["n"] + ratio)]) if rhs else (lambda g: [g["sums"] / (g["n"] + ratio)])
        return _with_vectors(crossed, ["v"], part)

    def solve(self, x: DataFrame | None, ratios: tuple[float, float], tolerance: float) -> tuple[DataFrame, DataFrame, int]:
        """Solutions ``v`` of both factors beside their right sides, and the steps taken. ``x`` is a first guess."""
        if self.sizes[0] <= DENSE:
            return self._solve_directly(ratios)
        own, other = ratios
        start = self.small if x is None else self.small.join(x.select("level", "v"), "level")
        guess = _with_vectors(start, ["rhs", "v"], lambda g: [g["rhs"], g.get("v", np.zeros_like(g["rhs"]))])
        above = self._crossed(self.absorbed(guess, other, rhs=True), *reversed(self.names))

        def begin(g: dict) -> list[np.ndarray]:
            r = g["rhs"] - g["sums"] - (g["n"] + own) * g["v"]
            return [g["v"], r, r / (g["n"] + own)]

        state = stage(_with_vectors(guess.join(above, "level"), ["x", "r", "v"], begin), "solver")
        scale = _summed(self.small, lambda g: (g["rhs"] ** 2 / (g["n"] + own)).sum(axis=0))
        floor = tolerance**2 * np.maximum(scale, 1e-300)
        dots = lambda g: np.concatenate([
            (g["v"] * g["q"]).sum(axis=0), *(((g[a] * g[b]) / (g["n"] + own)).sum(axis=0) for a, b in ("rr", "rq", "qq"))
        ])
        steps = 0
        while True:
            applied = self._crossed(self.absorbed(state.select("level", "v"), other, rhs=False), *reversed(self.names))
            # S p = (n + l) p - sums
            full = stage(_with_vectors(state.join(applied, "level"), ["x", "r", "v", "q"], lambda g: [g["x"], g["r"], g["v"], (g["n"] + own) * g["v"] - g["sums"]]), "solver")
            pq, rr, rq, qq = _summed(full, dots).reshape(4, self.width)
            live = (rr > floor) & (pq > 0)
            alpha = np.where(live, rr / np.where(live, pq, 1.0), 0.0)
            after = np.maximum(rr - 2 * alpha * rq + alpha**2 * qq, 0.0)
            beta = np.where(live, after / np.where(live, rr, 1.0), 0.0)
            steps += 1

            def advance(g: dict, alpha=alpha, beta=beta) -> list[np.ndarray]:
                r = g["r"] - alpha * g["q"]
                return [g["x"] + alpha * g["v"], r, r / (g["n"] + own) + beta * g["v"]]

            state = _with_vectors(full, ["x", "r", "v"], advance)
            if not live.any() or (after <= floor).all() or steps >= MAX_STEPS:
                break
        small = self.small.join(_with_vectors(state, ["v"], lambda g: [g["x"]]).drop("n"), "level")
        small = stage(small, "solution")
        large = stage(self.large.join(self.absorbed(small, other, rhs=True).drop("n"), "level"), "solution")
        return small, large, steps

    def products(self, solved: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
        """Of one factor: right sides times solutions, solutions times solutions, and the probes' trace."""
        k = self.columns

        def part(g: dict) -> np.ndarray:
            rhs, v = g["rhs"], g["v"]
            trace = (rhs[:, k:] * v[:, k:]).sum(keepdims=True)
            return np.concatenate([x.ravel() for x in (rhs[:, :k].T @ v[:, :k], v[:, :k].T @ v[:, :k], trace)])

        found = _summed(solved, part)
        return found[: k * k].reshape(k, k), found[k * k : -1].reshape(k, k), found[-1] / self.probes


def _mixed_step(points: list[np.ndarray], images: list[np.ndarray]) -> np.ndarray:
    """Anderson's next point from the last points and their images under the fixed-point map."""
    gaps = [b - a for a, b in zip(points, images)]
    if len(points) > 1:
        turns = np.stack([g - gaps[-1] for g in gaps[:-1]], axis=1)
        weights, *_ = np.linalg.lstsq(turns, -gaps[-1], rcond=1e-8)
        moved = images[-1] + np.stack([b - images[-1] for b in images[:-1]], axis=1) @ weights
        if np.abs(moved - images[-1]).max() <= 4:
            return moved
    return images[-1]


def crossed_effects(
    df: DataFrame, y: str, terms: list[str], first: str, second: str, probes: int = PROBES, tolerance: float = TOLERANCE
) -> MixedFit:
    """REML fit of ``y`` on an intercept and ``terms``, with random intercepts of the factors ``first`` and ``second``.

    ``probes`` is a power of two. The effects are the best linear unbiased predictions.
    """
    if probes < 1 or probes & (probes - 1):
        raise ValueError("probes must be a power of two")
    numbers = [F.col(c).cast("double").alias(c) for c in [y, *terms]]
    rows = stage(df.select(F.col(first).alias("__first"), F.col(second).alias("__second"), *numbers).dropna(), "rows")
    design = [F.col(y), F.lit(1.0), *[F.col(c) for c in terms]]
    k = len(design)
    moments = rows.agg(F.array(*[F.sum(a * b) for a in design for b in design]), F.count(F.lit(1))).first()
    if not moments[1]:
        raise ValueError("no complete rows")
    gram, n = np.reshape(moments[0], (k, k)), moments[1]
    cells = rows.groupBy("__first", "__second").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"__s{i}") for i, c in enumerate(design)])
    cells = stage(cells.select("__first", "__second", "n", F.array(*[F.col(f"__s{i}") for i in range(k)]).alias("sums")), "cells")
    counts = cells.agg(F.count_distinct("__first"), F.count_distinct("__second")).first()
    small, large = ("__first", "__second") if counts[0] <= counts[1] else ("__second", "__first")
    equations = _Equations(cells, small, large, k, probes)
    levels = np.array(equations.sizes, float)
    most = NO_VARIANCE * n / levels

    rank = int(np.linalg.matrix_rank(gram[1:, 1:]))
    logs, points, images, rounds, guess = np.log(np.maximum(1.0, 0.2 * n / levels)), [], [], [], None
    moved = 1.0
    while True:
        ratios = tuple(np.exp(logs).tolist())
        one, two, steps = equations.solve(guess, ratios, max(1e-11, min(1e-5, 1e-3 * moved)))
        guess = one
        parts = [equations.products(t) for t in (one, two)]
        left = gram - parts[0][0] - parts[1][0]  # the moments after the factors: design' V^-1 design
        inverse = np.linalg.pinv(left[1:, 1:], hermitian=True)
        beta = inverse @ left[1:, 0]
        residual = max(float(left[0, 0] - beta @ left[1:, 0]), 1e-300) / max(n - rank, 1)
        contrast = np.append(1.0, -beta)
        squares = np.array([contrast @ p[1] @ contrast for p in parts])
        traces = np.array([p[2] + np.sum(inverse * p[1][1:, 1:]) for p in parts])
        freedom = np.maximum(levels - np.exp(logs) * traces, 1e-9)
        image = np.log(np.minimum(residual * freedom / np.maximum(squares, 1e-300), most))
        moved = float(np.abs(image - logs).max())
        rounds.append({"ratios": ratios, "steps": steps, "moved": moved})
        if moved < tolerance or len(rounds) >= MAX_ROUNDS:
            break
        points, images = [*points, logs][-3:], [*images, image][-3:]
        logs = np.clip(_mixed_step(points, images), np.log(1e-9), np.log(most))

    names = {"__first": first, "__second": second}
    weights = contrast.tolist()

    def effects(solved: DataFrame, factor: str) -> DataFrame:
        value = _with_vectors(solved, ["e"], lambda g: [(g["v"][:, :k] @ np.array(weights))[:, None]])
        return value.select(F.lit(names[factor]).alias("factor"), F.col("level").cast("string").alias("level"), F.col("n").cast("long").alias("n"), F.col("e")[0].alias("effect"))

    both = {small: effects(one, small), large: effects(two, large)}
    errors = np.sqrt(np.maximum(residual * np.diag(inverse), 0))
    fixed = [(t, float(b), float(e), float(b / e) if e > 0 else None) for t, b, e in zip(["(Intercept)", *terms], beta, errors)]
    variance = dict(zip((small, large), (0.0 if r >= 0.99 * top else residual / r for r, top in zip(np.exp(logs), most))))
    components = {first: float(variance["__first"]), second: float(variance["__second"]), "residual": float(residual)}
    return MixedFit(both["__first"].unionByName(both["__second"]), fixed, components, rounds)
