"""Clusters, principal components and regressions on MLlib."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, RFormula, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions.ordered import with_position
from pricepanel.operators import stats
from pricepanel.session import stage
from pricepanel.sources.tables import spread

STARTS = 100  # fixed value: k-means starts of which the best is kept
MOST_ROUNDS = 10_000  # fixed value: rounds after which a start that still moves is reported
STILL = 1e-9
BORDER_ROWS = 1_000_000  # points of all starts that a scan hands on for further rounds, some 50 MB
START_ROWS = 100_000  # most points of one start among them
REACH = 256  # of its last step, how far a start may go before the next scan
BLOCK = 1_000  # rows of a task that meet all starts at once, some 3 MB for each cluster
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(df)


def _start_sums(block: np.ndarray, centres: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Counts and coordinate sums of one block of points by start and cluster, costs by start, and the points on a border.

    A point lies on a border where its distances to its two nearest centres differ by at most the width of the
    start; these come as three arrays of starts, clusters and rows. Equal distances go to the lower cluster.
    """
    starts, k, width = centres.shape
    flat = centres.transpose(1, 0, 2).reshape(k * starts, width)
    gaps = ((flat**2).sum(1)[:, None] - 2.0 * flat @ block.T).reshape(k, starts, len(block))
    squares, first = (block**2).sum(1), gaps.min(0)
    ones = np.column_stack([np.ones(len(block)), block])
    added, free, slot = np.empty((starts, k, width + 1)), np.ones(first.shape, bool), np.zeros(first.shape, np.int16)
    for j in range(k):
        mine = free & (gaps[j] == first)
        free &= ~mine
        slot[mine] = j
        added[:, j] = mine.astype(float) @ ones
    cost = np.maximum(first + squares, 0.0).sum(1)
    wide = np.flatnonzero(widths > 0) if k > 1 else np.zeros(0, int)
    one, two = gaps[0, wide], np.full((len(wide), len(block)), np.inf)
    for j in range(1, k):
        two = np.minimum(two, np.maximum(one, gaps[j, wide]))
        one = np.minimum(one, gaps[j, wide])
    far = np.sqrt(np.maximum(one + squares, 0.0)) + np.sqrt(np.maximum(two + squares, 0.0))
    at, row = np.nonzero(two - one <= widths[wide, None] * far)
    return added[:, :, 0], added[:, :, 1:], cost, (wide[at], slot[wide[at], row], row)


def _centres_of(n: np.ndarray, sums: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Means of clusters; an empty cluster stays where it was."""
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], before)


def _rounds_at_border(now: np.ndarray, n: np.ndarray, sums: np.ndarray, border: np.ndarray, width: float, most: int):
    """Rounds of one start after the round that gave ``n`` and ``sums``: centres, last step, number of rounds.

    ``border`` holds cluster and coordinates of the points within ``width`` of a border of ``now``. As long as no
    centre is half that far from ``now``, all other points keep their cluster, so that their sums serve as they are.
    """
    k, slot, points = len(now), border[:, 0].astype(int), border[:, 1:]
    ones = np.column_stack([np.ones(len(points)), points])
    by_cluster = lambda of: (of == np.arange(k)[:, None]).astype(float) @ ones
    fixed = np.column_stack([n, sums]) - by_cluster(slot)
    at, rounds = _centres_of(n, sums, now), 0
    step, still = np.abs(at - now).max(), STILL * max(1.0, np.abs(now).max())
    # a hundredth of the width is left for rounding
    while rounds < most and step > still and 2.0 * np.sqrt(((at - now) ** 2).sum(1).max()) < 0.99 * width:
        total = fixed + by_cluster(((at**2).sum(1) - 2.0 * points @ at.T).argmin(1))
        moved = _centres_of(np.rint(total[:, 0]), total[:, 1:], at)
        step, at, rounds = np.abs(moved - at).max(), moved, rounds + 1
    return at, step, rounds


def _move(data: DataFrame, centres: np.ndarray, border_rows: int = BORDER_ROWS, start_rows: int = START_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Move the centres of several starts until each stands still; centres and costs.

    In each scan a task reduces its rows to counts and sums per start and
    cluster, Spark adds those up by start, and one small row per start reaches
    the driver. Starts that stand still drop out of the next scan.

    Late rounds move few points. A scan therefore also hands on the points close to a border between clusters, at
    most ``border_rows`` of all starts and ``start_rows`` of one over all tasks, and the task that adds up a start
    goes on with rounds over these while no other point can change its cluster: the rounds are those that scans of
    all rows would give. A start ends only with a scan of all rows that leaves it still.
    """
    starts, k, width = centres.shape
    centres, costs, moving = centres.copy(), np.full(starts, np.inf), np.arange(starts)
    steps, density, rounds = np.zeros(starts), np.zeros(starts), np.zeros(starts, int)
    cores, tasks = data.sparkSession.sparkContext.defaultParallelism, data.rdd.getNumPartitions()
    while True:
        now, left = centres[moving], MOST_ROUNDS - rounds[moving] - 1
        room = min(border_rows // len(moving), start_rows) // tasks  # of a start in one task
        # the points within a width are about in proportion to it; half the room is left free
        fits = np.divide(0.5 * room, density[moving], out=np.full(len(moving), np.inf), where=density[moving] > 0)
        widths = np.minimum(2.0 * REACH * steps[moving], fits)
        widths[widths < 4.0 * steps[moving]] = 0.0  # too narrow for two more rounds

        def reduce_rows(frames):
            n, sums, cost, met = np.zeros((len(now), k)), np.zeros(now.shape), np.zeros(len(now)), np.zeros(len(now), int)
            border = [[] for _ in now]
            for frame in frames:
                values = frame.to_numpy(dtype=float)
                for block in np.split(values, range(BLOCK, len(values), BLOCK)):
                    part_n, part_sums, part_cost, (start, slot, row) = _start_sums(block, now, widths)
                    n, sums, cost = n + part_n, sums + part_sums, cost + part_cost
                    met += np.bincount(start, minlength=len(now))
                    ends = np.searchsorted(start, np.arange(len(now) + 1))
                    for s in np.unique(start):
                        own = slice(ends[s], ends[s + 1])
                        if met[s] <= room:
                            border[s].append(np.column_stack([slot[own], block[row[own]]]))
                        else:  # a start with more points than the task has room for hands on none
                            border[s].clear()
            held = [np.concatenate(b).ravel() if b else np.zeros(0) for b in border]
            yield pd.DataFrame(
                {"start": range(len(now)), "n": list(n), "sums": list(sums.reshape(len(now), -1)), "cost": cost, "met": met, "border": held}
            )

        def go_on(key, parts):
            s, most = key[0], parts["met"].max()
            n, sums = np.sum(list(parts["n"]), axis=0), np.sum(list(parts["sums"]), axis=0).reshape(k, width)
            first = at = _centres_of(n, sums, now[s])
            step = last = np.abs(first - now[s]).max()
            more = 0
            if widths[s] > 0 and most <= room:
                border = np.concatenate(list(parts["border"])).reshape(-1, width + 1)
                at, last, more = _rounds_at_border(now[s], n, sums, border, widths[s], left[s])
            return pd.DataFrame(
                {"start": [s], "at": [at.ravel()], "cost": [parts["cost"].sum()], "step": [step], "last": [last], "most": [most], "more": [more]}
            )

        found = (
            data.mapInPandas(reduce_rows, "start int, n array<double>, sums array<double>, cost double, met long, border array<double>")
            .repartition(cores, "start")
            .groupBy("start")
            .applyInPandas(go_on, "start int, at array<double>, cost double, step double, last double, most long, more long")
            .toPandas()
            .sort_values("start")
        )
        centres[moving] = np.stack(found["at"]).reshape(now.shape)
        costs[moving], steps[moving] = found["cost"], found["last"]
        rounds[moving] += 1 + found["more"].to_numpy()
        most = found["most"].to_numpy()
        measured = (widths > 0) & (most > 0)
        density[moving[measured]] = most[measured] / widths[measured]
        still = STILL * np.maximum(1.0, np.abs(now).max((1, 2)))
        moving = moving[found["step"].to_numpy() > still]
        if not len(moving):
            return centres, costs
        if rounds[moving].max() >= MOST_ROUNDS:
            raise RuntimeError(f"{len(moving)} of {starts} starts still move after {MOST_ROUNDS} rounds")


def first_centres(data: DataFrame, columns: list[str], k: int, starts: int, seed: int) -> np.ndarray:
    """``k`` distinct rows for every start, drawn by hash from all distinct rows.

    A task keeps its ``k`` lowest draws per start, whatever the number of its
    rows or of their copies.
    """
    salts = np.random.default_rng(seed).integers(0, 2**63, starts).astype(np.uint64)

    def lowest(frames):
        kept = [(np.zeros(0, np.uint64), np.zeros((0, len(columns))))] * starts
        for frame in frames:
            frame = frame.drop_duplicates("__mark")
            values, marks = frame[columns].to_numpy(dtype=float), frame["__mark"].to_numpy(dtype=np.int64).view(np.uint64)
            for s, (draws, rows) in enumerate(kept):
                mine = (marks ^ salts[s]) * _SPREAD
                mine ^= mine >> np.uint64(32)
                mine *= _SPREAD
                low = np.argpartition(mine, k)[:k] if len(mine) > k else np.arange(len(mine))
                draws, at = np.unique(np.concatenate([draws, mine[low]]), return_index=True)
                kept[s] = draws[:k], np.concatenate([rows, values[low]])[at[:k]]
        drawn = [(s, d, r) for s, (draws, rows) in enumerate(kept) for d, r in zip(draws.view(np.int64).tolist(), rows.tolist())]
        yield pd.DataFrame(drawn, columns=["start", "draw", "row"])

    # adding zero makes the two zeros one value
    plain = data.select(*[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in columns])
    marked = plain.withColumn("__mark", F.xxhash64(*columns))
    drawn = marked.mapInPandas(lowest, "start int, draw long, row array<double>").dropDuplicates(["start", "draw"])
    place = F.row_number().over(Window.partitionBy("start").orderBy("draw"))
    # tasks keep their lowest draws in unsigned order, which flipping the sign bit keeps
    drawn = drawn.withColumn("draw", F.col("draw").bitwiseXOR(F.lit(-(2**63))))
    rows = drawn.withColumn("place", place).filter(F.col("place") <= k).orderBy("start", "place").collect()
    if len(rows) < starts * k:
        raise ValueError(f"{k} clusters need at least {k} distinct rows")
    return np.array([r["row"] for r in rows]).reshape(starts, k, len(columns))


def best_centres(points: DataFrame, columns: list[str], k: int, starts: int = STARTS, seed: int = 0) -> list[list[float]]:
    """Centres of the best of many k-means starts, all of them moved by the same scans.

    Every start begins at ``k`` distinct rows and is moved until it stands still.
    """
    data = points.select(*columns)
    final, costs = _move(data, first_centres(data, columns, k, starts, seed))
    return final[int(costs.argmin())].tolist()


def cluster_rows(df: DataFrame, columns: list[str], k: int, starts: int = STARTS) -> DataFrame:
    """Standardise, cluster, and label by size: cluster 1 is the largest."""
    points = spread(stats.standardize(stats.complete_rows(df, columns), columns), *columns).persist()
    try:
        centres = best_centres(points, columns, k, starts)
    finally:
        points.unpersist()
    rows = [(i, *c) for i, c in enumerate(centres)]
    table = df.sparkSession.createDataFrame(rows, f"cluster int, {', '.join(f'`{c}` double' for c in columns)}")
    nearest = stats.nearest_centre(points, columns, table, "cluster").drop("distance", *columns)
    return stats.relabel_by_size(nearest, "cluster")


def score_classes(scores: DataFrame, columns: list[str], k: int, max_iter: int = 1000, seed: int = 0) -> DataFrame:
    """Classes of rows on component scores from one k-means start, labelled by size."""
    vectors = assemble(scores, columns)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, predictionCol="cluster").fit(vectors)
    return stats.relabel_by_size(model.transform(vectors).drop("features"), "cluster")


def pca_scores(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Scores on the first ``k`` principal components of the standardised columns."""
    vectors = assemble(stats.complete_rows(df, columns), columns, "__raw")
    scaled = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True).fit(vectors).transform(vectors)
    scored = PCA(k=k, inputCol="__scaled", outputCol="scores").fit(scaled).transform(scaled)
    parts = vector_to_array("scores")
    return scored.select("*", *[parts[i].alias(f"pc{i + 1}") for i in range(k)]).drop("__raw", "__scaled", "scores")


def _usable(df: DataFrame, numeric: list[str], factors: list[str]) -> tuple[list[str], list[str]]:
    """The regressors that vary; a constant one cannot be told from the intercept."""
    row = df.agg(
        *[(F.min(c) != F.max(c)).alias(c) for c in [*numeric, *factors]]
    ).first()
    return [c for c in numeric if row[c]], [c for c in factors if row[c]]


def _terms(frame: DataFrame) -> list[str]:
    groups = frame.schema["features"].metadata["ml_attr"]["attrs"].values()
    return [a["name"] for a in sorted((a for g in groups for a in g), key=lambda a: a["idx"])]


def coefficient_table(model, terms: list[str], spark) -> DataFrame:
    """Rows term, estimate, std_error, t_value, p_value; the errors are null for a singular fit."""
    s = model.summary
    estimates = [*(float(x) for x in model.coefficients), float(model.intercept)]
    try:
        columns = (s.coefficientStandardErrors, s.tValues, s.pValues)
        errors = list(zip(*[[float(x) for x in c] for c in columns]))
    except UnsupportedOperationException:  # a fit without an invertible normal matrix
        errors = [(None, None, None)] * len(estimates)
    rows = [(t, e, *x) for t, e, x in zip([*terms, "(Intercept)"], estimates, errors)]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, t_value double, p_value double")


def _design(df: DataFrame, y: str, numeric: list[str], factors: list[str]) -> DataFrame:
    """Label and features as MLlib takes them; the rows are written once, as several passes read them."""
    rows = stage(df.select(y, *numeric, *factors).dropna(), "design")
    numeric, factors = _usable(rows, numeric, factors)
    formula = RFormula(
        formula=f"{y} ~ {' + '.join([*factors, *numeric])}", stringIndexerOrderType="alphabetDesc", labelCol="label"
    )
    return formula.fit(rows).transform(rows)


def ols(df: DataFrame, y: str, numeric: list[str], factors: list[str] | None = None) -> DataFrame:
    """Least squares with dummies for factors against their first level; a coefficient table."""
    frame = _design(df, y, numeric, factors or [])
    model = LinearRegression(solver="normal", standardization=False).fit(frame)
    return coefficient_table(model, _terms(frame), df.sparkSession)


def probit(df: DataFrame, y: str, numeric: list[str]) -> DataFrame:
    """Probit regression of a 0/1 response; a coefficient table."""
    frame = _design(df, y, numeric, [])
    model = GeneralizedLinearRegression(family="binomial", link="probit", maxIter=50).fit(frame)
    return coefficient_table(model, _terms(frame), df.sparkSession)


def normal_quantile(p: str, mean: Column, sd: Column) -> Column:
    """Quantile of a normal distribution; null at probability 0 and 1."""

    @F.pandas_udf("double")
    def unit(probabilities: pd.Series) -> pd.Series:
        inverse = NormalDist().inv_cdf
        return probabilities.map(lambda q: inverse(q) if 0 < q < 1 else None).astype("float64")

    return mean + sd * unit(F.col(p))


def normal_qq(effects: DataFrame, value: str, tie: list[str]) -> DataFrame:
    """Sorted effects beside the normal quantiles of their places, place ``i`` at ``(i - 1) / n``."""
    stat = effects.agg(
        F.struct(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    ).scalar()
    placed = with_position(effects, value, tie).withColumn("__s", stat)
    placed = placed.withColumn("p", (F.col("position") - 1) / F.col("__s.n"))
    return placed.withColumn("normal_quantile", normal_quantile("p", F.col("__s.mean"), F.col("__s.sd"))).drop("__s")
