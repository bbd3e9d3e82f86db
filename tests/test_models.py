"""Statistics and models against numpy, and their invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import rows
from pricepanel.operators import models as M
from pricepanel.operators import stats
from pricepanel.operators.apply import group_apply
from pricepanel.plans import classes
from pricepanel.session import stage


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    centres = [(0, 0, 0), (8, 8, 0), (0, 8, 8)]
    sizes = [60, 40, 25]
    xs = np.concatenate([rng.normal(c, 1.0, (n, 3)) for c, n in zip(centres, sizes)])
    return pd.DataFrame(xs, columns=["a", "b", "c"]).assign(id=range(len(xs)), truth=np.repeat([1, 2, 3], sizes))


@pytest.fixture(scope="module")
def frame(spark, points):
    return stage(spark.createDataFrame(points), "points")


def test_standardised_columns(frame):
    z = stats.standardize(frame, ["a", "b"]).agg(F.avg("a"), F.stddev_samp("a"), F.avg("b"), F.stddev_samp("b")).first()
    assert [round(v, 9) + 0.0 for v in z] == [0.0, 1.0, 0.0, 1.0]


def test_correlations(frame, points):
    got = {(r["a"], r["b"]): r["corr"] for r in rows(stats.correlation_matrix(frame, ["a", "b", "c"]))}
    want = points[["a", "b", "c"]].corr()
    for (x, y), value in got.items():
        assert value == pytest.approx(want.loc[x, y])


def test_histogram_counts_every_row_once(frame, points):
    got = rows(stats.histogram(frame, ["a", "b"], 10), "column", "bin")
    for c in "ab":
        want, _ = np.histogram(points[c], bins=10)
        counted = {r["bin"]: r["count"] for r in got if r["column"] == c}
        assert [counted.get(i, 0) for i in range(10)] == want.tolist()


def test_clusters_are_found_and_numbered_by_size(frame, points):
    got = rows(M.cluster_rows(frame.select("id", "a", "b", "c"), ["a", "b", "c"], 3, starts=10), "id")
    assert [r["cluster"] for r in got] == points["truth"].tolist()


def test_many_starts_never_cost_more_than_one(frame, points):
    cols = ["a", "b", "c"]
    xs = points[cols].to_numpy()
    cost = lambda centres: ((xs[:, None] - np.array(centres)[None]) ** 2).sum(2).min(1).sum()
    few, many = (cost(M.best_centres(frame, cols, 4, starts=n)) for n in (1, 20))
    assert many <= few * 1.001
    from pyspark.ml.clustering import KMeans

    vectors = M.assemble(frame, cols)
    mllib = min(KMeans(k=4, seed=s, maxIter=50).fit(vectors).summary.trainingCost for s in range(5))
    assert many <= mllib * 1.001


def test_late_rounds_take_few_scans_and_end_at_the_same_centres(spark, monkeypatch):
    """Points without clusters move for many rounds; a scan of all rows serves several of them, with or without room."""
    xs = np.random.default_rng(9).uniform(size=(3000, 2))
    df = spark.createDataFrame(pd.DataFrame(xs, columns=["x", "y"])).repartition(3, "x").persist()
    first = M.first_centres(df, ["x", "y"], 5, 4, 0)
    want, costs, rounds = [], [], 0
    for at in first:
        for n in range(1, 1000):
            gaps = ((xs[:, None] - at[None]) ** 2).sum(2)
            moved = np.array([xs[gaps.argmin(1) == j].mean(0) for j in range(5)])
            if np.abs(moved - at).max() <= 1e-9:
                break
            at = moved
        want, costs, rounds = [*want, at], [*costs, gaps.min(1).sum()], max(rounds, n)
    scans, whole = [], type(df).toPandas
    monkeypatch.setattr(type(df), "toPandas", lambda self: scans.append(1) or whole(self))
    for border_rows, most in ((M.BORDER_ROWS, rounds // 2), (2000, rounds), (0, rounds)):
        scans.clear()
        centres, found = M._move(df, first, border_rows)
        assert np.allclose(centres, want, atol=1e-9) and np.allclose(found, costs)
        assert len(scans) <= most and rounds > 30
    df.unpersist()


def test_repeated_rows_give_their_distinct_points(spark):
    copies = spark.range(2000).select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(0.0, 0.0), (1.0, 0.0), (0.0, 5.0)]])).alias("p"))
    got = M.best_centres(copies.select("p.x", "p.y"), ["x", "y"], 3, starts=4)
    assert sorted(got) == [[0.0, 0.0], [0.0, 5.0], [1.0, 0.0]]


def test_first_centres_come_from_the_whole_table(spark):
    df = spark.range(5000, numPartitions=4).select(F.col("id").cast("double").alias("x"))
    drawn = M.first_centres(df, ["x"], 3, 100, 0)
    assert drawn.shape == (100, 3, 1) and all(len(set(d.ravel())) == 3 for d in drawn)
    assert len(set(drawn.ravel())) > 250 and abs(drawn.mean() - 2500) < 400
    again = M.first_centres(df.repartition(7).unionByName(df), ["x"], 3, 100, 0)
    assert again.tolist() == drawn.tolist()


def test_too_few_distinct_rows_are_refused(spark):
    with pytest.raises(ValueError):
        M.best_centres(spark.createDataFrame([(1.0,), (1.0,)], "x double"), ["x"], 2, starts=2)


def test_relabel_orders_by_size_then_old_label(spark):
    df = spark.createDataFrame([(i, g) for i, g in enumerate([7, 7, 5, 5, 9, 9, 9])], "id int, g int")
    assert [r["g"] for r in rows(stats.relabel_by_size(df, "g"), "id")] == [3, 3, 2, 2, 1, 1, 1]


def test_nearest_centre_and_profile(spark, frame, points):
    centres = frame.groupBy(F.col("truth").alias("k")).agg(*[F.avg(c).alias(c) for c in "abc"])
    got = rows(stats.nearest_centre(frame, ["a", "b", "c"], centres, "k"), "id")
    assert [r["k"] for r in got] == points["truth"].tolist()
    prof = {(r["truth"], r["feature"]): r for r in rows(stats.group_profile(frame, "truth", ["a", "b"]))}
    want = points.groupby("truth")["a"]
    assert prof[(2, "a")]["mean"] == pytest.approx(want.mean()[2]) and prof[(2, "a")]["sd"] == pytest.approx(want.std()[2])
    assert prof[(1, "b")]["size"] == 60


def test_component_scores_are_uncorrelated(frame):
    scores = M.pca_scores(frame, ["a", "b", "c"], 3).toPandas()[["pc1", "pc2", "pc3"]]
    covariance = np.cov(scores.T)
    assert np.allclose(covariance - np.diag(np.diag(covariance)), 0, atol=1e-8)
    assert np.trace(covariance) == pytest.approx(3.0)
    assert (np.diff(np.diag(covariance)) <= 1e-9).all()


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(4)
    n = 300
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    kind = rng.choice(["p", "q", "r"], n)
    y = 2 + 3 * x1 - x2 + np.where(kind == "q", 5, 0) + rng.normal(size=n)
    z = (0.3 + x1 + rng.normal(size=n) > 0).astype(int)
    return pd.DataFrame({"y": y, "x1": x1, "x2": x2, "kind": kind, "same": 1.0, "z": z})


def test_ols_matches_numpy_with_the_first_level_as_base(spark, regression):
    got = {r["term"]: r for r in rows(M.ols(spark.createDataFrame(regression), "y", ["x1", "x2", "same"], ["kind"]))}
    design = np.column_stack([np.ones(300), regression.x1, regression.x2, regression.kind == "q", regression.kind == "r"]).astype(float)
    beta, rss, *_ = np.linalg.lstsq(design, regression.y.to_numpy(), rcond=None)
    errors = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / (300 - 5))
    for i, term in enumerate(["(Intercept)", "x1", "x2", "kind_q", "kind_r"]):
        assert got[term]["estimate"] == pytest.approx(beta[i], abs=1e-8)
        assert got[term]["std_error"] == pytest.approx(errors[i], rel=1e-6)
        assert got[term]["t_value"] == pytest.approx(beta[i] / errors[i], rel=1e-6)
    assert "same" not in got


def test_a_singular_fit_still_gives_estimates(spark):
    df = spark.createDataFrame([(float(i), float(i), 2.0 * i) for i in range(6)], "y double, a double, b double")
    got = {r["term"]: r["estimate"] for r in rows(M.ols(df, "y", ["a", "b"]))}
    assert got["a"] + 2 * got["b"] == pytest.approx(1.0, abs=1e-4)


def test_closed_form_with_two_regressors_matches_ols(spark, regression):
    df = spark.createDataFrame(regression)
    closed = {r["term"]: r["estimate"] for r in rows(stats.ols_two(df, "y", "x1", "x2"))}
    full = {r["term"]: r["estimate"] for r in rows(M.ols(df, "y", ["x1", "x2"]))}
    assert closed == {k: pytest.approx(full[k], abs=1e-8) for k in closed}
    left = stats.residuals_two(df, "y", "x1", "x2").agg(F.avg("residual"), F.corr("residual", "x1")).first()
    assert abs(left[0]) < 1e-9 and abs(left[1]) < 1e-9


def test_probit_scores_vanish_at_the_estimate(spark, regression):
    got = {r["term"]: r["estimate"] for r in rows(M.probit(spark.createDataFrame(regression), "z", ["x1"]))}
    eta = got["(Intercept)"] + got["x1"] * regression.x1
    cdf = eta.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    density = np.exp(-(eta**2) / 2) / math.sqrt(2 * math.pi)
    weight = (regression.z - cdf) * density / (cdf * (1 - cdf))
    assert abs(weight.sum()) < 1e-3 and abs((weight * regression.x1).sum()) < 1e-3


def test_group_effects_shrink_small_groups_more(spark):
    rng = np.random.default_rng(8)
    data = [(g, float(e + x)) for g, e, n in (("a", 2, 200), ("b", -2, 200), ("c", 2, 3)) for x in rng.normal(size=n)]
    df = spark.createDataFrame(data, "g string, v double")
    raw = {r["g"]: r["m"] for r in rows(df.groupBy("g").agg(F.avg("v").alias("m")))}
    got = {r["level"]: r["effect"] for r in rows(stats.group_effects(df, "v", "g"))}
    kept = {g: got[g] / raw[g] for g in raw}
    assert all(0 < k < 1 for k in kept.values()) and kept["c"] < kept["a"]


def test_normal_quantiles(spark):
    effects = spark.createDataFrame([(f"g{i}", float(x)) for i, x in enumerate([3, 1, 2, 5, 4])], "level string, effect double")
    got = rows(M.normal_qq(effects, "effect", ["level"]), "position")
    assert [r["effect"] for r in got] == [1, 2, 3, 4, 5] and got[0]["normal_quantile"] is None
    from statistics import NormalDist

    want = NormalDist(3, np.std([1, 2, 3, 4, 5], ddof=1))
    assert [r["normal_quantile"] for r in got[1:]] == [pytest.approx(want.inv_cdf(i / 5)) for i in range(1, 5)]


def test_log_features_of_non_positive_values_are_null(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "u double, v double")
    got = rows(stats.log_features(df, {"u": 0.0, "v": 0.01}), "u")
    assert got[0]["log_u"] is None and got[0]["log_v"] == pytest.approx(math.log(0.01)) and got[1]["log_u"] == 0.0


def test_group_apply_runs_a_user_function(spark, frame, points):
    def widest(group):
        return group.nlargest(1, "a")[["truth", "id"]]

    got = rows(group_apply(frame, ["truth"], widest, "truth long, id long"), "truth")
    assert [r["id"] for r in got] == [points[points.truth == t].a.idxmax() for t in (1, 2, 3)]


def test_group_apply_gives_the_frames_of_single_transfers(spark):
    """Groups over several batches, null and NaN keys, and nulls in other groups leave a group's frame as it was."""
    kind = "k double, s string, n long, b boolean, x double, d date"
    data = [
        (k, s, None if k == 1.0 and i % 3 == 0 else 2**60 + i, None if k == 2.0 and i == 1 else i % 2 == 0, None if i == 2 else float(i), None)
        for k in (None, float("nan"), 0.0, -0.0, 1.0, 2.0) for s in (None, "", "u") for i in range(7)
    ]
    df = spark.createDataFrame(data, kind)

    def told(group):
        seen = group.sort_values(["n", "x"])
        assert seen.index.sort_values().tolist() == list(range(len(group)))
        text = [repr((seen.dtypes.astype(str).tolist(), sorted(map(str, seen.drop(columns=["b", "d"]).round(3).itertuples(index=False)))))]
        return pd.DataFrame({"rows": len(group), "text": text})

    schema = "text string, rows long"
    want = rows(df.groupBy("k", "s").applyInPandas(told, schema), "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = group_apply(df, ["k", "s"], told, schema)
        assert rows(got, "text") == want and len(want) == 15
        assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
        assert group_apply(df.limit(0), ["k"], told, schema).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_class_features_name_their_logs():
    assert classes.logs_of({"rank_mean": 0.0}) == ["log_rank_mean"]
