"""Weighted statistics, exact quantiles and global positions against numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from pricepanel.functions.ordered import total_before, with_position
from pricepanel.functions.quantiles import exact_quantiles
from pricepanel.functions.weighted import weighted_mean, weighted_sd, with_centres

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def spread_of(spark, data, **kw):
    df = spark.createDataFrame(data, "k string, x double, w int")
    out = with_centres(df, ["k"], ["x"], "w", **kw).groupBy("k").agg(
        weighted_sd("x", "w", **kw).alias("sd"), weighted_mean("x", "w").alias("mean")
    )
    return {r["k"]: r for r in rows(out)}


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.floats(1, 1000), st.integers(1, 9)), min_size=1, max_size=30))
def test_weighted_sd_equals_the_sd_of_repeated_values(spark, data):
    got = spread_of(spark, data)
    for k in {d[0] for d in data}:
        repeated = np.repeat([d[1] for d in data if d[0] == k], [d[2] for d in data if d[0] == k])
        assert got[k]["mean"] == pytest.approx(repeated.mean())
        if len(repeated) > 1:
            assert got[k]["sd"] == pytest.approx(repeated.std(ddof=1), abs=1e-7)
        else:
            assert got[k]["sd"] is None


def test_null_values_count_in_the_weights_unless_skipped(spark):
    data = [("a", 1.0, 2), ("a", 3.0, 2), ("a", None, 4)]
    literal = spread_of(spark, data)["a"]
    centre = (2 * 1 + 2 * 3) / 8
    assert literal["sd"] == pytest.approx(((2 * (1 - centre) ** 2 + 2 * (3 - centre) ** 2) / 7) ** 0.5)
    assert literal["mean"] == pytest.approx(2.0)
    assert spread_of(spark, data, skip_null_weights=True)["a"]["sd"] == pytest.approx(np.std([1, 1, 3, 3], ddof=1))


def test_tiny_spread_on_a_large_level_survives(spark):
    data = [("a", 1e9 + d, 1) for d in (0.0, 1.0, 2.0)]
    assert spread_of(spark, data)["a"]["sd"] == pytest.approx(1.0)


@SLOW
@given(st.lists(st.one_of(st.integers(0, 6).map(float), st.floats(-50, 50)), min_size=1, max_size=60), st.integers(2, 9))
def test_exact_quantiles_match_numpy_for_any_number_of_bins(spark, values, bins):
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["prob"]: r["quantile"] for r in rows(exact_quantiles(df, ["x"], probs, bins=bins, cell_rows=3))}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_heavy_tails_are_cut_again(spark):
    values = [float(2**i) for i in range(40)] + [float(i) for i in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = rows(exact_quantiles(df, ["x"], [0.25, 0.5], bins=8, cell_rows=4), "prob")
    assert [r["quantile"] for r in got] == [np.quantile(values, 0.25), np.quantile(values, 0.5)]


def test_every_cell_stays_under_its_bound(spark, monkeypatch):
    """Many distinct values with far outliers: no window sees more values than allowed."""
    from pricepanel.functions import quantiles

    n, bound, cuts = 300_000, 2000, []
    df = spark.range(n).selectExpr("CASE id WHEN 0 THEN 1e300 WHEN 1 THEN -1e300 ELSE exp(pmod(id * 7919, 300000) / 1e4) END AS x", "id % 2 AS k")
    cut = quantiles._cut

    def watched(counts, targets, cell, parts):
        counts, targets = cut(counts, targets, cell, parts)
        cuts.append(counts.groupBy(*cell).count().agg(F.max("count")).first()[0])
        return counts, targets

    monkeypatch.setattr(quantiles, "_cut", watched)
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(r["k"], r["prob"]): r["quantile"] for r in rows(exact_quantiles(df, ["x"], probs, keys=["k"], bins=32, cell_rows=bound))}
    frame = df.toPandas()
    assert got == {(k, p): pytest.approx(np.quantile(frame.x[frame.k == k], p), rel=1e-12) for k in (0, 1) for p in probs}
    assert len(cuts) >= 2 and cuts[-1] <= bound


@SLOW
@given(st.dictionaries(st.tuples(st.sampled_from("xy"), st.integers(0, 60)), st.integers(0, 9), min_size=1), st.integers(1, 20))
def test_total_before_matches_a_running_sum(spark, cells, slice_size):
    df = spark.createDataFrame([(k, o, v) for (k, o), v in cells.items()], "k string, o int, v int")
    got = {(r["k"], r["o"]): r["t"] for r in rows(total_before(df, ["k"], "o", "v", "t", slice_size))}
    assert got == {(k, o): sum(v for (k2, o2), v in cells.items() if k2 == k and o2 < o) for k, o in cells}


def test_exact_quantiles_by_group_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None), ("b", 7.0)], "k string, x double")
    got = {r["k"]: r["quantile"] for r in rows(exact_quantiles(df, ["x"], [0.9], keys=["k"]))}
    assert got == {"a": pytest.approx(3.6), "b": 7.0}


@SLOW
@given(st.lists(st.integers(0, 20).map(float), min_size=1, max_size=40), st.integers(2, 7))
def test_positions_match_a_sort(spark, values, bins):
    df = spark.createDataFrame(list(enumerate(values)), "id int, x double")
    got = [r["id"] for r in rows(with_position(df, "x", ["id"], bins=bins), "position")]
    assert got == [i for i, _ in sorted(enumerate(values), key=lambda t: (t[1], t[0]))]
    assert [r["position"] for r in rows(with_position(df, "x", ["id"], bins=bins), "position")] == list(range(1, len(values) + 1))
