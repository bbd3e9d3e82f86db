"""Crossed random effects against dense algebra."""

import numpy as np
import pytest

from helpers import rows
from pricepanel.operators import mixed

KIND = "seller string, isbn long, y double, x1 double, x2 double"


def panel(seed, sellers, products, n, sd=(0.8, 0.5, 1.0)):
    rng = np.random.default_rng(seed)
    a, b = sd[0] * rng.standard_normal(sellers), sd[1] * rng.standard_normal(products)
    i, j = rng.integers(sellers, size=n) ** 2 // sellers, rng.integers(products, size=n)
    x1, x2 = rng.standard_normal(n) + 3, (rng.random(n) < 0.3).astype(float)
    y = 2 + 0.7 * x1 - 1.5 * x2 + a[i] + b[j] + sd[2] * rng.standard_normal(n)
    return [(f"s{p}", int(q), float(v), float(u), float(w)) for p, q, v, u, w in zip(i, j, y, x1, x2)]


def dense(data, terms=(3, 4)):
    """Components, effects and fixed effects by expectation steps of REML on full matrices, run to rest."""
    y = np.array([r[2] for r in data])
    x = np.column_stack([np.ones(len(y)), *[[r[t] for r in data] for t in terms]])
    names = [sorted({r[c] for r in data}) for c in (0, 1)]
    z = [np.array([[r[c] == name for name in names[c]] for r in data], float) for c in (0, 1)]
    variance, residual = np.array([1.0, 1.0]), 1.0
    for _ in range(4000):
        v = residual * np.eye(len(y)) + sum(s * m @ m.T for s, m in zip(variance, z))
        inverse = np.linalg.inv(v)
        fixed = np.linalg.inv(x.T @ inverse @ x)
        p = inverse - inverse @ x @ fixed @ x.T @ inverse
        py = p @ y
        # the gradient's zero: tr(P V_k) = y' P V_k P y
        new = np.array([s * (py @ m @ m.T @ py) / np.trace(p @ m @ m.T) for s, m in zip(variance, z)])
        new_residual = residual * (py @ py) / np.trace(p)
        done = np.abs(np.append(new - variance, new_residual - residual)).max() < 1e-10
        variance, residual = new, new_residual
        if done:
            break
    effects = {(c, str(name)): float(e) for c, m, s in zip((0, 1), z, variance) for name, e in zip(names[c], s * m.T @ py)}
    return variance, residual, fixed @ x.T @ inverse @ y, np.sqrt(np.diag(fixed)), effects


def test_fit_equals_a_dense_solve(spark):
    data = panel(1, 14, 9, 260)
    fit = mixed.crossed_effects(spark.createDataFrame(data, KIND), "y", ["x1", "x2"], "seller", "isbn", probes=32, tolerance=1e-4)
    variance, residual, beta, errors, effects = dense(data)
    got = {(0 if r["factor"] == "seller" else 1, r["level"]): r["effect"] for r in rows(fit.effects)}
    assert got.keys() == effects.keys()
    assert max(abs(got[k] - effects[k]) for k in got) < 1e-4
    assert np.allclose([fit.components["seller"], fit.components["isbn"], fit.components["residual"]], [*variance, residual], atol=1e-4)
    assert np.allclose([f[1] for f in fit.fixed], beta, atol=1e-4) and np.allclose([f[2] for f in fit.fixed], errors, atol=1e-4)
    assert fit.rounds[-1]["moved"] < 1e-4 and len(fit.rounds) < 15 and max(r["steps"] for r in fit.rounds) <= 12


def test_few_levels_are_solved_in_one_step_with_the_results_of_the_gradients(spark, monkeypatch):
    """Where one factor has few levels its equations are solved directly; the effects are those of the iteration."""
    df = spark.createDataFrame(panel(4, 20, 4, 200), KIND)
    fits = []
    for most in (128, 0):
        monkeypatch.setattr(mixed, "DENSE", most)
        fits.append(mixed.crossed_effects(df, "y", ["x1", "x2"], "seller", "isbn", probes=32, tolerance=0.05))
    one, two = ([(r["factor"], r["level"], r["n"], r["effect"]) for r in rows(f.effects, "factor", "level")] for f in fits)
    assert [x[:3] for x in one] == [x[:3] for x in two] and np.allclose([x[3] for x in one], [x[3] for x in two], atol=1e-5)
    assert {r["steps"] for r in fits[0].rounds} == {1} and fits[1].rounds[0]["steps"] > 1


def test_probed_traces_come_near_with_many_levels(spark):
    data = panel(2, 60, 40, 500)
    fit = mixed.crossed_effects(spark.createDataFrame(data, KIND), "y", ["x1", "x2"], "seller", "isbn", probes=16, tolerance=0.02)
    variance, residual, _, _, effects = dense(data)
    assert np.allclose([fit.components["seller"], fit.components["isbn"], fit.components["residual"]], [*variance, residual], rtol=0.05)
    got = {(0 if r["factor"] == "seller" else 1, r["level"]): r["effect"] for r in rows(fit.effects)}
    assert max(abs(got[k] - effects[k]) for k in got) < 0.05


def test_a_factor_without_variance_has_no_effects(spark, monkeypatch):
    monkeypatch.setattr(mixed, "MAX_ROUNDS", 8)  # its variance falls with each round
    rng = np.random.default_rng(3)
    data = [(f"s{k % 6}", k // 6 % 5, float(10 * (k % 6) + e), 0.0, 0.0) for k, e in enumerate(np.tile([1.0, -1.0], 90) * rng.permuted(np.ones(180)))]
    data += [(None, 1, 5.0, 0.0, 0.0), ("s1", 2, None, 0.0, 0.0)]
    fit = mixed.crossed_effects(spark.createDataFrame(data, KIND), "y", [], "seller", "isbn", probes=16, tolerance=0.3)
    assert fit.components["isbn"] < 0.1 * fit.components["residual"] and fit.components["seller"] > 1
    assert all(abs(r["effect"]) < 0.05 for r in rows(fit.effects) if r["factor"] == "isbn")
    assert fit.effects.count() == 11


def test_odd_input_is_refused(spark):
    empty = spark.createDataFrame([], KIND)
    with pytest.raises(ValueError):
        mixed.crossed_effects(empty, "y", [], "seller", "isbn")
    with pytest.raises(ValueError):
        mixed.crossed_effects(empty, "y", [], "seller", "isbn", probes=12)
