"""Links by collision counting against all pairs."""

import math

import numpy as np
import pytest

from pricepanel.llm import embedding_links as el

KIND = "vec_id long, embedding array<{0}>, label {1}, root long, k string"


def brute(rows, cosine=0.93):
    """n_links and component of each row, by all pairs in double precision."""
    units = []
    for _, v, label in rows:
        sound = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / np.abs(np.array(v, float)).max() if sound else None
        units.append(x / np.linalg.norm(x) if sound else None)
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]):
                near[i, j] = near[j, i] = units[i] @ units[j] >= cosine
    group = list(range(n))
    for i in range(n):
        for j in np.flatnonzero(near[i]):
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            least[group[i]] = min(vec, least.get(group[i], vec))
    return sorted(((rows[i][0], int(near[i].sum()), least.get(group[i]), rows[i][0] == least.get(group[i])) for i in range(n)), key=str)


def table(spark, rows, element="float", label="int"):
    return spark.createDataFrame([(i, v, c, 7, "x") for i, v, c in rows], KIND.format(element, label))


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clustered(seed, n, dim=16, noise=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    return [
        (int(i), [float(np.float32(x)) for x in centres[rng.integers(len(centres))] + noise * rng.standard_normal(dim)], int(rng.integers(3)))
        for i in range(n)
    ]


@pytest.mark.parametrize("noise, block", [(0.1, 1 << 14), (0.22, 1 << 14), (0.22, 40)])
def test_links_equal_all_pairs(spark, noise, block):
    rows = clustered(3, 400, noise=noise)
    rows += [(1000 + k, rows[k % 5][1], rows[k % 5][2]) for k in range(60)]  # copies
    assert got(el.linked(table(spark, rows), block=block)) == brute(rows)


def test_odd_vectors_link_with_nothing(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 1), (2, [2.0, 4.0, 6.0], 1), (3, one, None), (4, one, None), (5, None, 1), (6, [], 1), (7, [0.0, -0.0, 0.0], 1), (8, [0.0, 0.0, 0.0], 1),
        (9, [1.0, None, 3.0], 1), (10, [float("nan"), 1.0, 1.0], 1), (11, [float("inf"), 1.0, 1.0], 1), (12, one, 2), (13, [1.0, 2.0, 3.0, 0.0], 1),
        (None, one, 1), (None, [5.0, 0.0, 0.0], 4), (20, [9.0, 1.0, 0.0], 5), (20, [9.0, 1.0, 0.0], 5), (20, [0.0, 1.0, 9.0], 5),
    ]
    found = got(el.linked(table(spark, rows)))
    for row in brute(rows):
        if row[0] is not None:
            assert row in found
    assert (None, 2, 1, False) in found and (None, 0, None, True) in found and len(found) == len(rows)


def test_double_vectors_of_any_size_and_text_labels(spark):
    rows = [(1, [1e300, 1e300], "a"), (2, [1e-300, 1e-300], "a"), (3, [1e300, -1e300], "a"), (4, [1.0, 1.0], "b")]
    assert got(el.linked(table(spark, rows, "double", "string"))) == brute(rows)


def test_empty_table(spark):
    assert el.linked(table(spark, [])).collect() == []


def test_one_label_of_many_copies_and_one_group(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(32)
    rows = [(i, (centre + 0.02 * rng.standard_normal(32)).tolist(), 1) for i in range(1500)] + [(5000 + i, centre.tolist(), 1) for i in range(1500)]
    found = el.linked(table(spark, rows), block=600).collect()
    assert {(r["n_links"], r["component_id"]) for r in found} == {(2999, 0)} and sum(r["kept"] for r in found) == 1


def test_recall_at_the_threshold_and_few_candidates():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.93001 * a + math.sqrt(1 - 0.93001**2) * side
    counts, links = el.tile_links(np.vstack([a, b]), np.ones(6000), 3000)
    assert (counts[:3000] == 1).mean() >= 0.998 and links.shape[1] == counts[:3000].sum()
    projected = (np.vstack([a, b]) @ el.directions(64)).T
    passing = el.Prefixes(projected[:, 3000:]).colliding(projected[:, :3000], el.WINDOW * math.sqrt(0.14), el.least_count())
    assert np.bitwise_count(passing).sum() < 0.01 * 3000 * 3000


def test_counters_equal_plain_counts():
    rng = np.random.default_rng(2)
    points, queries = rng.standard_normal((31, 150)), rng.standard_normal((31, 40))
    plain = (np.abs(points[:, None, :] - queries[:, :, None]) <= 0.7).sum(axis=0)
    for least in (1, 8, 13, 22, 31):
        bits = el.Prefixes(points).colliding(queries, 0.7, least)
        assert (np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, :150].view(bool) == (plain >= least)).all()
