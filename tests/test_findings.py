"""Whole jobs beyond the size of one task, against plain ways."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from veracast.operators import features


def vectors(spark, x: np.ndarray):
    return spark.createDataFrame([(i, [float(z) for z in row]) for i, row in enumerate(x)], "id long, v array<double>")


def test_intrinsic_distance_without_spectra(spark):
    rng = np.random.default_rng(1)
    a, b = vectors(spark, rng.normal(size=(150, 4))), vectors(spark, rng.normal(size=(131, 4)) ** 3)
    assert features.intrinsic_distance(a, b, most=10).first().value == pytest.approx(features.intrinsic_distance(a, b).first().value, abs=2e-9)
    times = np.logspace(-1, 1, 9)
    assert np.allclose(features._heat(a, 5, times, 10), features._heat(a, 5, times, 1000), rtol=0, atol=1e-13)


def test_geometry_score_of_many_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_100, 2))
    got = features.living_times(vectors(spark, x), 2, 8)
    want = []
    for k in range(2):
        chosen = np.random.default_rng([0, k]).choice(len(x), 8, replace=False)
        want.append(features.holes(x, chosen, float(features.distances(x[chosen], x[chosen]).max()), 100))
    assert np.allclose(got, np.mean(want, axis=0), rtol=0, atol=1e-12)


def test_additive_chi_square_without_pairs(spark):
    rng = np.random.default_rng(3)
    x, y = (np.round(rng.lognormal(0, [0.1, 3, 9, 1, 1], (n, 5)) * [1e3, 1, 1e-3, 1, 0], 6) for n in (90, 70))
    x[:9], y[3:5] = 0, 1e-6
    k = lambda a, b: features._additive_chi2(a, b).mean()
    want = k(x, x) + k(y, y) - 2 * k(x, y)
    found = features.additive_chi2_mmd(vectors(spark, x), vectors(spark, y))
    assert found is not None and found.first().value == pytest.approx(want, rel=1e-12, abs=1e-6)
    # a negative number: by pairs
    x[0, 0] = -0.5
    want = k(x, x) + k(y, y) - 2 * k(x, y)
    assert features.additive_chi2_mmd(vectors(spark, x), vectors(spark, y)) is None
    assert features.mmd(vectors(spark, x), vectors(spark, y), "additive_chi2").first().value == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("kernel", ["chi2", "laplacian", "rbf", "multi_gaussian"])
@pytest.mark.parametrize("scale", [1.0, 1e4])  # in single and in double precision
def test_kernels_over_half_the_pairs(spark, kernel, scale, monkeypatch):
    from veracast.functions import blocks

    rng = np.random.default_rng(4)
    x, y = (np.abs(rng.normal(size=(200, 3))) * 0.3 + s for s in (0, 0.1))
    x[:3], x[5] = [0, 0.2, scale], x[6]
    monkeypatch.setattr(blocks, "MOST", 1600)  # three rows of cells and more
    d = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(-1)
    both = np.concatenate([x, y])
    width = [2 * 2.0**e * d(both, both).mean() for e in range(-3, 2)]
    k = {
        "chi2": lambda a, b: np.exp(features._additive_chi2(a, b)),
        "laplacian": lambda a, b: np.exp(-np.abs(a[:, None] - b[None]).sum(-1) / 3),
        "rbf": lambda a, b: np.exp(-d(a, b) / 3),
        "multi_gaussian": lambda a, b: sum(np.exp(-d(a, b) / w) for w in width),
    }[kernel]
    n = len(x)
    if kernel == "multi_gaussian":
        want = sum(k(a, a)[~np.eye(n, dtype=bool)].sum() for a in (x, y)) / (n * (n - 1)) - 2 * k(x, y).mean() + 2 / (n - 1)
    else:
        want = k(x, x).mean() + k(y, y).mean() - 2 * k(x, y).mean()
    pairs = []
    old = features.over_pairs
    monkeypatch.setattr(features, "over_pairs", lambda *a, **b: (pairs.append(b.get("half")), old(*a, **b))[1])
    assert features.mmd(vectors(spark, x), vectors(spark, y), kernel, size=64).first().value == pytest.approx(want, abs=1.5e-6)
    assert pairs == [True, True, False]


@pytest.mark.parametrize("width", [1, 2, 3])
def test_nearest_points_against_all_pairs(spark, width, monkeypatch):
    from veracast.functions import near
    from veracast.operators import synthesis

    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=(900, width)), 1), np.round(rng.normal(size=(500, width)) * 1.5, 1)
    x[:3] = [[40.0] * width] * 3
    x[3], y[:5] = -50.0, 60.0
    columns = [f"c{i}" for i in range(width)]
    frame = lambda z: spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(z)], f"id long, {', '.join(f'{c} double' for c in columns)}")
    monkeypatch.setattr(synthesis, "nearest", lambda *a: near.nearest(*a, leaf=30))
    monkeypatch.setattr(synthesis, "over_pairs", None)  # all pairs aren't met
    real = frame(x)
    for query, rows, itself in ((real, x, True), (frame(y), y, False)):
        d = np.sqrt(((rows[:, None] - x[None]) ** 2).sum(-1))
        if itself:
            np.fill_diagonal(d, np.inf)
        want = np.sort(d, axis=1)[:, :2]
        got = synthesis.nearest_two(query, real, "id", columns, itself).orderBy("_q").collect()
        assert [r._q for r in got] == list(range(len(rows)))
        assert np.allclose([(r.d1, r.d2) for r in got], want, rtol=1e-12, atol=0)


def test_knn_filling_by_kinds_of_rows(spark, monkeypatch):
    from veracast.functions import near
    from veracast.operators import prepare

    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 1, (400, 3)) * [1, 50, 2], 0)  # many equal distances
    x[rng.random(x.shape) < 0.25] = np.nan
    df = spark.createDataFrame([(i, *(None if np.isnan(z) else float(z) for z in row)) for i, row in enumerate(x)], "id long, a double, b double, c double")
    found = lambda: [tuple(r) for r in prepare.impute_knn(df, "id", ["a", "b", "c"], 3).orderBy("id").collect()]
    monkeypatch.setattr(prepare, "FEW", 0)
    want = found()  # over all pairs
    monkeypatch.setattr(prepare, "FEW", 6)
    monkeypatch.setattr(prepare, "over_pairs", None)
    monkeypatch.setattr(prepare, "nearest", lambda *a: near.nearest(*a, leaf=40))
    assert np.allclose(found(), want, rtol=1e-12)


def test_a_cell_adds_up_what_its_blocks_find(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x, y = (vectors(spark, rng.normal(size=(600, 2))) for _ in range(2))
    made, old = [], features.over_pairs
    monkeypatch.setattr(features, "over_pairs", lambda *a, **b: (made.append(old(*a, **b)), made[-1])[1])
    found = features.neighbourhoods(x, y, size=8).collect()
    assert len(found) == 1200 and made[-1].count() < 25_000  # 48,000 of all blocks
    plain = lambda rows: np.array(sorted(map(tuple, rows)), float)
    assert np.allclose(plain(found), plain(features.neighbourhoods(x, y).collect()), rtol=1e-9)


def test_densities_hold_a_small_part(spark, monkeypatch):
    from veracast.operators import synthesis

    x = spark.range(5000).select((F.col("id") % 2).cast("int").alias("syn"), (F.col("id") / 7).alias("x"))
    found = [tuple(r) for r in synthesis.densities(x).orderBy("g").collect()]
    assert synthesis.PART * synthesis.GRID * 8 <= 1 << 22  # bytes of a part's kernels
    monkeypatch.setattr(synthesis, "PART", 8192)
    assert np.allclose(found, [tuple(r) for r in synthesis.densities(x).orderBy("g").collect()], rtol=1e-12)


@pytest.mark.parametrize("size", [0.02, 60.0])  # a plan is found; some spectra are too far from all others
def test_spectral_plan_in_many_tasks(spark, size):
    from veracast.operators import timeseries

    rng = np.random.default_rng(8)
    long = lambda x: spark.createDataFrame([(i, c, t, float(v)) for i, one in enumerate(x) for t, row in enumerate(one) for c, v in enumerate(row)], "signal long, channel int, t long, v double")
    for channels in (1, 2):
        r, t = long(rng.normal(size=(40, 16, channels)) * size), long(rng.normal(size=(30, 16, channels)) * size)
        want = timeseries.spectral_wasserstein(r, t, 2).first().value
        assert timeseries.spectral_wasserstein(r, t, 2, most=5).first().value == pytest.approx(want, rel=1e-6, abs=1e-12)


@pytest.mark.parametrize("n, m, width, grid", [(90, 60, 2, True), (70, 70, 40, False)])  # True: many equal vectors
def test_transport_in_many_tasks(spark, n, m, width, grid):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(n, width)), rng.normal(size=(m, width)) * 1.5 + 0.3
    x, y = (vectors(spark, np.round(z) if grid else z) for z in (x, y))
    want = features.wasserstein(x, y).first().value
    assert features.wasserstein(x, y, most=5).first().value == pytest.approx(want, abs=1.1e-6)
    fewer = features._cheapest(x, y, *(int(np.lcm(n, m)) // z for z in (n, m)), k=1)  # edges have to be found by prices
    assert fewer == pytest.approx(want, abs=1.1e-6)


def test_transport_beyond_one_task(spark):
    x = np.random.default_rng(10).normal(size=(3100, 3))
    assert features.wasserstein(vectors(spark, x), vectors(spark, x[::-1] + [0.5, 0, -1])).first().value == 1.25
    z = np.arange(101.0)[:, None]  # 101 and 97 have 9,797 as least common multiple
    want = ((np.repeat(z[:, 0], 97) - np.repeat(z[:97, 0], 101)) ** 2).mean()
    assert features.wasserstein(vectors(spark, z), vectors(spark, z[:97])).first().value == pytest.approx(want, abs=1e-6)
    with pytest.raises(ValueError):
        features.wasserstein(vectors(spark, np.full((3100, 2), np.nan)), vectors(spark, x[:, :2]))
