"""Ways of computing that serve large inputs, against plain ones."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracast.functions import blocks
from veracast.functions.quantiles import percentiles
from veracast.operators import extract, features, images, prepare, synthesis
from veracast.sources import signals
from veracast.sources.tables import table_of


def vectors(spark, x: np.ndarray):
    return spark.createDataFrame([(i, [float(z) for z in row]) for i, row in enumerate(x)], "id long, v array<double>")


def value(df, **where):
    return next(r.value for r in df.collect() if all(getattr(r, k) == w for k, w in where.items()) and (where or r.stat is None))


def test_percentiles_do_not_depend_on_the_number_of_rows(spark):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(0, 1e6, 300), rng.normal(0, 1e-6, 300), [7.0] * 200])
    b = rng.integers(0, 3, 800).astype(float)
    rows = [(float(x), float(y), None) for x, y in zip(a, b)] + [(float("nan"), None, None)] * 60 + [(None, float("nan"), None)] * 40
    df = spark.createDataFrame(rows, "a double, b double, c double")
    points = [0.0, 0.01, 0.25, 0.5, 0.75, 0.333, 1.0]
    for direct in (10, 1_000_000):
        one = percentiles(df, ["a", "b", "c"], points, direct).first()
        assert np.allclose(one.a, np.quantile(a, points), rtol=1e-12) and np.allclose(one.b, np.quantile(b, points)) and not any(x is not None for x in one.c or [])
    wide = spark.createDataFrame([(x,) for x in (-1.7e308, 1.7e308, 0.0, 1.0)], "a double")
    assert percentiles(wide, ["a"], [0.0, 1.0], 1).first().a == [-1.7e308, 1.7e308]
    few = spark.createDataFrame([(x,) for x in [*map(float, range(1, 11)), *[float("nan")] * 6]], "a double")
    assert percentiles(few, ["a"], [0.25, 0.5, 0.75], 0).first() == percentiles(few, ["a"], [0.25, 0.5, 0.75]).first()


def test_profile_counts_exactly(spark):
    df = spark.range(6000).select(F.col("id"), F.concat(F.lit("k"), F.col("id") % 2500).alias("many"), F.concat(F.lit("k"), F.col("id") % 1000).alias("some"), (F.col("id") % 3 / 2).alias("x"), F.lit(None).cast("string").alias("none"))
    p = {r.column: r for r in prepare.profile(df).collect()}
    assert p["many"].n_options == 2500 and p["many"].options is None and p["some"].n_options == len(p["some"].options) == 1000
    assert p["x"].options == ["0", "0.5", "1"] and p["id"].tag == "continuous" and p["none"].n_options == 0
    assert prepare.options(df, "many").count() == 2500 and prepare.options(df, "none").count() == 0


def test_fitted_values_fill_other_tables(spark):
    base = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (10.0, None)], "x double, k string")
    made = prepare.Prepared.fit(base, ["x", "k"], "identity", "median")
    got = made.transform(spark.createDataFrame([(1, 100.0, "b"), (2, None, None)], "id long, x double, k string"), keep=("id",)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 100.0, None), (2, 2.0, 1.0)]
    hot = prepare.Prepared.fit(base, ["x"], "identity", "mean", one_hot=True)  # no text column
    assert hot.transform(base).columns == ["x_OR"]
    with pytest.raises(ValueError, match="options"):
        prepare.Encoder.fit(spark.range(300).select(F.col("id").cast("string").alias("k")), ["k"], most=100)


def test_knn_filling_against_loops(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 1, (90, 3)) * [1, 50, 3], 2)
    x[rng.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([(i, *(None if np.isnan(z) else float(z) for z in row)) for i, row in enumerate(x)], "id long, a double, b double, c double")
    got = np.array([[r.a, r.b, r.c] for r in prepare.impute_knn(df, "id", ["a", "b", "c"], 3).orderBy("id").collect()])
    z = (x - np.nanmean(x, 0)) / np.nanstd(x, 0)
    want = x.copy()
    for i, j in zip(*np.nonzero(np.isnan(x))):
        near = []
        for o in range(len(x)):
            both = ~np.isnan(z[i]) & ~np.isnan(z[o])
            if o != i and not np.isnan(x[o, j]) and both.any():
                near.append((math.sqrt(((z[i] - z[o])[both] ** 2).sum() * 3 / both.sum()), o))
        want[i, j] = np.mean([x[o, j] for _, o in sorted(near)[:3]]) if near else np.nanmean(x[:, j])
    assert np.allclose(got, want)


def test_every_pair_meets_once(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(700, 3)), rng.normal(size=(300, 3))
    for most in (blocks.MOST, 3000):  # few or many cells
        old, blocks.MOST = blocks.MOST, most
        try:
            import pyarrow as pa

            run = lambda a, b: pa.RecordBatch.from_arrays([pa.array(np.repeat(a[0], len(b[0]))), pa.array(np.tile(b[0], len(a[0]))), pa.array(blocks.distances(a[1], b[1]).ravel())], ["u", "v", "d"])
            got = blocks.over_pairs(vectors(spark, x), vectors(spark, y), run, "u long, v long, d double", 64, 100).toPandas()
        finally:
            blocks.MOST = old
        assert len(got) == 210_000 and not got.duplicated(["u", "v"]).any()
        assert np.allclose(got["d"], np.linalg.norm(x[got["u"]] - y[got["v"]], axis=1))


def test_distances_without_cancellation():
    rng = np.random.default_rng(4)
    x = rng.normal(1e6, 1, (50, 8))
    y = np.concatenate([x[:20], x[20:40] + 1e-9, rng.normal(1e6, 1, (9, 8))])
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    got = blocks.distances(x, y)
    assert np.allclose(got, want, rtol=1e-6, atol=0) and (np.diag(got)[:20] == 0).all()


def test_shared_context(spark):
    rng = np.random.default_rng(5)
    r, t = vectors(spark, rng.normal(size=(60, 4))), vectors(spark, rng.normal(0.3, 1, size=(60, 4)))
    with features.Context(r, t) as context:
        every = {x.key: x.value for x in features.neighbour_metrics(context.neighbourhoods()).collect()}
        for name, got in every.items():
            assert got == value(context.metric(name))
        assert context.neighbourhoods() is context.neighbourhoods(5) and context.neighbourhoods(3) is not context.neighbourhoods(5)
        assert value(features.frechet(r, t, context)) == value(features.frechet(r, t))
    x, y = (np.array([v.v for v in df.orderBy("id").collect()]) for df in (r, t))
    s1, s2 = np.cov(x.T), np.cov(y.T)
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(s1 + s2) - 2 * np.sqrt(np.maximum(np.linalg.eigvals(s1 @ s2).real, 0)).sum()
    assert value(features.frechet(r, t)) == pytest.approx(want, abs=1e-5)


def test_positions_and_halves(spark):
    df = spark.range(0, 3001, 1, 7).select((F.col("id") * F.col("id")).alias("id"), F.col("id").alias("v"))
    assert all(r.v == r.pos for r in features.positions(df, 16).collect())
    names = spark.createDataFrame([(f"k{i:03}", i) for i in range(300)], "id string, v long").repartition(5)
    assert all(r.v == r.pos for r in features.positions(names, 9).collect()) and features.positions(names.limit(0)).count() == 0
    a, b = (set(r.id for r in x.collect()) for x in features.split_halves(df, 4))
    assert len(a) == len(b) == 1500 and not a & b and a != set(r.id for r in features.split_halves(df, 5)[0].collect())
    r = vectors(spark, np.random.default_rng(6).normal(size=(50, 2)))
    assert value(features.ratios(features.mmd_linear, r, r, seed=1), stat="dispersion_ratio") == 1.0


def test_kendall_against_pairs(spark):
    rng = np.random.default_rng(7)
    x = np.stack([rng.normal(size=400), rng.integers(0, 4, 400), rng.integers(0, 60, 400) / 7], axis=1)
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], "a double, b double, c double")
    sign = np.sign(x[:, None] - x[None])
    for cells in (1, 7, 256):
        got = synthesis._kendall(df, ["a", "b", "c"], cells).first()
        for i, j in itertools.combinations(range(3), 2):
            want = (sign[..., i] * sign[..., j]).sum() / math.sqrt((sign[..., i] ** 2).sum() * (sign[..., j] ** 2).sum())
            assert got[f"r_{i}_{j}"] == pytest.approx(want, abs=1e-12)
    assert synthesis._kendall(df.withColumn("b", F.lit(1.0)), ["a", "b"]).first()[0] is None


def test_densities_against_loops(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=500), rng.normal(1, 2, 300).round(1)
    rows = [("k", 0, float(v)) for v in x] + [("k", 1, float(v)) for v in y] + [("one", 0, 2.0)] * 3 + [("one", 1, float(v)) for v in y] + [("k", 0, None), ("k", 1, float("nan"))]
    got = synthesis.densities_of(spark.createDataFrame(rows, "key string, syn int, x double")).toPandas().sort_values("g")
    at = np.linspace(min(x.min(), y.min()), max(x.max(), y.max()), 300)
    for side, v in (("p", x), ("q", y)):
        h = v.std(ddof=1) * len(v) ** -0.2
        k = np.exp(-0.5 * ((v[:, None] - at[None]) / h) ** 2).sum(0)
        assert np.allclose(got[got["key"] == "k"][side], k / k.sum())
    one = got[got["key"] == "one"]
    assert one["p"].sum() == 1 and one["p"].max() == 1 and abs(one["at"].to_numpy()[one["p"].to_numpy().argmax()] - 2) < 0.05


def test_alignments_against_the_table():
    from veracast.operators import timeseries

    rng = np.random.default_rng(15)
    for n, m in ((1, 1), (1, 7), (7, 1), (9, 9), (12, 5), (5, 12)):
        a, b = rng.normal(size=(4, n)), rng.normal(size=(4, m))
        want = []
        for x, y in zip(a, b):
            cost = np.full((n + 1, m + 1), np.inf)
            cost[0, 0] = 0
            for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
                cost[i, j] = abs(x[i - 1] - y[j - 1]) + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
            want.append(cost[n, m])
        assert np.allclose(timeseries._warped_all(a, b), want) and timeseries.warped(a[0], b[0]) == pytest.approx(want[0])
    assert math.isnan(timeseries.warped(np.zeros(0), np.ones(3)))


def test_formats_of_samples():
    x = np.array([0, 1, -1, 2047, -2048, 77, -300])
    two = b""
    for i in range(0, 8, 2):
        a, b = (int(v) & 0xFFF for v in (x[i], x[i + 1] if i + 1 < 7 else 0))
        two += bytes([a & 255, (a >> 8) | ((b >> 8) << 4), b & 255])
    assert signals.samples(two, 212)[:7].tolist() == x.tolist()
    assert signals.samples(b"".join(int(v).to_bytes(3, "little", signed=True) for v in x), 24).tolist() == x.tolist()
    for kind, order in ((16, "<i2"), (61, ">i2"), (32, "<i4")):
        assert signals.samples(x.astype(order).tobytes(), kind).tolist() == x.tolist()
    assert signals.samples(bytes([128, 0, 255]), 80).tolist() == [0, -128, 127]
    with pytest.raises(ValueError, match="310"):
        signals.samples(b"abc", 310)


def test_records_of_several_files(spark, tmp_path):
    (tmp_path / "r1.hea").write_text("r1 3 100 4\na.dat 16 200(0)/mV 16 0 0 0 0 I\nb.dat 212 100(10)/mV 12 0 0 0 0 II\na.dat 16 200(0)/mV 16 0 0 0 0 III\n")
    (tmp_path / "a.dat").write_bytes(np.array([[200, 1], [400, 2], [600, 3], [800, 4]], "<i2").tobytes())
    (tmp_path / "b.dat").write_bytes(b"".join(bytes([a & 255, (a >> 8) | ((b >> 8) << 4), b & 255]) for a, b in ((10, 110), (210, 310))))
    got = {(r.channel, r.t): r.v for r in signals.read_signals(spark, str(tmp_path)).collect()}
    assert [got[0, t] for t in range(4)] == [1, 2, 3, 4] and [got[1, t] for t in range(4)] == [0, 1, 2, 3] and got[2, 3] == 4 / 200 and len(got) == 12
    (tmp_path / "r1.hea").write_text("r1 1 100 4\na.dat 311 200(0)/mV 16 0 0 0 0 I\n")
    with pytest.raises(Exception, match="311"):
        signals.read_signals(spark, str(tmp_path)).count()


def test_tables_of_anything(spark):
    import pandas as pd

    frame = pd.DataFrame({"a": [1, 2], "b": [3.0, 4.0]})
    for source in (frame, lambda: frame, lambda s: s.createDataFrame(frame), np.array([[1, 3.0], [2, 4.0]]), [(1, 3.0), (2, 4.0)]):
        got = table_of(spark, source, "/nowhere", ["a", "b"] if isinstance(source, (list, np.ndarray)) else None)
        assert sorted(tuple(r) for r in got.collect()) == [(1, 3.0), (2, 4.0)]
    assert table_of(spark, np.zeros(3)).columns == ["att_0"]
    with pytest.raises(ValueError):
        table_of(spark)


def means():
    """A factory of a plain extractor."""
    return lambda x: np.stack([x.mean((1, 2, 3)), x.std((1, 2, 3))], axis=1)


def test_extractors(spark):
    rng = np.random.default_rng(9)
    rows = [(f"i{k}", 6 + k % 2, 5, bytearray(rng.integers(0, 256, (6 + k % 2, 5, 3)).astype(np.uint8).tobytes())) for k in range(9)] + [("gone", 1, 1, None)]
    df = spark.createDataFrame(rows, "image string, height int, width int, data binary")
    got = {r.image: r.v for r in extract.extracted(df, means, (6, 5), batch=2).collect()}
    x = np.frombuffer(bytes(rows[0][3]), np.uint8).astype(float) / 127.5 - 1
    assert len(got) == 9 and got["i0"] == pytest.approx([x.mean(), x.std()], abs=1e-6)
    assert extract.extracted(df, extract.named("tests.test_scale:means"), (4, 4)).count() == 9
    with pytest.raises(ValueError):
        extract.named("no name")


# --- pictures, precision and recall, mixtures ---------------------------------


def test_ssim_against_loops():
    rng = np.random.default_rng(10)
    x = rng.integers(0, 256, (19, 15, 3)).astype(np.uint8)
    y = np.clip(x + rng.normal(0, 30, x.shape), 0, 255).astype(np.uint8)
    k = np.array([math.exp(-((i - 5) ** 2) / 4.5) for i in range(11)])
    k = np.outer(k, k) / k.sum() ** 2
    total, contrast = [], []
    for c in range(3):
        for i in range(19 - 10):
            for j in range(15 - 10):
                a, b = (z[i : i + 11, j : j + 11, c] / 255.0 for z in (x, y))
                m, n = (a * k).sum(), (b * k).sum()
                va, vb, vab = ((a - m) ** 2 * k).sum(), ((b - n) ** 2 * k).sum(), ((a - m) * (b - n) * k).sum()
                contrast.append((2 * vab + 0.0009) / (va + vb + 0.0009))
                total.append((2 * m * n + 0.0001) / (m * m + n * n + 0.0001) * contrast[-1])
    assert images.ssim(x, y) == pytest.approx(np.mean(total), abs=1e-9)
    # one scale is the similarity; two are the contrast of the first and it at half the size
    one = images.ms_ssim(x[:18, :14], y[:18, :14], size=5, weights=(1.0,))
    assert one == pytest.approx(images.ssim(x[:18, :14], y[:18, :14], size=5), abs=1e-9)


def dom_brute(rgb: np.ndarray) -> float:
    level = images.luma(rgb).astype(int)
    h, w = level.shape
    edge = lambda a, i, j: float(a[min(max(i, 0), h - 1), min(max(j, 0), w - 1)])
    at = lambda a, i, j: float(a[i, j]) if 0 <= i < h and 0 <= j < w else 0.0
    m = np.array([[np.median([edge(level, i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]) for j in range(w)] for i in range(h)])
    total = 0.0
    for dy, dx in ((1, 0), (0, 1)):
        slope = np.array([[0.5 * (at(level, i + dy, j + dx) - at(level, i - dy, j - dx)) for j in range(w)] for i in range(h)])
        on = np.abs(slope) / (slope.max() + 1e-8) > 1e-4
        n, sharp = (h if dy else w), 0
        for i in range(h):
            for j in range(w):
                k = i if dy else j
                if not on[i, j] or not 2 <= k < max(n - 2, 2):
                    continue
                num = den = 0.0
                for s in range(-2, 2):
                    p, q = i + s * dy, j + s * dx
                    num += abs(at(m, p + 2 * dy, q + 2 * dx) - 2 * m[p, q] + at(m, p - 2 * dy, q - 2 * dx))
                    den += abs(m[p, q] - at(m, p - dy, q - dx)) * on[p, q]
                sharp += den > 0 and num >= 2 * den
        total += (sharp / (on.sum() + 1e-8)) ** 2
    return math.sqrt(total)


def test_dom_against_loops():
    rng = np.random.default_rng(11)
    for k in range(3):
        x = np.repeat(np.clip(np.cumsum(rng.normal(0, 40, (14, 11, 1)), k % 2) + 120, 0, 255), 3, axis=2).astype(np.uint8)
        assert images.dom(x) == pytest.approx(dom_brute(x), abs=1e-9)


def test_prd_of_separate_clusters(spark):
    """Far clusters, so that k-means can't but find them: the curve follows from the shares."""
    rng = np.random.default_rng(12)
    at = lambda share: np.concatenate([rng.normal(0, 0.1, (int(100 * share), 2)), rng.normal(50, 0.1, (100 - int(100 * share), 2))])
    x, y = at(0.8), at(0.3)
    got = {r.key or r.stat: r.value for r in features.prd(vectors(spark, x), vectors(spark, y)).collect()}
    slopes = np.tan(np.linspace(1e-10, np.pi / 2 - 1e-10, 1001))
    precision = np.minimum(np.array([0.8, 0.2])[None] * slopes[:, None], np.array([0.3, 0.7])[None]).sum(1).clip(0, 1)
    recall = (precision / slopes).clip(0, 1)
    beta = 8.0
    with np.errstate(invalid="ignore"):
        f = (1 + beta**2) * precision * recall / (beta**2 * precision + recall + 1e-10)
    assert any(v == pytest.approx(f.max(), abs=2e-3) for v in got.values() if isinstance(v, float)), (got, f.max())


def test_giqa_against_its_mixture(spark):
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(13)
    r, t = vectors(spark, np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(9, 1, (60, 2))])), vectors(spark, rng.normal(4, 4, (30, 2)))
    got = features.giqa(r, t, components=2)
    model = GaussianMixture(k=2, seed=0, maxIter=100).fit(r.withColumn("features", array_to_vector("v")))
    points = {v.id: np.array(v.v) for v in t.collect()}
    ll = {}
    for i, x in points.items():
        p = 0.0
        for w, g in zip(model.weights, model.gaussiansDF.collect()):
            cov, d = g["cov"].toArray() + 1e-6 * np.eye(2), x - g["mean"].toArray()
            p += w * math.exp(-0.5 * d @ np.linalg.solve(cov, d)) / (2 * math.pi * math.sqrt(np.linalg.det(cov)))
        ll[i] = math.log(p)
    low, high = min(ll.values()), max(ll.values())
    each = {r.key: r.value for r in got.collect() if r.stat == "instance"}
    assert all(each[str(i)] == pytest.approx((v - low) / (high - low), abs=1e-6) for i, v in ll.items())
    assert value(got) == pytest.approx(np.mean(list(each.values())), abs=1e-6)


# --- the command line -------------------------------------------------------------


def test_audit_chooses_by_attributes(spark, tmp_path):
    from veracast import cli
    from veracast.plans import registry

    rng = np.random.default_rng(14)
    for name in "tu":
        (tmp_path / f"{name}.csv").write_text("a,b,k\n" + "".join(f"{rng.normal():.4f},{i % 7},{'xyz'[i % 3]}\n" for i in range(80)))
    t, u = str(tmp_path / "t.csv"), str(tmp_path / "u.csv")
    out = cli.audit(spark, "tabular", "input_val", t, groups=["privacy"])
    assert set(out["dataset_level"]["raw_data_metrics"]) == {"KAnonymityScore"}
    out = cli.audit(spark, "tabular", "input_val", t)
    found = out["dataset_level"]["raw_data_metrics"]
    assert "UniformityScore" in found and set(found["MissingScore"]["value"]) == {"a", "b", "k"} and "instance_level" not in out
    out = cli.audit(spark, "tabular", "synthesis_val", u, t, ["ImprovedPrecision", "Authenticity"])
    assert len(out["instance_level"]["raw_data_metrics"]["ImprovedPrecision"]["value"]) == 80
    out = cli.audit(spark, "tabular", "synthesis_val", u, t, categories=["data"], levels=["dataset"])
    assert set(out["dataset_level"]["raw_data_metrics"]) == {"StatisticalSimScore", "StatisticalDivergenceScore", "CoherenceScore"} and "instance_level" not in out
    with pytest.raises(registry.NotFound):
        cli.audit(spark, "tabular", "input_val", t, reference_type="instance")
    spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)], "id long, v array<double>").write.parquet(str(tmp_path / "e.parquet"))
    e = str(tmp_path / "e.parquet")
    out = cli.audit(spark, "tabular", "synthesis_val", e, e, ["ImprovedRecall", "Density"])
    assert out["dataset_level"]["raw_data_metrics"]["ImprovedRecall"]["value"] == 1.0


def test_reference_pictures_are_counted_or_repeated(spark):
    from veracast import cli
    from veracast.plans import registry

    make = lambda n, c: spark.createDataFrame([(f"{c}{i}", 1, 1, bytearray([i, 0, 0])) for i in range(n)], "image string, height int, width int, data binary")
    with pytest.raises(registry.BadInput):
        cli.paired(make(2, "r"), make(5, "t"), False)
    got = cli.paired(make(2, "r"), make(5, "t"), True).collect()
    assert sorted(r.image for r in got) == [f"t{i}" for i in range(5)] and {bytes(r.data)[0] for r in got} == {0, 1}
    few = spark.createDataFrame([("s", 0, t, 1.0) for t in range(9)], "signal string, channel int, t long, v double")
    with pytest.raises(registry.BadInput):
        cli.computable("time_series", "synthesis_val", few, few)
