"""Published constants, limits and orderings of the metrics, and round trips."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracast.operators import annotations, features, images, prepare, synthesis, tabular, timeseries

XY = [(0.88202617, 0.2000786), (0.48936899, 1.1204466), (0.933779, -0.48863894), (0.47504421, -0.0756786), (-0.05160943, 0.20529925), (0.07202179, 0.72713675), (0.38051886, 0.06083751), (0.22193162, 0.16683716), (0.74703954, -0.10257913), (0.15653385, -0.42704787)]
SHIFTED = [(round(a + 0.5, 8), round(b + 0.5, 8)) for a, b in XY]


def vectors(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")


def test_shape_of_point_sets(spark):
    turn = np.linspace(0, 2 * np.pi, 48, endpoint=False)
    ring, disc = np.column_stack([np.cos(turn), np.sin(turn)]), np.random.default_rng(6).uniform(-1, 1, size=(48, 2))
    one = features.holes(ring, np.arange(0, 48, 4), 0.9, 5)
    assert one[1] > 0.5 and one[2:].sum() == 0 and one.sum() == pytest.approx(1)
    a, b = vectors(spark, ring), vectors(spark, disc)
    assert value(features.geometry_score(a, a, 4)) == 0.0 and value(features.geometry_score(a, b, 4, landmarks=12)) > 0
    assert value(features.intrinsic_distance(a, a)) == 0.0 and value(features.intrinsic_distance(a, b)) > 0
    assert features.neighbour_edges(a, 2, 7).count() == 48  # each has its two neighbours on the ring


def long(spark, x):
    """(signals, steps, channels) as rows."""
    n, length, channels = x.shape
    return spark.createDataFrame([(i, c, t, float(x[i, t, c])) for i in range(n) for c in range(channels) for t in range(length)], "signal long, channel int, t long, v double")


def value(df, **where):
    return next(r.value for r in df.collect() if all(getattr(r, k) == w for k, w in where.items()) and (where or r.stat is None))


@pytest.fixture(scope="module")
def pair(spark):
    return vectors(spark, XY), vectors(spark, SHIFTED)


@pytest.mark.parametrize("size", [1024, 3])
def test_neighbourhoods(spark, pair, size):
    found = features.neighbourhoods(*pair, size=size).cache()
    for name, want in (("precision", 1.0), ("recall", 0.8), ("density", 0.58), ("coverage", 0.8), ("authenticity", 0.5)):
        assert value(features.neighbour_metric(found, name)) == pytest.approx(want)
        assert features.neighbour_metric(found, name, instances=True).count() == 10
    same = features.neighbourhoods(pair[0], pair[0]).cache()
    for name, want in (("precision", 1.0), ("recall", 1.0), ("coverage", 1.0), ("authenticity", 0.0)):
        assert value(features.neighbour_metric(same, name)) == want
    far = features.neighbourhoods(pair[0], vectors(spark, [(a + 99, b) for a, b in XY])).cache()
    for name, want in (("precision", 0.0), ("recall", 0.0), ("density", 0.0), ("coverage", 0.0), ("authenticity", 1.0)):
        assert value(features.neighbour_metric(far, name)) == want


def test_distances(pair):
    assert value(features.wasserstein(*pair)) == pytest.approx(0.5, abs=1e-6)
    assert value(features.mmd_linear(*pair)) == pytest.approx(0.5, abs=1e-6)
    assert value(features.cosine(*pair)) == pytest.approx(0.8370494332671239, abs=1e-6)
    assert value(features.frechet(*pair)) == pytest.approx(0.5, abs=1e-5)


@pytest.mark.parametrize("kernel, want", [("multi_gaussian", 1.0416591), ("additive_chi2", 0.4689359), ("chi2", 0.2499005), ("linear", 0.3188643), ("poly", 1.462842), ("polynomial", 1.462842), ("rbf", 0.2001977), ("laplacian", 0.173311), ("sigmoid", 0.0188876), ("cosine", 0.0142766)])
def test_kernels(spark, kernel, want):
    a, b = vectors(spark, [tuple(map(abs, p)) for p in XY]), vectors(spark, [tuple(map(abs, p)) for p in SHIFTED])
    assert value(features.mmd(a, b, kernel, size=4)) == pytest.approx(want, abs=2e-6)


def test_transport_of_unequal_sets(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=6)
    one = lambda v: vectors(spark, [(a,) for a in v])
    got = value(features.wasserstein(one(x), one(x[:3])))
    want = ((np.sort(x) - np.repeat(np.sort(x[:3]), 2)) ** 2).mean()
    assert got == pytest.approx(want, abs=1e-6)


def test_signals_published(spark):
    ref, tgt = np.array([XY]), np.array([SHIFTED])
    r, t = long(spark, ref), long(spark, tgt)
    assert value(timeseries.dtw(r, t)) == pytest.approx(3.84066727425, abs=1e-6)
    assert value(timeseries.cross_correlation(r, t)) == pytest.approx(4.040718166, abs=1e-6)
    g = np.random.default_rng(42)
    a, b = g.uniform(size=(10, 2000)), g.uniform(size=(10, 2000))
    r, t = long(spark, a[..., None]), long(spark, b[..., None])
    assert value(timeseries.spectral_coherence(r, t)) == pytest.approx(0.07076905306, abs=1e-6)
    assert value(timeseries.spectral_wasserstein(r, t)) == pytest.approx(0.00363758218, abs=1e-6)


def test_warping_against_the_full_table():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 5), (7, 4), (20, 33)):
        a, b = rng.normal(size=n), rng.normal(size=m)
        d = np.full((n + 1, m + 1), np.inf)
        d[0, 0] = 0
        for i in range(n):
            for j in range(m):
                d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
        assert timeseries.warped(a, b) == pytest.approx(d[n, m])


def test_signal_quality(spark):
    x = np.stack([np.ones((8, 2)), np.arange(16.0).reshape(8, 2)])
    s = long(spark, x)
    got = {r.key: r.value for r in timeseries.uniqueness(s).collect()}
    assert got == {"0": 1.0, "1": 0.0}
    got = {r.key: r.value for r in timeseries.snr(s).collect()}
    assert math.isinf(got["0"]) and got["1"] == pytest.approx((x[1].mean(0) / x[1].std(0)).mean(), abs=1e-6)
    f = {r.signal: r for r in timeseries.features(s).where("channel = 0").collect()}
    assert f[1].slope == 2.0 and f[1].median == 7.0 and f[0].std == 0.0 and f[0].skewness is None


def wide(spark, x, names="abcdefghij"):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names[: x.shape[1]]))


def test_tables_on_their_own(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 3))
    assert {r.value for r in tabular.correlation(wide(spark, np.ones((50, 3))), list("abc")).collect() if r.stat != "std"} == {100.0}
    assert value(tabular.correlation(wide(spark, np.column_stack([x[:, 0], 2 * x[:, 0], x[:, 1]])), list("abc"), 0.9), key="a") == 50.0
    for share in (100, 50, 0):
        copies = np.vstack([np.tile(x[0], (share, 1)), rng.normal(size=(100 - share, 3))])
        assert value(tabular.uniqueness(wide(spark, copies), list("abc"))) == share
    gaps = x.copy()
    gaps[:, 1] = np.nan
    assert [round(r.value, 2) for r in tabular.missing(wide(spark, gaps), list("abc")).collect()] == [0.0, 100.0, 0.0, 33.33, 33.33]
    assert value(tabular.uniqueness(wide(spark, gaps), list("abc"))) == 0.0
    assert value(tabular.dim_curse(wide(spark, x[:10]), list("abc"))) == pytest.approx(10 / 3)
    k = spark.createDataFrame([(1, 2), (1, 3), (1, 2), (1, 2)], "p int, q int")
    assert value(tabular.k_anonymity(k, ["p", "q"])) == 75 and value(tabular.k_anonymity(k, ["p"])) == 0 and value(tabular.k_anonymity(k, [])) == -1
    line = np.column_stack([x[:, 0], 2 * x[:, 0], 3 * x[:, 0]])
    assert value(tabular.vif(wide(spark, line), list("abc")), key=None) == 1.0 and value(tabular.vif(wide(spark, x), list("abc")), key=None) == 0.0
    far = np.vstack([rng.normal(size=(95, 1)), np.full((5, 1), 30.0)])
    z = np.abs((far - far.mean()) / far.std()) > 3
    q1, q3 = np.percentile(far, [25, 75])
    out = (far < q1 - 1.5 * (q3 - q1)) | (far > q3 + 1.5 * (q3 - q1))
    assert value(tabular.outliers(wide(spark, far), ["a"]), key="a") == pytest.approx(50 * z.mean() + 50 * out.mean())
    assert value(tabular.outliers(wide(spark, np.ones((9, 1))), ["a"]), key="a") == 0.0
    level = lambda v, of: next(r.value for r in of(wide(spark, v), "a").collect() if r.stat is None)
    assert level(rng.uniform(size=(2000, 1)), tabular.uniformity_continuous) == 0.0
    assert level(rng.exponential(size=(2000, 1)) ** 3, tabular.uniformity_continuous) == 100.0
    assert level(np.repeat([[1.0], [2.0]], 500, axis=0), tabular.uniformity_discrete) == 0.0


def test_synthetic_tables(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(300, 3)), rng.normal(size=(300, 3))
    real, syn, cols = wide(spark, a), wide(spark, b), list("abc")
    assert value(synthesis.ks_similarity(real, real, "a")) == 1.0
    assert value(synthesis.statistical_similarity(real, syn, [], cols), stat="mean") > 0.85
    same = {r.key: r.value for r in synthesis.divergence(real, real, cols).collect() if r.key}
    assert max(same.values()) < 1e-6 and value(synthesis.divergence(real, wide(spark, b + 3), cols, "js"), key="a") > 0.5
    for kind in ("pearson", "spearman"):
        assert value(synthesis.coherence(real, real, cols, kind)) == 1.0
    few = wide(spark, a[:60])
    assert value(synthesis.coherence(few, few, cols, "kendall")) == 1.0
    assert value(synthesis.coherence(wide(spark, np.ones((50, 3))), real, cols)) == pytest.approx(0.5, abs=0.1)
    ids = lambda df: df.withColumn("id", F.monotonically_increasing_id())
    got = {r.stat: r.value for r in synthesis.privacy(ids(real), ids(wide(spark, b + 9)), "id", cols).collect()}
    assert got[None] == 100.0 and got["ctd_disp"] > 80
    got = {r.stat: r.value for r in synthesis.privacy(ids(real), ids(real), "id", cols).collect()}
    assert got["leak"] == 100.0  # copies are at distance nought


def picture(spark, arrays):
    return spark.createDataFrame([(i, a.shape[0], a.shape[1], bytearray(a.tobytes())) for i, a in enumerate(arrays)], "image int, height int, width int, data binary")


def test_pictures(spark):
    rng = np.random.default_rng(4)
    noise, flat = rng.integers(0, 256, (24, 30, 3)).astype(np.uint8), np.full((24, 30, 3), 77, np.uint8)
    df = picture(spark, [noise, flat])
    pixels = images.pixels_of(df)
    assert pixels.count() == 2 * 24 * 30
    again = {r.image: bytes(r.data) for r in images.pictures(pixels).collect()}
    assert again[0] == noise.tobytes() and again[1] == flat.tobytes()
    x = noise.astype(float)
    bright = np.sqrt(0.299 * x[..., 0] ** 2 + 0.587 * x[..., 1] ** 2 + 0.114 * x[..., 2] ** 2).mean()
    assert value(images.brightness(pixels), key="0") == pytest.approx(bright, abs=1e-5)
    assert value(images.colourfulness(pixels), key="1") == 0.0 and value(images.exposure(pixels), key="1") == pytest.approx(77 / 255, abs=1e-5)
    assert value(images.eme(pixels, (8, 10)), key="1") == 0.0 and value(images.eme(pixels), key="0") == 0.0 and value(images.eme(pixels, (8, 10)), key="0") > 10
    got = {(r.key, r.stat): r.value for r in images.of_pictures(df, {"t": images.tenengrad, "r": images.tenengrad_relative, "d": images.dom}).collect()}
    assert got["1", "t"] == 0.0 and got["0", "r"] < 0.6 and got["1", "d"] == 0.0 and 0 <= got["0", "d"] <= 2**0.5
    p = {r.key: r.value for r in images.psnr(pixels, pixels.withColumn("r", F.least(F.col("r") + 10, F.lit(255)))).collect()}
    shifted = x.copy()
    shifted[..., 0] = np.minimum(x[..., 0] + 10, 255)
    assert p["0"] == pytest.approx(20 * np.log10(255 / np.sqrt(((x - shifted) ** 2).mean())), abs=1e-4)
    pairs = {r.stat: r.value for r in images.of_pairs(df, df, {"s": images.ssim, "m": lambda a, b: images.ms_ssim(a, b, 5, weights=(0.5, 0.5))}).collect()}
    assert pairs == {"s": 1.0, "m": 1.0}
    assert images.ssim(noise, flat) < 0.1 and images.resized(noise, 12, 15).shape == (12, 15, 3) and (images.resized(flat, 7, 50) == 77).all()
    with pytest.raises(ValueError):
        images.ms_ssim(noise, noise)


def test_annotations(spark, tmp_path):
    from veracast.sources.images import read_annotations

    mask = {"counts": [1], "size": [2, 2]}
    data = {
        "images": [{"id": 1}, {"id": 2}, {"id": 3}], "categories": [{"id": 1, "name": "cat"}, {"id": 2, "name": "dog"}],
        "annotations": [
            {"id": 10, "image_id": 1, "category_id": 1, "bbox": [0, 0, 1, 1]}, {"id": 11, "image_id": 1, "category_id": 1, "bbox": [0, 0, 1]}, {"id": 12, "image_id": 2, "category_id": 0, "segmentation": mask, "area": 5.0, "bbox": [0, 0, 1, 1]},
            {"id": 13, "image_id": 2, "category_id": 2}, {"id": 14, "image_id": 2, "segmentation": {"size": [2, 2]}, "keypoints": [1, 2, 3]}, {"id": 15, "image_id": 9, "category_id": 7, "keypoints": [1, 2]},
        ],
    }
    (tmp_path / "coco.json").write_text(json.dumps(data, indent=1))
    pictures, notes, kinds = read_annotations(spark, str(tmp_path / "coco.json"))

    def lists(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.key, set()).add(int(r.value))
        return out

    assert lists(annotations.completeness(pictures, notes, kinds)) == {"img_no_annot": {3, 12, 14}, "annot_missing_fields": {13}}
    got = lists(annotations.correctness(notes, kinds, ["cat"], 3, (6, None)))
    assert got == {"invalid_labels": {2}, "annots_invalid_label": {13}, "annots_invalid_bbox": {11}, "annots_invalid_kp": {15}, "annots_mask_oob": {12}, "annots_missing_area": {14}, "annots_missing_counts": {14}, "annots_missing_bbox": {14}}
    assert lists(annotations.uniqueness(notes)) == {"1": {11}}
    assert {r.type for r in annotations.annotation_types(notes).collect()} == {"bbox", "mask", "keypoints", "label"}


def test_preparation_round_trips(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.uniform(18, 90)), "fm"[i % 2], f"c{rng.integers(6)}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, age double, sex string, land string")
    p = {r.column: r for r in prepare.profile(df).collect()}
    assert (p["age"].tag, p["age"].dtype, p["sex"].tag, p["sex"].is_categ, p["land"].dtype, p["id"].dtype) == ("continuous", "numerical", "discrete", 1, "string", "integer")
    encoder = prepare.Encoder.fit(df, ["sex", "land"])
    encoder.save(str(tmp_path / "meta.json"))
    assert prepare.Encoder.load(str(tmp_path / "meta.json")) == encoder and encoder.options["sex"] == ["f", "m"]
    assert sorted(map(tuple, encoder.decode(encoder.encode(df)).collect())) == sorted(rows)
    unknown = spark.createDataFrame([("x", "c1")], "sex string, land string")
    assert encoder.encode(unknown).first().sex is None
    hot = encoder.one_hot(encoder.encode(df.select("sex", "land")))
    assert hot.columns == ["sex_OR", *(f"land_OH-{k}" for k in range(1, 7))]
    assert sorted(map(tuple, encoder.decode(encoder.from_one_hot(hot, ["sex", "land"])).collect())) == sorted((s, c) for _, _, s, c in rows)
    for kind in prepare.SCALERS:
        scaler = prepare.Scaler.fit(df, ["age"], kind)
        back = scaler.inverse(scaler.transform(df))
        assert back.select(F.max(F.abs(F.col("age")))).first()[0] == pytest.approx(max(r[1] for r in rows))
    with pytest.raises(ValueError):
        prepare.Scaler.fit(df, ["age"], "none")
    for one_hot in (False, True):
        made = prepare.Prepared.fit(df, ["age", "sex", "land"], one_hot=one_hot)
        assert sorted((round(r.age, 6), r.sex, r.land) for r in made.inverse(made.transform(df)).collect()) == sorted((round(a, 6), s, c) for _, a, s, c in rows)
    x = rng.normal(size=(40, 3))
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    pca = prepare.Components.fit(points, ["a", "b", "c"], 3)
    back = pca.inverse(pca.transform(points)).orderBy("id").collect()
    assert np.allclose([[r.a, r.b, r.c] for r in back], x) and np.allclose(pca.variance, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    for kind in ("isomap", "lle"):
        assert prepare.embedded(points, "id", ["a", "b", "c"], kind).count() == 40
    assert prepare.resolve(["age", "land"], ["an"]) == ["land"] and prepare.resolve(["age"], ["z"]) == ["age"] and prepare.resolve(["age"], None) == ["age"]


def test_imputation(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (2, None, 1), (3, 3.0, None), (4, float("nan"), 5), (5, 1.0, 1)], "id long, a double, b int")
    get = lambda kind: [(r.a, r.b) for r in prepare.impute(df, ["a", "b"], kind).orderBy("id").collect()]
    assert get("mode")[1:4] == [(1.0, 1), (3.0, 1), (1.0, 5)] and get("mean")[1][0] == pytest.approx(5 / 3) and get("mean")[2][1] == 2 and get("median")[1][0] == 1.0
    near = {r.id: r for r in prepare.impute_knn(df, "id", ["a", "b"]).collect()}
    assert near[2].a == 1.0 and near[3].b == 1.0 and near[1].a == 1.0
    got = prepare.without_sentinels(spark.createDataFrame([(999, -1.0, "nan"), (1, 2.0, "x")], "a int, b double, c string")).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (1, 2.0, "x")]
