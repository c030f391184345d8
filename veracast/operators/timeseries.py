"""Metrics of signals. A frame of signals is long: signal, channel, t, v.

What is a step or a moment stays an aggregate or a window. What needs a whole
signal (alignment, spectra) gathers each signal's values once, as an array, and
works on Arrow batches of arrays. A missing value is no value: its step is left
out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracast.functions.blocks import distances, over_pairs
from veracast.functions.longform import RESULT, rows
from veracast.operators.features import positions


def _instances(df: DataFrame, name: str = "value") -> DataFrame:
    return df.select(F.col("signal").cast("string").alias("key"), F.lit("instance").alias("stat"), F.round(name, 6).alias("value"))


def uniqueness(signals: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """By signal, the share of steps that change the value by the tolerance at most."""
    step = F.lead("v").over(Window.partitionBy("signal", "channel").orderBy("t")) - F.col("v")
    flat = F.when(F.abs("step") <= tolerance, 1.0).otherwise(0.0)
    return _instances(signals.withColumn("step", step).where("step is not null").groupBy("signal").agg(F.avg(flat).alias("value")))


def snr(signals: DataFrame) -> DataFrame:
    """By signal, the mean over channels of mean / (population) deviation; a
    constant channel's is infinite, and undefined (NaN) if it is nought."""
    each = signals.groupBy("signal", "channel").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    inf = F.when(F.col("m") > 0, float("inf")).when(F.col("m") < 0, float("-inf")).otherwise(float("nan"))
    ratio = F.when(F.col("s") > 0, F.try_divide("m", "s")).otherwise(inf)
    return _instances(each.groupBy("signal").agg(F.avg(ratio).alias("value")))


def arrays(signals: DataFrame) -> DataFrame:
    """signal, channel and v, its values as an array in the order of t."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda e: e["v"].cast("double"))
    return signals.where("v is not null").groupBy("signal", "channel").agg(own.alias("v"))


def _against(reference: DataFrame, target: DataFrame, pairing: str, of: Callable[[np.ndarray, np.ndarray], float]) -> DataFrame:
    """signal, value: of(target channel, reference channel), averaged over channels.

    pairing: "last" compares with the reference signal of the highest id,
    "all" with every reference, and averages."""
    if pairing == "last":
        reference = reference.join(reference.agg(F.max("signal").alias("_last")), F.col("signal") == F.col("_last")).drop("_last")
    ref = arrays(reference).select(F.col("signal").alias("ref"), F.col("channel").alias("c"), F.col("v").alias("w"))
    pairs = arrays(target).join(ref, F.col("channel") == F.col("c")).select("signal", "ref", "v", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w = ([x.values.to_numpy(zero_copy_only=False) for x in batch.column(c)] for c in ("v", "w"))
            if many := getattr(of, "many", None):  # pairs of the same lengths together
                got: list = [None] * len(v)
                alike: dict[tuple[int, int], list[int]] = {}
                for i, (x, y) in enumerate(zip(v, w)):
                    alike.setdefault((len(x), len(y)), []).append(i)
                for at in alike.values():
                    for k in range(0, len(at), 64):
                        own = at[k : k + 64]
                        for i, x in zip(own, many(np.stack([v[i] for i in own]), np.stack([w[i] for i in own]))):
                            got[i] = float(x)
            else:
                got = [of(x, y) for x, y in zip(v, w)]
            yield pa.RecordBatch.from_arrays([batch.column("signal"), batch.column("ref"), pa.array(got, pa.float64())], ["signal", "ref", "x"])

    kind = dict(target.dtypes)["signal"], dict(reference.dtypes)["signal"]
    each = pairs.mapInArrow(run, f"signal {kind[0]}, ref {kind[1]}, x double")
    by_pair = each.groupBy("signal", "ref").agg(F.avg("x").alias("x"))
    return by_pair.groupBy("signal").agg(F.avg("x").alias("value"))


def _both_levels(each: DataFrame, name: str) -> DataFrame:
    return _instances(each).unionByName(rows(each.agg(F.avg("value").alias("v")), [(name, None, F.round("v", 6))]))


def warped(a: np.ndarray, b: np.ndarray) -> float:
    """Cost of the best monotone alignment of two series by absolute difference."""
    return float(_warped_all(a[None], b[None])[0])


def _warped_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """warped() of each row of a with that of b: one anti-diagonal of all cost
    tables at a time, in three buffers that take turns."""
    k, n, m = len(a), a.shape[1], b.shape[1]
    if not n or not m:
        return np.full(k, np.nan)
    two_before, before, now = (np.full((k, n + 2), np.inf) for _ in range(3))  # indexed by row of the table
    two_before[:, 0] = 0.0
    back = b[:, ::-1]
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        out = now[:, lo : hi + 1]
        np.minimum(before[:, lo - 1 : hi], before[:, lo : hi + 1], out=out)
        np.minimum(out, two_before[:, lo - 1 : hi], out=out)
        out += np.abs(a[:, lo - 1 : hi] - back[:, m - d + lo : m - d + hi + 1])
        now[:, lo - 1] = now[:, hi + 1] = np.inf
        two_before, before, now = before, now, two_before
    return before[:, n].copy()


warped.many = _warped_all  # type: ignore[attr-defined]


def dtw(reference: DataFrame, target: DataFrame, pairing: str = "last") -> DataFrame:
    """Dynamic time warping (exact) of each target signal, and the mean."""
    return _both_levels(_against(reference, target, pairing, warped), "dtw")


def cross_correlation(reference: DataFrame, target: DataFrame, mode: str = "full", reduction: str = "max", pairing: str = "last") -> DataFrame:
    """Largest (or mean) cross-correlation of each target signal over all
    lags, and the mean."""
    reduce = {"max": np.max, "mean": np.mean}[reduction]
    return _both_levels(_against(reference, target, pairing, lambda a, b: float(reduce(np.correlate(a, b, mode=mode)))), "cross_correlation")


def _segments(x: np.ndarray, win: int) -> np.ndarray:
    """Spectra (segments, frequencies) of half-overlapping segments less their means."""
    step = win - win // 2
    cut = np.lib.stride_tricks.sliding_window_view(x, win)[::step]
    return np.fft.rfft(cut - cut.mean(axis=1, keepdims=True), axis=1)


def coherent(x: np.ndarray, y: np.ndarray, fs: int, nperseg: int | None, low: float, high: float) -> float:
    """Median magnitude-squared coherence over the frequencies in range."""
    n = min(len(x), len(y))
    win = min(nperseg or min(len(x) // 8, fs // 2), n)
    a, b = _segments(x[:n], win), _segments(y[:n], win)
    f = np.fft.rfftfreq(win, 1 / fs)
    power = (np.abs(a) ** 2).mean(axis=0) * (np.abs(b) ** 2).mean(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.abs((a.conj() * b).mean(axis=0)) ** 2 / power
    return float(np.median(c[(f >= low) & (f <= high)]))


def _flat(signals: DataFrame) -> DataFrame:
    """pos (by order of signal) and v: all channels of a signal interleaved in one array."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("t", "channel", "v"))), lambda e: e["v"].cast("double"))
    return positions(signals.where("v is not null").groupBy(F.col("signal").alias("id")).agg(own.alias("v")))


def spectral_coherence(reference: DataFrame, target: DataFrame, fs: int = 2048, nperseg: int | None = None, low: float = -np.inf, high: float = np.inf) -> DataFrame:
    """Mean over signals, paired by position, of the median coherence."""
    both = _flat(reference).join(_flat(target).withColumnRenamed("v", "w"), "pos").select("v", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w = (batch.column(c) for c in ("v", "w"))
            yield pa.RecordBatch.from_arrays([pa.array([coherent(v[i].values.to_numpy(zero_copy_only=False), w[i].values.to_numpy(zero_copy_only=False), fs, nperseg, low, high) for i in range(batch.num_rows)], pa.float64())], ["c"])

    return rows(both.mapInArrow(run, "c double").agg(F.avg("c").alias("v")), [("spectral_coherence", None, F.round("v", 6))])


def density(x: np.ndarray, fs: int, win: int) -> np.ndarray:
    """One-sided power spectral density along the last axis."""
    flat = x.reshape(-1, x.shape[-1])
    win = min(win, flat.shape[1])
    power = np.stack([(np.abs(_segments(row, win)) ** 2).mean(axis=0) for row in flat]) / (fs * win)
    power[:, 1 : None if win % 2 else -1] *= 2
    return power.reshape(*x.shape[:-1], -1)


def sinkhorn(cost: np.ndarray, reg: float = 0.01, most: int = 1000, stop: float = 1e-9) -> float:
    """Transport cost of the entropy-regularised plan between uniform weights."""
    k = np.exp(-cost / reg)
    u, v = scalings(*cost.shape, lambda u: k.T @ u, lambda v: k @ v, most, stop)
    return float((u[:, None] * k * v[None, :] * cost).sum())


def scalings(n: int, m: int, down, across, most: int = 1000, stop: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows and columns of a kernel k that is known by its products,
    down(u) = k.T @ u and across(v) = k @ v."""
    a, b = np.full(n, 1 / n), np.full(m, 1 / m)
    u, v = np.full(n, 1 / n), np.full(m, 1 / m)
    ahead = down(u)
    for i in range(most):
        last = u, v
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            v = b / ahead
            if not np.isfinite(v).all():
                u, v = last
                break
            u = a / across(v)
        if not np.isfinite(u).all():
            u, v = last
            break
        ahead = down(u)
        if i % 10 == 0 and np.linalg.norm(v * ahead - b) < stop:
            break
    return u, v


def _spectra(df: DataFrame, fs: int, nperseg: int | None) -> DataFrame:
    """id (of signal, t) and v, a spectrum; of signals with several channels one for each t."""
    stack = F.array_sort(F.collect_list(F.struct("t", "channel", "v")))
    own = df.where("v is not null").groupBy("signal").agg(F.transform(stack, lambda e: e["v"].cast("double")).alias("v"), F.count_distinct("channel").alias("c")).select(F.col("signal").cast("string").alias("signal"), "v", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for signal, v, c in zip(*(batch.column(n) for n in ("signal", "v", "c"))):
                x = v.values.to_numpy(zero_copy_only=False)
                x = x if c.as_py() == 1 else x.reshape(-1, c.as_py())
                got = np.atleast_2d(density(x, fs, nperseg or min(len(x), 4 * fs)))
                yield pa.RecordBatch.from_arrays([pa.array([signal.as_py()] * len(got)), pa.array(np.arange(len(got))), pa.array(list(got))], ["signal", "t", "v"])

    return own.mapInArrow(run, "signal string, t long, v array<double>").select(F.struct("signal", "t").alias("id"), "v")


def _transport(spectra: list[DataFrame], reg: float = 0.01) -> float:
    """sinkhorn() in many tasks: the kernel's entries other than nought (those
    of costs over about 745 times reg are nought in double precision) are kept on
    disk by block, and a step is one job over them that returns a vector a task."""
    spark = spectra[0].sparkSession
    kept = [positions(df, cut="id.signal").select(F.col("pos").cast("long").alias("id"), "v").persist(StorageLevel.DISK_ONLY) for df in spectra]
    n, m = (df.count() for df in kept)

    def run(x, y):
        cost = distances(x[1], y[1])
        i, j = np.nonzero(np.exp(cost / -reg))
        if len(i):
            return pa.RecordBatch.from_arrays([pa.array([z.tobytes()]) for z in (x[0][i], y[0][j], cost[i, j])], ["i", "j", "c"])
        return None

    tasks = 2 * spark.sparkContext.defaultParallelism
    blocks = over_pairs(*kept, run, "i binary, j binary, c binary").repartition(tasks).persist(StorageLevel.DISK_ONLY)

    def product(x: np.ndarray, of: str, to: str, size: int, y: np.ndarray | None = None) -> np.ndarray:
        """Sums of k x over one index for each of the other; with y the sum of x k y cost."""
        held = spark.sparkContext.broadcast((x, y))

        def add(batches):
            (x, y), total = held.value, np.zeros(size)
            for batch in batches:
                for p, q, c in zip(*(batch.column(z) for z in (of, to, "c"))):
                    p, q, c = (np.frombuffer(z.as_buffer(), t) for z, t in ((p, np.int64), (q, np.int64), (c, float)))
                    k = np.exp(c / -reg) * x[p]
                    total += (k * y[q] * c).sum() if y is not None else np.bincount(q, k, size)
            if total.any():
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["s"])

        got = blocks.mapInArrow(add, "s binary").collect()
        held.unpersist()
        return sum((np.frombuffer(r.s) for r in got), np.zeros(size))

    try:
        u, v = scalings(n, m, lambda u: product(u, "i", "j", m), lambda v: product(v, "j", "i", n))
        return float(product(u, "i", "j", 1, v)[0])
    finally:
        for df in (*kept, blocks):
            df.unpersist()


def spectral_wasserstein(reference: DataFrame, target: DataFrame, fs: int = 2048, nperseg: int | None = None, most: int = 2000) -> DataFrame:
    """Regularised transport cost between the signals' power spectra.

    Of signals with several channels the spectrum is taken across channels, as
    published results of this metric are. Up to ``most`` spectra a side the plan
    is found in one task; beyond, in many."""
    spectra = [_spectra(df, fs, nperseg) for df in (reference, target)]
    least, large = None, 0
    for df in spectra:
        size, count = df.agg(F.min(F.size("v")), F.count(F.lit(1))).first()
        least, large = min(size, least or size), max(large, count)
    spectra = [df.select("id", F.slice("v", 1, least).alias("v")) for df in spectra]
    if large > most:
        return reference.sparkSession.createDataFrame([("spectral_wasserstein", None, _transport(spectra))], RESULT)
    both = spectra[0].select(F.lit(0).alias("side"), "id", "v").unionByName(spectra[1].select(F.lit(1).alias("side"), "id", "v"))

    def run(key, table):
        import pandas as pd

        pdf = table.assign(s=[e["signal"] for e in table["id"]], t=[e["t"] for e in table["id"]]).sort_values(["s", "t"])
        x, y = (np.stack(pdf[pdf["side"] == s]["v"].to_numpy()) for s in (0, 1))
        return pd.DataFrame({"key": ["spectral_wasserstein"], "stat": [None], "value": [sinkhorn(distances(x, y))]})

    return both.groupBy(F.lit(0).alias("one")).applyInPandas(run, RESULT)


def features(signals: DataFrame) -> DataFrame:
    """signal, channel and a column for each feature: moments, order
    statistics, energy, changes, trend and lag-one autocorrelation."""
    w = Window.partitionBy("signal", "channel").orderBy("t")
    x = signals.where("v is not null").select("signal", "channel", F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v"))
    x = x.withColumn("b", F.lag("v").over(w))
    crossed = F.when(F.col("v") * F.col("b") < 0, 1).otherwise(0)
    quart = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    n = x.groupBy("signal", "channel").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.var_pop("v").alias("var"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"), quart.alias("q"), F.sum(F.col("v") * F.col("v")).alias("abs_energy"),
        F.sum(crossed).alias("zero_crossings"), F.avg(F.col("v") - F.col("b")).alias("mean_diff"), F.avg(F.abs(F.col("v") - F.col("b"))).alias("mean_abs_diff"),
        F.sum(F.abs(F.col("v") - F.col("b"))).alias("sum_abs_diff"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"),
        F.try_divide(F.covar_pop("t", "v"), F.var_pop("t")).alias("slope"), F.avg(F.col("v") * F.col("b")).alias("_vb"), F.avg(F.when(F.col("b").isNotNull(), F.col("v"))).alias("_v"), F.avg("b").alias("_b"),
    )
    out = n.select("signal", "channel", "n", "mean", "std", "var", "min", "max", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "skewness", "kurtosis", "abs_energy", "rms", "zero_crossings", "mean_diff", "mean_abs_diff", "sum_abs_diff", "slope", F.try_divide(F.col("_vb") - F.col("_v") * F.col("_b"), "var").alias("autocorrelation"))
    return out.select(*(F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def spectral_features(signals: DataFrame, fs: int = 1) -> DataFrame:
    """signal, channel and centroid, spread, entropy and peak frequency of its spectrum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for i in range(batch.num_rows):
                x = batch.column("v")[i].values.to_numpy(zero_copy_only=False)
                p = np.abs(np.fft.rfft(x - x.mean())) ** 2
                f = np.fft.rfftfreq(len(x), 1 / fs)
                total = p.sum()
                share = p / total if total > 0 else np.full(len(p), 1 / len(p))
                centroid = float((f * share).sum())
                spread = float(np.sqrt((((f - centroid) ** 2) * share).sum()))
                seen = share[share > 0]
                got.append((centroid, spread, float(-(seen * np.log2(seen)).sum() / max(np.log2(len(p)), 1e-300)) if len(p) > 1 else 0.0, float(f[int(np.argmax(p))])))
            cols = list(zip(*got)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("signal"), batch.column("channel"), *(pa.array(c, pa.float64()) for c in cols)], ["signal", "channel", "centroid", "spread", "entropy", "peak"])

    kind = dict(signals.dtypes)
    return arrays(signals).mapInArrow(run, f"signal {kind['signal']}, channel {kind['channel']}, centroid double, spread double, entropy double, peak double")
