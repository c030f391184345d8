"""Metrics of pictures.

Metrics of single pixels or blocks are aggregates of a long pixel table
(image, y, x, r, g, b). Metrics with a stencil work on whole pictures, rows of
(image, height, width, data) with three bytes a pixel, in Arrow batches: a
picture never leaves its row, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracast.functions.longform import RESULT


def grey(r: Column, g: Column, b: Column) -> Column:
    """Luma in whole levels (weights in 14 bits)."""
    return F.floor((r * 4899 + g * 9617 + b * 1868 + 8192) / 16384)


def _luma() -> Column:
    return grey(F.col("r").cast("long"), F.col("g").cast("long"), F.col("b").cast("long"))


def _named(df: DataFrame, metric: str) -> DataFrame:
    return df.select(F.col("image").cast("string").alias("key"), F.lit(metric).alias("stat"), F.round("value", 6).alias("value"))


def brightness(pixels: DataFrame) -> DataFrame:
    """Mean perceived brightness."""
    level = F.sqrt(0.299 * F.col("r") * F.col("r") + 0.587 * F.col("g") * F.col("g") + 0.114 * F.col("b") * F.col("b"))
    return _named(pixels.groupBy("image").agg(F.avg(level).alias("value")), "brightness")


def exposure(pixels: DataFrame) -> DataFrame:
    """(mean + 2 deviations) / 255 of the luma."""
    return _named(pixels.groupBy("image").agg(((F.avg(_luma()) + 2 * F.stddev_pop(_luma())) / 255).alias("value")), "exposure")


def colourfulness(pixels: DataFrame) -> DataFrame:
    """From the moments of the opponent colours |r - g| and |(r + g) / 2 - b|."""
    rg, yb = F.abs(F.col("r").cast("double") - F.col("g")), F.abs(0.5 * (F.col("r").cast("double") + F.col("g")) - F.col("b"))
    one = pixels.groupBy("image").agg(F.avg(rg).alias("m"), F.avg(yb).alias("n"), F.var_pop(rg).alias("s"), F.var_pop(yb).alias("t"))
    return _named(one.withColumn("value", F.sqrt(F.col("s") + F.col("t")) + 0.3 * F.sqrt(F.col("m") * F.col("m") + F.col("n") * F.col("n"))), "colorfulness")


def eme(pixels: DataFrame, block: tuple[int, int] = (100, 100)) -> DataFrame:
    """Mean contrast 20 ln(max / min) of whole blocks, those of the first
    column of blocks left out; 0 without a block."""
    down, across = block
    p = pixels.select("image", "y", "x", _luma().cast("double").alias("v"))
    by = F.floor(F.col("y") / down), F.floor(F.col("x") / across)
    parts = p.groupBy("image", by[0].alias("i"), by[1].alias("j")).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("n"))
    floor = lambda c: F.greatest(F.col(c), F.lit(0.1))
    whole = (F.col("n") == down * across) & (F.col("j") >= 1)
    value = F.avg(F.when(whole, 20 * F.ln(floor("b") / floor("a"))))
    return _named(parts.groupBy("image").agg(F.coalesce(value, F.lit(0.0)).alias("value")), "eme")


YIQ = ((0.299, 0.587, 0.114), (0.59590059, -0.27455667, -0.32134392), (0.21153661, -0.52273617, 0.31119955))


def psnr(reference: DataFrame, target: DataFrame, data_range: float = 255.0, luminance: bool = False, allow_infinite: bool = False) -> DataFrame:
    """Peak signal-to-noise ratio of pictures of the same id, pixel by pixel."""
    pick = lambda df, s: df.select("image", "y", "x", *(F.col(c).cast("double").alias(f"{c}{s}") for c in "rgb"))
    both = pick(reference, 0).join(pick(target, 1), ["image", "y", "x"])
    if luminance:
        weight = [sum(row[i] for row in YIQ) for i in range(3)]
        error = sum(((F.col(f"{c}0") - F.col(f"{c}1")) * w for c, w in zip("rgb", weight)), F.lit(0.0))
        square = error * error
    else:
        square = sum(((F.col(f"{c}0") - F.col(f"{c}1")) * (F.col(f"{c}0") - F.col(f"{c}1")) for c in "rgb"), F.lit(0.0)) / 3
    noise = F.sqrt(F.avg(square)) + (0.0 if allow_infinite else 1e-8)
    ratio = F.coalesce(20 * F.log10(F.try_divide(F.lit(data_range), noise)), F.lit(float("inf")))
    return _named(both.groupBy("image").agg(ratio.alias("value")), "psnr")


def pictures(pixels: DataFrame) -> DataFrame:
    """(image, height, width, data) of a long pixel table: one shuffle."""
    byte = lambda c: F.lpad(F.hex(F.col(f"e.{c}").cast("int")), 2, "0")
    own = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b")))
    one = pixels.groupBy("image").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"), own.alias("p"))
    two = lambda v: F.lpad(F.hex(v.cast("int")), 2, "0")
    data = F.unhex(F.array_join(F.transform("p", lambda e: F.concat(two(e["r"]), two(e["g"]), two(e["b"]))), ""))
    return one.select("image", "height", "width", data.alias("data"))


def pixels_of(images: DataFrame) -> DataFrame:
    """The long pixel table of (image, height, width, data), made in place."""
    n = F.col("height") * F.col("width")
    each = images.select("image", "width", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).where("width > 0")
    at = lambda k: F.conv(F.hex(F.substring(F.col("data"), F.col("i") * 3 + k + 1, F.lit(1))), 16, 10).cast("int")
    return each.select("image", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), at(0).alias("r"), at(1).alias("g"), at(2).alias("b"))


# --- whole pictures ---------------------------------------------------------


def luma(rgb: np.ndarray) -> np.ndarray:
    x = rgb.astype(np.int64)
    return (x[..., 0] * 4899 + x[..., 1] * 9617 + x[..., 2] * 1868 + 8192) >> 14


def gradient(level: np.ndarray, threshold: float = 0.0) -> float:
    """Mean Sobel magnitude; the border is mirrored without its edge."""
    mode = lambda n: "reflect" if n > 1 else "edge"
    p = np.pad(level.astype(float), ((1, 1), (0, 0)), mode=mode(level.shape[0]))
    p = np.pad(p, ((0, 0), (1, 1)), mode=mode(level.shape[1]))
    down = p[:-2] + 2 * p[1:-1] + p[2:]
    across = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    m = np.hypot(down[:, 2:] - down[:, :-2], across[2:] - across[:-2])
    return float(np.where(m < threshold, 0, m).mean())


def softened(rgb: np.ndarray, factor: float = 0.0) -> np.ndarray:
    """The picture blended with its smoothing (5 in the middle of ones); the border stays."""
    x = rgb.astype(np.int64)
    out = x.copy()
    if min(x.shape[:2]) > 2:
        around = sum(x[1 + i : x.shape[0] - 1 + i, 1 + j : x.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)) + 4 * x[1:-1, 1:-1]
        out[1:-1, 1:-1] = np.clip((around * 2 + 13) // 26, 0, 255)
    return (out + factor * (x - out)).astype(np.uint8)


def tenengrad(rgb: np.ndarray, threshold: float = 0.0) -> float:
    return gradient(luma(rgb), threshold)


def tenengrad_relative(rgb: np.ndarray, threshold: float = 0.0, criteria: str = "ratio", factor: float = 0.0) -> float:
    """Sharpness that softening leaves, as a ratio or a difference."""
    own, soft = tenengrad(rgb, threshold), tenengrad(softened(rgb, factor), threshold)
    if criteria == "diff":
        return soft - own
    return soft / own if own else float("nan")


def _shifted(a: np.ndarray, by: int, axis: int) -> np.ndarray:
    """a moved along the axis, zeros moving in."""
    out = np.zeros_like(a)
    n = a.shape[axis]
    src, dst = [slice(None)] * 2, [slice(None)] * 2
    src[axis], dst[axis] = (slice(0, n - by), slice(by, n)) if by > 0 else (slice(-by, n), slice(0, n + by))
    out[tuple(dst)] = a[tuple(src)]
    return out


def dom(rgb: np.ndarray, width: int = 2, sharpness: float = 2.0, edge: float = 1e-4) -> float:
    """Share of edge pixels that are sharp by the difference of differences of
    the median-filtered luma, both directions put together (0 to sqrt 2)."""
    level = luma(rgb)
    p = np.pad(level, 1, mode="edge")
    around = np.stack([p[i : i + level.shape[0], j : j + level.shape[1]] for i in range(3) for j in range(3)])
    m = np.median(around, axis=0)  # in levels, so that sums are exact and a ratio that equals the limit does
    total = 0.0
    for axis in (0, 1):
        x = level.astype(float)
        slope = 0.5 * (_shifted(x, -1, axis) - _shifted(x, 1, axis))
        on = np.abs(slope) / (slope.max() + 1e-8) > edge
        second = np.abs(_shifted(m, -2, axis) - 2 * m + _shifted(m, 2, axis))
        contrast = np.abs(m - _shifted(m, 1, axis)) * on
        sums = []
        for a in (second, contrast):
            run = np.concatenate([np.zeros_like(a.take([0], axis)), np.cumsum(a, axis)], axis)
            n = a.shape[axis]
            i = np.arange(width, max(n - width, width))
            sums.append((run.take(i + width, axis) - run.take(i - width, axis), i))
        (num, i), (den, _) = sums
        ratio = np.where(den > 1e-3 * 255, num / np.maximum(den, 1e-300), 0.0)
        whole = np.zeros_like(m)
        whole[(i, slice(None)) if axis == 0 else (slice(None), i)] = ratio
        share = ((whole * on) >= sharpness).sum() / (on.sum() + 1e-8)
        total += share**2
    return float(np.sqrt(total))


def _window(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def _filtered(a: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Separable filter without padding, over the first two axes."""
    view = np.lib.stride_tricks.sliding_window_view
    return view(view(a, len(k), axis=0) @ k, len(k), axis=1) @ k


def _structure(x: np.ndarray, y: np.ndarray, k: np.ndarray, c1: float, c2: float) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, contrast term) of each colour."""
    a, b = _filtered(x, k), _filtered(y, k)
    xx, yy, xy = _filtered(x * x, k) - a * a, _filtered(y * y, k) - b * b, _filtered(x * y, k) - a * b
    contrast = (2 * xy + c2) / (xx + yy + c2)
    return ((2 * a * b + c1) / (a * a + b * b + c1) * contrast).mean(axis=(0, 1)), contrast.mean(axis=(0, 1))


def ssim(x: np.ndarray, y: np.ndarray, size: int = 11, sigma: float = 1.5, k1: float = 0.01, k2: float = 0.03, data_range: float = 255.0) -> float:
    if min(x.shape[:2]) < size:
        raise ValueError(f"a picture of {x.shape[0]} x {x.shape[1]} is smaller than the window, {size}")
    return float(_structure(x / data_range, y / data_range, _window(size, sigma), k1**2, k2**2)[0].mean())


SCALES = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def ms_ssim(x: np.ndarray, y: np.ndarray, size: int = 11, sigma: float = 1.5, k1: float = 0.01, k2: float = 0.03, weights: tuple[float, ...] = SCALES, data_range: float = 255.0) -> float:
    """Contrast terms of all scales but the last, whose similarity is taken,
    each to the power of its weight. Pictures are halved between scales."""
    if min(x.shape[:2]) < (size - 1) * 2 ** (len(weights) - 1) + 1:
        raise ValueError(f"a picture of {x.shape[0]} x {x.shape[1]} is too small for {len(weights)} scales")
    x, y, out = x / data_range, y / data_range, 1.0
    k = _window(size, sigma)
    for i, w in enumerate(weights):
        if i:
            pad = max(x.shape[0] % 2, x.shape[1] % 2)
            x, y = (np.pad(a, ((pad, 0), (pad, 0), (0, 0)), mode="edge") for a in (x, y))
            h, v = x.shape[0] // 2 * 2, x.shape[1] // 2 * 2
            x, y = (a[:h, :v].reshape(h // 2, 2, v // 2, 2, -1).mean(axis=(1, 3)) for a in (x, y))
        similar, contrast = _structure(x, y, k, k1**2, k2**2)
        out = out * np.maximum(similar if i == len(weights) - 1 else contrast, 0) ** w
    return float(np.mean(out))


def _array(batch: pa.RecordBatch, i: int, s: str = "") -> np.ndarray:
    h, w = batch.column(f"height{s}")[i].as_py(), batch.column(f"width{s}")[i].as_py()
    return np.frombuffer(batch.column(f"data{s}")[i].as_py(), np.uint8).reshape(h, w, -1)[..., :3]


def of_pictures(images: DataFrame, metrics: dict[str, Callable[[np.ndarray], float]]) -> DataFrame:
    """key (image), stat (metric) and value of every picture; null for one without data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, stats, values = [], [], []
            for i in range(batch.num_rows):
                there = batch.column("data")[i].is_valid and len(batch.column("data")[i].as_py())
                x = _array(batch, i) if there else None
                for name, of in metrics.items():
                    keys.append(batch.column("key")[i].as_py())
                    stats.append(name)
                    values.append(None if x is None else round(of(x), 6))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(stats, pa.string()), pa.array(values, pa.float64())], ["key", "stat", "value"])

    return images.select(F.col("image").cast("string").alias("key"), "height", "width", "data").mapInArrow(run, RESULT)


def of_pairs(reference: DataFrame, target: DataFrame, metrics: dict[str, Callable[[np.ndarray, np.ndarray], float]]) -> DataFrame:
    """The same for pictures of one id, the reference first. The larger of two
    is sampled down to the size of the smaller."""
    both = reference.select("image", "height", "width", "data").join(target.select(F.col("image").alias("_i"), *(F.col(c).alias(f"{c}1") for c in ("height", "width", "data"))), F.col("image") == F.col("_i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, stats, values = [], [], []
            for i in range(batch.num_rows):
                x, y = smallest(_array(batch, i), _array(batch, i, "1"))
                for name, of in metrics.items():
                    keys.append(batch.column("key")[i].as_py())
                    stats.append(name)
                    values.append(round(of(x, y), 6))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(stats, pa.string()), pa.array(values, pa.float64())], ["key", "stat", "value"])

    chosen = both.where("data is not null and data1 is not null").select(F.col("image").cast("string").alias("key"), "height", "width", "data", "height1", "width1", "data1")
    return chosen.mapInArrow(run, RESULT)


def resized(x: np.ndarray, height: int, width: int, lobes: int = 4) -> np.ndarray:
    """Lanczos resampling, one axis after the other; edges are repeated."""
    out = x.astype(float)
    for axis, n in ((0, height), (1, width)):
        m = out.shape[axis]
        if m == n:
            continue
        at = (np.arange(n) + 0.5) * m / n - 0.5
        first = np.floor(at).astype(int) - lobes + 1
        taps = first[:, None] + np.arange(2 * lobes)
        d = at[:, None] - taps
        k = np.sinc(d) * np.sinc(d / lobes)
        k /= k.sum(axis=1, keepdims=True)
        taken = np.moveaxis(out, axis, 0)[np.clip(taps, 0, m - 1)]
        out = np.moveaxis((taken * k[(...,) + (None,) * (taken.ndim - 2)]).sum(axis=1), 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def smallest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two pictures at the size of the smaller."""
    if x.shape[:2] == y.shape[:2]:
        return x, y
    if x.shape[0] * x.shape[1] > y.shape[0] * y.shape[1]:
        return resized(x, *y.shape[:2]), y
    return x, resized(y, *x.shape[:2])
