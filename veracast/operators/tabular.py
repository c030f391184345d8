"""Metrics of a table on its own. Columns are numeric unless said otherwise;
a value is missing if it is null or NaN."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracast.functions.longform import RESULT, present, rows, with_stats
from veracast.functions.quantiles import percentiles


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage of missing values by column; means over rows and columns. One pass."""
    flags = [F.when(present(c), 0).otherwise(1) for c in columns]
    row = F.round(100.0 * reduce(lambda a, b: a + b, flags) / len(columns), 3)
    one = df.agg(*(F.round(F.try_divide(100.0 * F.sum(f), F.count(F.lit(1))), 3).alias(f"m{i}") for i, f in enumerate(flags)), F.avg(row).alias("row"))
    mean = reduce(lambda a, b: a + b, (F.col(f"m{i}") for i in range(len(columns)))) / len(columns)
    values = [(c, None, F.col(f"m{i}")) for i, c in enumerate(columns)]
    return rows(one, [*values, (None, "row_mean", F.round("row", 6)), (None, "column_mean", F.round(mean, 6))])


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage of rows that have a copy; a row with a missing value has none."""
    whole = reduce(lambda a, b: a & b, (present(c) for c in columns))
    groups = df.withColumn("_whole", whole).groupBy(*(F.when(F.col("_whole"), F.col(c)).alias(c) for c in columns), "_whole").count()
    value = 100.0 * F.coalesce(F.sum(F.when(F.col("_whole") & (F.col("count") > 1), F.col("count"))), F.lit(0))
    return rows(groups.agg(F.round(F.try_divide(value, F.sum("count")), 6).alias("v")), [(None, None, F.col("v"))])


def dim_curse(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows for each column."""
    return rows(df.agg((F.count(F.lit(1)) / len(columns)).alias("v")), [(None, None, F.col("v"))])


def k_anonymity(df: DataFrame, quasi_identifiers: list[str]) -> DataFrame:
    """100 (1 - k / n), k being the smallest class of equal quasi-identifiers; -1 without any."""
    if not quasi_identifiers:
        return df.sparkSession.createDataFrame([(None, None, -1.0)], RESULT)
    k = df.groupBy(*quasi_identifiers).count().agg(F.min("count").alias("k"), F.sum("count").alias("n"))
    return rows(k.select(F.round(100.0 * (1 - F.try_divide(F.col("k").cast("double"), F.col("n"))), 6).alias("v")), [(None, None, F.col("v"))])


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage of outliers by column, the mean of the three-sigma and of the
    interquartile rule, over rows without a missing value. Two passes; the
    limits between them are one row."""
    whole = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).where(reduce(lambda a, b: a & b, (present(c) for c in columns)))
    moments = whole.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    quartiles = percentiles(whole, columns, [0.25, 0.75]).toDF(*(f"{c}_q" for c in columns))
    limits = F.broadcast(moments.crossJoin(quartiles))
    both = whole.crossJoin(limits)
    out = []
    for c in columns:
        far = F.abs(F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s"))) > 3
        q1, q3 = F.col(f"{c}_q")[0], F.col(f"{c}_q")[1]
        outside = (F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1))
        share = lambda x: F.try_divide(100.0 * F.sum(F.when(x, 1).otherwise(0)), F.count(F.lit(1)))
        out.append(((share(far) + share(outside)) / 2).alias(c))
    return with_stats(rows(both.agg(*out), [(c, None, F.col(c)) for c in columns]).select("key", "value"))


def correlations(df: DataFrame, columns: list[str]) -> Column:
    """Aggregates r_i_j, i < j; null where a column doesn't vary."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    double = [F.col(c).cast("double") for c in columns]
    return [F.try_divide(F.covar_pop(double[i], double[j]), F.stddev_pop(F.when(double[j].isNotNull(), double[i])) * F.stddev_pop(F.when(double[i].isNotNull(), double[j]))).alias(f"r_{i}_{j}") for i, j in pairs]


def correlation(df: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """Percentage of the other columns that each column is strongly correlated
    with (Pearson). A table of one distinct value counts as fully correlated.
    All pairs in one pass."""
    p = len(columns)
    low, high = F.least(*(F.min(F.col(c).cast("double")) for c in columns)) if p > 1 else F.min(columns[0]), F.greatest(*(F.max(F.col(c).cast("double")) for c in columns)) if p > 1 else F.max(columns[0])
    one = df.agg(*correlations(df, columns), (low == high).alias("_same"))
    values = []
    for i, c in enumerate(columns):
        strong = [F.when(F.abs(F.col(f"r_{min(i, j)}_{max(i, j)}")) > threshold, 1).otherwise(0) for j in range(p) if j != i]
        share = F.round(100.0 * reduce(lambda a, b: a + b, strong, F.lit(0)) / max(p - 1, 1), 1)
        values.append((c, None, F.when(F.coalesce("_same", F.lit(False)), 100.0).otherwise(share)))
    return with_stats(rows(one, values).select("key", "value"))


def vif(df: DataFrame, columns: list[str], limit: float = 5.0) -> DataFrame:
    """Variance inflation of each column (on the others, without intercept) and
    the fraction above the limit. The Gram matrix is one pass; only it, p x p,
    reaches the driver."""
    p = len(columns)
    double = [F.col(c).cast("double") for c in columns]
    gram = df.agg(*(F.sum(double[i] * double[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p))).first()
    g = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    scaled = g / scale[:, None] / scale
    if np.linalg.cond(scaled) > 1e12:
        value = np.full(p, np.inf)
    else:
        value = np.diag(np.linalg.inv(scaled))
    out = [(c, "vif", float(round(v, 6)) if np.isfinite(v) else float("inf")) for c, v in zip(columns, value)]
    return df.sparkSession.createDataFrame([*out, (None, None, float((value > limit).mean()))], RESULT)


def _level(statistic: Column, entropy: Column) -> Column:
    flags = F.when(1 - statistic > 0.80, 1).otherwise(0) + F.when(F.round(entropy, 4) > 0.95, 1).otherwise(0)
    return F.round(100.0 * (1 - flags / 2), 1)


def uniformity_discrete(df: DataFrame, column: str, categories: int | None = None) -> DataFrame:
    """level (0, 50 or 100), chi2 and entropy of a column's category
    proportions, padded with zeros up to ``categories``."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count()
    share = counts.select((F.col("count") / F.sum("count").over(Window.partitionBy())).alias("p"))
    one = share.agg(F.count("p").alias("seen"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("p")).alias("sp"), (-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    k = F.greatest(F.col("seen"), F.lit(categories or 0)).cast("double")
    # the sum of (p - 1/K)^2 / (1/K) over all K, (K - 1 of them free)
    chi2 = F.when(k <= 1, 0.0).otherwise(F.try_divide((F.col("pp") - 2 * F.col("sp") / k + 1 / k) * k, k - 1))
    entropy = F.when(k <= 1, 1.0).otherwise(F.try_divide(F.col("h"), F.log2(k)))
    named = one.select(chi2.alias("chi2"), entropy.alias("entropy"))
    return rows(named, [(column, None, _level(F.col("chi2"), F.col("entropy"))), (column, "chi2", F.round("chi2", 6)), (column, "entropy", F.round("entropy", 6))])


def uniformity_continuous(df: DataFrame, column: str) -> DataFrame:
    """level, ks and entropy of a numeric column. ks is the one-sample
    statistic against the uniform distribution between the extremes; entropy
    is of a histogram with the larger of Sturges' and Freedman-Diaconis' bin
    counts. Equal values are counted before they are ranked."""
    x = df.where(present(column)).select(F.col(column).cast("double").alias("x"))
    quartiles = percentiles(x, ["x"], [0.25, 0.75]).select(F.col("x").alias("q"))
    one = x.agg(F.count("x").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).crossJoin(quartiles)
    span = F.col("b") - F.col("a")
    sturges = span / (F.log2("n") + 1)
    fd = 2 * (F.col("q")[1] - F.col("q")[0]) / F.cbrt(F.col("n").cast("double"))
    width = F.when(fd > 0, F.least(sturges, fd)).otherwise(sturges)
    limits = one.select("n", "a", "b", F.greatest(F.coalesce(F.ceil(F.try_divide(span, width)), F.lit(1)), F.lit(1)).alias("bins"))
    counted = x.groupBy("x").count().crossJoin(F.broadcast(limits))
    # ranks by ranges of values: each range is ordered by itself
    cell = F.least(F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("a"), span), F.lit(0.0)) * 4096), F.lit(4095))
    counted = counted.withColumn("cell", cell)
    cells = counted.groupBy("cell").agg(F.sum("count").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("cell")) - F.col("c"))
    ranked = counted.join(F.broadcast(cells.select("cell", "before")), "cell").withColumn("upto", F.col("before") + F.sum("count").over(Window.partitionBy("cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    u = F.coalesce(F.try_divide(F.col("x") - F.col("a"), span), F.lit(0.0))
    ks = ranked.agg(F.max(F.greatest(F.col("upto") / F.col("n") - u, u - (F.col("upto") - F.col("count")) / F.col("n"))).alias("ks"))
    b = F.least(F.floor(u * F.col("bins")), F.col("bins") - 1)
    shares = counted.groupBy(b.alias("bin")).agg((F.sum("count") / F.first("n")).alias("p"), F.first("bins").alias("bins"))
    entropy = shares.agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.max("bins").alias("bins")).select(F.when(F.col("bins") <= 1, 1.0).otherwise(F.try_divide(F.col("h"), F.log2("bins"))).alias("entropy"))
    named = ks.crossJoin(entropy)
    return rows(named, [(column, None, _level(F.col("ks"), F.col("entropy"))), (column, "ks", F.round("ks", 6)), (column, "entropy", F.round("entropy", 6))])
