"""Metrics of a synthetic table against a real one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracast.functions.blocks import Block, distances, least_of, over_pairs
from veracast.functions.longform import present, rows, with_stats
from veracast.functions.near import FEW, nearest
from veracast.operators.tabular import correlations

CELLS, GRID, EPS = 99, 300, 1e-10
PART = 1024


def _sides(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """syn (0 or 1) and x, in one frame."""
    part = lambda df, s: df.where(F.col(column).isNotNull()).select(F.lit(s).alias("syn"), F.col(column).alias("x"))
    return part(real, 0).unionByName(part(synthetic, 1))


def tv_similarity(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """1 - sum |p_r - p_s| / K over the K real categories."""
    n = _sides(real, synthetic, column).groupBy("x").agg(F.sum(1 - F.col("syn")).alias("r"), F.sum("syn").alias("s"))
    shares = n.select((F.col("r") / F.sum("r").over(Window.partitionBy())).alias("p"), F.coalesce(F.try_divide(F.col("s"), F.sum("s").over(Window.partitionBy())), F.lit(0.0)).alias("q"))
    value = shares.where("p > 0").agg((1 - F.sum(F.abs(F.col("p") - F.col("q"))) / F.count("p")).alias("v"))
    return rows(value, [(column, None, F.round("v", 6))])


def ks_similarity(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """1 - max(cdf_r - cdf_s), signed, over 99 equal cells of the pooled range."""
    both = _sides(real, synthetic, column).select("syn", F.col("x").cast("double").alias("x")).where(~F.isnan("x"))
    limits = both.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    # as numpy: a range of nought is widened by a half to each side
    limits = limits.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    cell = F.least(F.floor((F.col("x") - F.col("a")) / ((F.col("b") - F.col("a")) / CELLS)), F.lit(CELLS - 1))
    n = both.crossJoin(F.broadcast(limits)).groupBy(cell.alias("cell")).agg(F.sum(1 - F.col("syn")).alias("r"), F.sum("syn").alias("s"))
    total = Window.partitionBy()
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # of 99 rows
    gap = F.try_divide(F.sum("r").over(upto), F.sum("r").over(total)) - F.try_divide(F.sum("s").over(upto), F.sum("s").over(total))
    # an empty cell repeats the gap before it, and the last one's is nought
    value = n.select(gap.alias("gap")).agg((1 - F.max("gap")).alias("v"))
    return rows(value, [(column, None, F.round("v", 6))])


def statistical_similarity(real: DataFrame, synthetic: DataFrame, discrete: list[str], continuous: list[str]) -> DataFrame:
    """Both similarities by column, with mean and standard deviation."""
    parts = [tv_similarity(real, synthetic, c) for c in discrete] + [ks_similarity(real, synthetic, c) for c in continuous]
    return with_stats(reduce(DataFrame.unionByName, parts).select("key", "value"))


def densities(both: DataFrame, name: str = "") -> DataFrame:
    """densities_of() of one column, (syn, x): g, at, p and q."""
    return densities_of(both.select(F.lit(name).alias("key"), "syn", "x")).select("g", "at", "p", "q")


def densities_of(values: DataFrame) -> DataFrame:
    """Gaussian-kernel densities of (key, syn, x), for each key on a grid of 300
    points that both sides share: key, g (index), at, p (real) and q
    (synthetic), each with the sum 1.

    All keys are done in the same passes. Equal values are counted first; a
    task then adds up the kernels of its values at all points in NumPy, so what is
    shuffled is 300 sums a key, side and task. A side of one distinct value has
    all its mass on the nearest point."""
    x = values.select("key", "syn", F.col("x").cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    counted = x.groupBy("key", "syn", "x").count()
    side = x.groupBy("key", "syn").agg(F.count("x").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # two rows a key
    limits: dict[str, list] = {}
    for r in side:
        a, b = limits.get(r.key, (r.lo, r.hi))
        limits[r.key] = (min(a, r.lo), max(b, r.hi))
    of = {(r.key, r.syn): (r.sd * r.n**-0.2 if r.lo < r.hi else 0.0, r.lo) for r in side}

    def points(key: str) -> np.ndarray:
        a, b = limits[key]
        return a + np.arange(GRID) * ((b - a) / (GRID - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            key, syn = batch.column("key").to_numpy(zero_copy_only=False), batch.column("syn").to_numpy()
            x, n = batch.column("x").to_numpy(), batch.column("count").to_numpy()
            for one in of:
                mine = np.flatnonzero((key == one[0]) & (syn == one[1]))
                h, at = of[one][0], points(one[0])
                sums = total.setdefault(one, np.zeros(GRID))
                for part in np.array_split(mine, len(mine) // PART + 1):
                    if h > 0 and len(part):
                        z = x[part, None] - at[None, :]
                        z /= h
                        z *= z
                        z *= -0.5
                        sums += n[part] @ np.exp(z, out=z)
        for (key, syn), sums in total.items():
            if sums.any():
                yield pa.RecordBatch.from_arrays([pa.array([key] * GRID), pa.array([syn] * GRID, pa.int32()), pa.array(np.arange(GRID, dtype=np.int32)), pa.array(sums)], ["key", "syn", "g", "s"])

    sums = counted.mapInArrow(run, "key string, syn int, g int, s double").groupBy("key", "g").agg(*(F.sum(F.when(F.col("syn") == s, F.col("s"))).alias(f"k{s}") for s in (0, 1)))
    # the grid: 300 rows a key, with the point next to a side of one value
    grid = []
    for key in limits:
        at = points(key)
        alone = [int(np.argmin(np.abs(at - of[key, s][1]))) if (key, s) in of and not of[key, s][0] > 0 else -1 for s in (0, 1)]
        grid += [(key, g, float(at[g]), *(None if a < 0 else float(g == a) for a in alone)) for g in range(GRID)]
    spark = values.sparkSession
    grid = spark.createDataFrame(grid, "key string, g int, at double, one0 double, one1 double")
    whole = Window.partitionBy("key")  # 300 rows
    share = lambda s: F.coalesce(F.col(f"one{s}"), F.try_divide(F.col(f"k{s}"), F.sum(f"k{s}").over(whole)))
    return grid.join(sums, ["key", "g"], "left").select("key", "g", "at", share(0).alias("p"), share(1).alias("q"))


def kl(p: Column, q: Column) -> Column:
    return F.greatest(F.sum(F.when(p > 0, p * F.ln(p / (q + EPS))).otherwise(0.0)), F.lit(0.0))


def js(p: Column, q: Column) -> Column:
    m = (p + q) / 2 + EPS
    half = lambda x: F.sum(F.when(x > 0, x * F.log2(x / m)).otherwise(0.0))
    return F.greatest((half(p) + half(q)) / 2, F.lit(0.0))


def divergence(real: DataFrame, synthetic: DataFrame, columns: list[str], score: str = "kl") -> DataFrame:
    """Kullback-Leibler ("kl") or Jensen-Shannon ("js") divergence by column;
    mean and (sample) standard deviation."""
    of = {"kl": kl, "js": js}[score]
    # one scan a side: a row becomes one for each column
    each = lambda df, s: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("x")) for c in columns))).alias("e")).select("e.key", F.lit(s).alias("syn"), "e.x")
    pdf = densities_of(each(real, 0).unionByName(each(synthetic, 1)))
    return with_stats(pdf.groupBy("key").agg(of(F.col("p"), F.col("q")).alias("value")), sample=True)


def _ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Average ranks. Equal values are counted first, and only counts are put
    into one order, by ranges of the value."""
    out = df
    for c in columns:
        n = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).count()
        limits = n.agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        cell = F.coalesce(F.floor(F.try_divide((F.col("_v") - F.col("_a")).cast("double"), (F.col("_b") - F.col("_a")).cast("double")) * 1023), F.lit(0))
        n = n.crossJoin(F.broadcast(limits)).withColumn("_cell", cell)
        before = n.groupBy("_cell").agg(F.sum("count").alias("_c")).select("_cell", (F.sum("_c").over(Window.orderBy("_cell")) - F.col("_c")).alias("_before"))
        upto = F.sum("count").over(Window.partitionBy("_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
        rank = n.join(F.broadcast(before), "_cell").select("_v", (F.col("_before") + upto - (F.col("count") - 1) / 2).alias("_r"))
        out = out.join(rank, F.col(c) == F.col("_v"), "left").withColumn(c, F.col("_r")).drop("_v", "_r")
    return out


def concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weighted pairs that x and y put in the same order, less those that they
    put in opposite ones; ties in either are neither. By the bits of y's rank:
    at each bit, pairs are counted of which one has it and the other hasn't, among ranks
    that agree above it."""
    order = np.argsort(x, kind="stable")
    x, w = x[order], w[order].astype(np.int64)
    rank = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1])
    place = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(x)]])))  # rank of x
    total = 0.0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        group = rank >> (bit + 1)
        turn = np.argsort(group, kind="stable")  # within a group still by x
        g, one, weight, tie = group[turn], (rank[turn] >> bit) & 1, w[turn], place[turn]
        new = np.concatenate([[True], (np.diff(g) != 0) | (np.diff(tie) != 0)])
        start = np.flatnonzero(new)
        of = np.cumsum(new) - 1  # run of one group and one x
        head = start[np.flatnonzero(np.concatenate([[True], np.diff(g[start]) != 0]))]
        for has, sign in ((0, 1), (1, -1)):
            upto = np.concatenate([[0], np.cumsum(weight * (one == has))])
            before = upto[start][of] - upto[head][np.searchsorted(head, start, side="right") - 1][of]
            total += sign * float((before.astype(np.longdouble) * weight * (one != has)).sum())
    return total


def _kendall(df: DataFrame, columns: list[str], cells: int = 256) -> DataFrame:
    """tau-b for each pair of columns: r_i_j.

    Pairs of rows aren't formed. Equal pairs of values are counted first, and both columns
    are cut into up to ``cells`` ranges. Rows in different ranges of both columns are counted
    by sums over the cells x cells table; those that share a range of one
    column by concordance() within it, where rows that share both count once."""
    spark = df.sparkSession
    x = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    names = [f"x{i}" for i in range(len(columns))]
    # any cuts will do, so approximate ones of about equal shares
    cuts = x.agg(*(F.percentile_approx(n, [k / cells for k in range(1, cells)], 10_000).alias(n) for n in names)).first()
    out: dict[str, float | None] = {}
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            edges = [sorted(set(cuts[n] or [])) for n in (names[i], names[j])]
            both = x.where(F.nanvl(names[i], F.lit(None)).isNotNull() & F.nanvl(names[j], F.lit(None)).isNotNull()).groupBy(F.col(names[i]).alias("x"), F.col(names[j]).alias("y")).agg(F.count(F.lit(1)).alias("w"))
            both = both.mapInArrow(_ranged(edges), "x double, y double, w long, a int, b int")
            table = np.zeros((len(edges[0]) + 1, len(edges[1]) + 1), np.int64)
            for a, b, w in both.groupBy("a", "b").agg(F.sum("w")).collect():  # cells * cells rows at most
                table[a, b] = w
            far = _table_concordance(table)
            ends = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("at")) for k, c in enumerate("ab"))))
            near = both.select("*", ends.alias("e")).select("x", "y", "w", "a", "b", "e.side", "e.at").groupBy("side", "at").applyInArrow(_near, "s double").agg(F.sum("s")).first()[0] or 0
            ties = [both.groupBy(c).agg(F.sum("w").cast("decimal(38,0)").alias("w")).agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0 for c in "xy"]
            n = int(table.sum())
            free = [n * n - int(t) for t in ties]
            out[f"r_{i}_{j}"] = 2 * (far + near) / (float(free[0]) ** 0.5 * float(free[1]) ** 0.5) if all(free) else None
    return spark.createDataFrame([tuple(out.values())], ", ".join(f"{c} double" for c in out))


def _ranged(edges: list[list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [pa.array(np.searchsorted(e, batch.column(c).to_numpy(), side="right").astype(np.int32)) for c, e in zip("xy", edges)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in "xyw"), *at], ["x", "y", "w", "a", "b"])

    return run


def _table_concordance(table: np.ndarray) -> int:
    """Of rows in different ranges of both columns."""
    t = table.astype(object)  # exact, however many rows
    below = np.zeros((t.shape[0] + 1, t.shape[1] + 1), object)
    below[1:, 1:] = t.cumsum(0).cumsum(1)
    total = 0
    for a in range(t.shape[0]):
        row = below[a]  # rows of lower ranges of x, up to each range of y
        total += int((t[a] * (row[:-1] - (row[-1] - row[1:]))).sum())
    return total


def _near(table: pa.Table) -> pa.Table:
    """Of rows in one range of a column: all those in a range of x; in a range
    of y those that are in different ranges of x."""
    x, y, w, a, b = (table.column(c).to_numpy() for c in "xywab")
    if table.column("side")[0].as_py() == 0:
        s = concordance(x, y, w)
    else:
        s = concordance(a.astype(float), y, w)
    return pa.table({"s": pa.array([float(s)])})


def coherence(real: DataFrame, synthetic: DataFrame, columns: list[str], kind: str = "pearson", weights: list[float] | None = None) -> DataFrame:
    """1 - weighted mean |R - S| / 2 of the correlation matrices; a correlation
    that isn't defined counts as 1."""

    def matrix(df: DataFrame, side: str) -> DataFrame:
        df = df.select(*columns)
        one = _kendall(df, columns) if kind == "kendall" else (_ranks(df, columns) if kind == "spearman" else df).agg(*correlations(df, columns))
        return one.select(*(F.coalesce(c, F.lit(1.0)).alias(f"{side}_{c}") for c in one.columns))

    p = len(columns)
    w = weights or [1.0] * p
    column_sum = [(p - 1) * w[j] for j in range(p)]
    both = matrix(real, "a").crossJoin(matrix(synthetic, "b"))
    terms = [F.abs(F.col(f"a_r_{min(i, j)}_{max(i, j)}") - F.col(f"b_r_{min(i, j)}_{max(i, j)}")) * (w[j] / column_sum[j]) for i in range(p) for j in range(p) if i != j]
    value = 1 - reduce(lambda a, b: a + b, terms) / p / 2
    return rows(both, [(None, None, F.round(value, 3))])


def standardised(df: DataFrame, columns: list[str], by: DataFrame) -> DataFrame:
    """Columns less the mean over the population deviation of ``by``; a constant one less the mean."""
    stats = F.broadcast(by.agg(*(f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))))
    scale = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return df.crossJoin(stats).select(*(c for c in df.columns if c not in columns), *(((F.col(c) - F.col(f"_m_{c}")) / scale(c)).alias(c) for c in columns))


def nearest_two(query: DataFrame, target: DataFrame, id_: str, columns: list[str], itself: bool) -> DataFrame:
    """_q, d1 and d2: distances of each query row to its two nearest target
    rows other than itself, null where there are fewer. Rows with a null in a
    column are in neither table. Ids are integers."""
    side = lambda df: df.dropna(subset=columns).select(F.col(id_).cast("long").alias("id"), F.array(*(F.col(c).cast("double") for c in columns)).alias("v"))
    finite = lambda df: not df.where(F.exists("v", lambda e: F.abs(e) == float("inf"))).take(1)
    if len(columns) <= FEW and (not itself or query is target) and finite(side(target)) and (query is target or finite(side(query))):
        return _nearest_two(side(query), side(target), len(columns), itself)

    def run(a: Block, b: Block) -> pa.RecordBatch:
        d = distances(a[1], b[1])
        if itself:
            d[a[0][:, None] == b[0][None, :]] = np.inf
        return pa.RecordBatch.from_arrays([pa.array(a[0]), least_of(d, 2)], ["id", "d"])

    parts = over_pairs(side(query), side(target), run, "id long, d array<double>")
    two = parts.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, 2).alias("d"))
    at = lambda i: F.when(F.get("d", F.lit(i)) < float("inf"), F.get("d", F.lit(i)))
    return two.select(F.col("id").alias("_q"), at(0).alias("d1"), at(1).alias("d2"))


def _nearest_two(query: DataFrame, target: DataFrame, width: int, itself: bool) -> DataFrame:
    """nearest_two() of few columns. Equal points are looked up once, with how
    many rows there are; a row itself is one of those at its own point."""
    points = target.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    found = nearest(query.select("v").distinct(), points, width, 3 if itself else 2)
    every = F.array_sort(F.flatten(F.transform("near", lambda e: F.array_repeat(e["d"], F.least(e["n"], F.lit(3)).cast("int")))))
    two = found.select("v", F.slice(every, 2 if itself else 1, 2).alias("d"))
    return query.join(two, "v", "left").select(F.col("id").alias("_q"), F.get("d", F.lit(0)).alias("d1"), F.get("d", F.lit(1)).alias("d2"))


def privacy(real: DataFrame, synthetic: DataFrame, id_: str, columns: list[str], kind: str = "dcr", low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Distance to the closest record ("dcr") or its ratio to the second
    closest ("nndr"): privacy (100 - leak), and overlap, leak, nfidel, fidel,
    divers and ctd_disp, in percent of the densities of both sides."""
    value = F.col("d1") if kind == "dcr" else F.col("d1") / (F.col("d2") + EPS)
    own = nearest_two(real, real, id_, columns, True).select(F.lit(0).alias("syn"), value.alias("x"))
    other = nearest_two(synthetic, real, id_, columns, False).select(F.lit(1).alias("syn"), value.alias("x"))
    return pdf_summary(densities(own.unionByName(other)), low, high)


def pdf_summary(pdf: DataFrame, low: float, high: float) -> DataFrame:
    upto = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)  # of 300 rows
    cdf = pdf.select("*", F.sum("p").over(upto).alias("cp"), F.sum("q").over(upto).alias("cq"))
    first = lambda c, x: F.min(F.when(F.col(c) >= x, F.col("g")))
    marks = cdf.agg(first("cp", low).alias("pl"), first("cp", high).alias("ph"), first("cq", low).alias("ql"), first("cq", high).alias("qh"), F.min("at").alias("a"), F.max("at").alias("b"))
    one = cdf.crossJoin(F.broadcast(marks)).agg(
        F.sum(F.least("p", "q")).alias("overlap"),
        F.sum(F.when(F.col("g") < F.col("pl"), F.col("q")).otherwise(0.0)).alias("leak"),
        F.sum(F.when(F.col("g") >= F.col("ph"), F.col("q")).otherwise(0.0)).alias("nfidel"),
        F.first(F.try_divide(F.col("qh") - F.col("ql"), F.greatest("ph", "qh") - F.least("pl", "ql"))).alias("divers"),
        ((F.try_divide(F.sum(F.col("q") * F.col("at")) - F.sum(F.col("p") * F.col("at")), F.first(F.col("b") - F.col("a"))) + 1) / 2).alias("ctd"),
    )
    percent = lambda c: F.round(100 * c, 1)
    return rows(one, [(None, None, 100 - percent(F.col("leak"))), (None, "overlap", percent(F.col("overlap"))), (None, "leak", percent(F.col("leak"))), (None, "nfidel", percent(F.col("nfidel"))), (None, "fidel", percent(1 - F.col("leak") - F.col("nfidel"))), (None, "divers", percent(F.col("divers"))), (None, "ctd_disp", percent(F.col("ctd")))])


def change_percent(a: Column, b: Column) -> Column:
    return (a - b) / (b + 1e-20) * 100
