"""From a raw table to numbers: types, missing values, codes, scales, components.

Whatever is fitted is a small frozen object (a few numbers a column, or the
options of a column with few of them), taken in one or two aggregates; what it
does to rows is column expressions, so a chain of steps is one stage.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracast.functions.blocks import over_pairs
from veracast.functions.near import FEW, nearest
from veracast.functions.quantiles import percentiles

SENTINELS = (999, -1, "NaN", "nan")
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def _is_number(kind: str) -> bool:
    return kind in NUMBERS or kind.startswith("decimal")


def resolve(columns: list[str], names: list[str] | None) -> list[str]:
    """Columns that hold one of the names as a part; all, if none does or none is given."""
    found = [c for c in columns if any(n in c for n in names or [])]
    return found or list(columns)


def without_sentinels(df: DataFrame, columns: list[str] | None = None, values: tuple = SENTINELS) -> DataFrame:
    """Values that stand for a missing one, and NaN, as null."""
    numbers = [float(v) for v in values if not isinstance(v, str)]
    words = [v for v in values if isinstance(v, str)]
    out = []
    for c, kind in df.dtypes:
        x = F.col(c)
        if columns is not None and c not in columns:
            out.append(x)
        elif kind in ("float", "double"):
            out.append(F.when(~x.isin(numbers) & ~F.isnan(x), x).alias(c))
        elif _is_number(kind) and kind != "boolean":
            out.append(F.when(~x.isin([int(v) for v in numbers]), x).alias(c))
        elif kind == "string":
            out.append(F.when(~x.isin(words + [str(v) for v in values if not isinstance(v, str)]), x).alias(c))
        else:
            out.append(x)
    return df.select(*out)


#: options that profile() lists at most
LISTED = 1000


def options(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, NaN and null left out: (value, n)."""
    x = F.col(column)
    known = x.isNotNull() & ~F.isnan(x) if dict(df.dtypes)[column] in ("float", "double") else x.isNotNull()
    return df.where(known).groupBy(x.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, columns: list[str] | None = None, few: int = 10, share: float = 0.03) -> DataFrame:
    """column, tag (discrete or continuous), is_categ (0 or 1), dtype
    (numerical, integer or string), n_options and options (in order, as text)
    of each column.

    Discrete are columns with under ``few`` distinct values and those that
    aren't numeric. Numbers of options are exact. Options are listed of discrete
    columns with at most LISTED of them, as more don't fit into a row;
    options() has those of any column. Two passes, in which
    values are counted in a shuffle, never in one task."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    wanted = []
    for i, c in enumerate(columns):
        x = F.col(c)
        number = x.cast("double") if _is_number(kinds[c]) else x.try_cast("double") if kinds[c] == "string" else F.lit(None).cast("double")
        seen = x.isNotNull()
        wanted += [F.coalesce(F.bool_and(F.when(seen, number.isNotNull())), F.lit(True)).alias(f"num{i}"), F.coalesce(F.bool_and(F.when(seen & ~F.isnan(number), number == F.floor(number))), F.lit(True)).alias(f"int{i}")]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *wanted).first()
    # (column, value) rows: made distinct in a shuffle, whatever their number
    text = lambda c: F.nanvl(F.col(c), F.lit(None).cast(kinds[c])).cast("string") if kinds[c] in ("float", "double") else F.col(c).cast("string")
    each = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), text(c).alias("x")) for i, c in enumerate(columns)))).alias("e")).select("e.*").where("x is not null").distinct()
    found = {r.i: r["count"] for r in each.groupBy("i").count().collect()}  # a row a column
    few_columns = [i for i in range(len(columns)) if found.get(i, 0) <= LISTED]
    sets = df.agg(*(F.collect_set(F.col(columns[i])).alias(f"s{i}") for i in few_columns)).first() if few_columns else {}
    out = []
    for i, c in enumerate(columns):
        number, integer = one[f"num{i}"], one[f"int{i}"] and one[f"num{i}"]
        k, values = found.get(i, 0), None
        if i in few_columns:
            values = [x for x in sets[f"s{i}"] if not (isinstance(x, float) and np.isnan(x))]
            values = sorted(values, key=lambda x: float(x) if number else str(x))
            k = len(values)
        discrete = k < few or not number
        text_ = [_text(x, number) for x in values] if discrete and values is not None else None
        out.append((c, "discrete" if discrete else "continuous", int(discrete and k < share * one["rows"]), "string" if not number else "integer" if integer else "numerical", int(k) if discrete else 0, text_))
    return df.sparkSession.createDataFrame(out, "column string, tag string, is_categ int, dtype string, n_options long, options array<string>")


def _text(x, number: bool) -> str:
    return f"{float(x):.10g}" if number else str(x)


@dataclass(frozen=True)
class Encoder:
    """Codes from 1 on, in order, for the options of discrete columns."""

    options: dict[str, list] = field(default_factory=dict)

    @staticmethod
    def fit(df: DataFrame, columns: list[str], most: int = 10_000) -> Encoder:
        """Codes are looked up in an expression that holds all options, so more
        than about ``most`` are refused, before any is gathered."""
        if not columns:
            return Encoder({})
        many = df.agg(*(F.approx_count_distinct(c, 0.02).alias(f"n{i}") for i, c in enumerate(columns))).first()
        for i, c in enumerate(columns):
            if many[f"n{i}"] > most * 1.1:
                raise ValueError(f"{c} has more than {most} options")
        one = df.agg(*(F.array_sort(F.collect_set(c)).alias(f"s{i}") for i, c in enumerate(columns))).first()
        return Encoder({c: list(one[f"s{i}"]) for i, c in enumerate(columns)})

    def encode(self, df: DataFrame) -> DataFrame:
        """Codes as doubles; a value without a code is null."""
        code = lambda c, v: F.array_position(F.array(*map(F.lit, v)), F.col(c)) if v else F.lit(0)
        return df.select(*((F.when(code(c, self.options[c]) > 0, code(c, self.options[c]).cast("double")).alias(c) if c in self.options else F.col(c)) for c in df.columns))

    def decode(self, df: DataFrame) -> DataFrame:
        """Options of the nearest codes; null where there is none."""
        value = lambda c, v: F.get(F.array(*map(F.lit, v)), F.round(F.col(c)).cast("int") - 1)
        return df.select(*((value(c, self.options[c]).alias(c) if self.options.get(c) else F.col(c)) for c in df.columns))

    def one_hot(self, df: DataFrame) -> DataFrame:
        """Encoded columns of more than two options as 0 / 1 columns
        <column>_OH-<code>; others as <column>_OR."""
        out = []
        for c in df.columns:
            v = self.options.get(c)
            if v and len(v) > 2:
                out += [F.when(F.col(c) == k, 1.0).otherwise(0.0).alias(f"{c}_OH-{k}") for k in range(1, len(v) + 1)]
            else:
                out.append(F.col(c).alias(f"{c}_OR"))
        return df.select(*out)

    def from_one_hot(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """Codes again: the largest of a column's indicators, the nearer of two options."""
        out = []
        for c in columns:
            v = self.options.get(c)
            if v and len(v) > 2:
                every = F.array(*(F.col(f"`{c}_OH-{k}`") for k in range(1, len(v) + 1)))
                out.append(F.array_position(every, F.array_max(every)).cast("double").alias(c))
            elif v and len(v) == 2:
                out.append(F.when(F.col(f"`{c}_OR`") >= 1.5, 2.0).otherwise(1.0).alias(c))
            else:
                out.append(F.col(f"`{c}_OR`").alias(c))
        return df.select(*out)

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f)

    @staticmethod
    def load(path: str) -> Encoder:
        with open(path) as f:
            return Encoder(**json.load(f))


SCALERS = ("standard", "minmax", "maxabs", "robust", "identity")


@dataclass(frozen=True)
class Scaler:
    """(x - shift) / scale of each column."""

    shift: dict[str, float]
    scale: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, columns: list[str], kind: str = "standard") -> Scaler:
        if kind not in SCALERS:
            raise ValueError(f"{kind} is none of {', '.join(SCALERS)}")
        if kind == "identity":
            return Scaler({c: 0.0 for c in columns}, {c: 1.0 for c in columns})
        x = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
        if kind == "robust":
            one = percentiles(x, columns, [0.25, 0.5, 0.75]).first()
            pairs = {c: (one[c][1], one[c][2] - one[c][0]) if one[c] else (0.0, 1.0) for c in columns}
        else:
            f = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, lambda c: F.max(c) - F.min(c)), "maxabs": (lambda c: F.lit(0.0) * F.max(c), lambda c: F.max(F.abs(c)))}[kind]
            clean = x.select(*(F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in columns))
            one = clean.agg(*(g(F.col(c)).alias(f"{c}_{i}") for c in columns for i, g in enumerate(f))).first()
            pairs = {c: (one[f"{c}_0"], one[f"{c}_1"]) for c in columns}
        return Scaler({c: p[0] or 0.0 for c, p in pairs.items()}, {c: p[1] or 1.0 for c, p in pairs.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*((((F.col(c).cast("double") - self.shift[c]) / self.scale[c]).alias(c) if c in self.shift else F.col(c)) for c in df.columns))

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.select(*(((F.col(c) * self.scale[c] + self.shift[c]).alias(c) if c in self.shift else F.col(c)) for c in df.columns))


def impute(df: DataFrame, columns: list[str], kind: str = "mean") -> DataFrame:
    """Missing values (null or NaN) as the column's mean, median or mode (the
    least of equally common ones). Columns of integers get the nearest integer."""
    kinds = dict(df.dtypes)
    clean = lambda c: _clean(c, kinds[c])
    fill = F.broadcast(_fills(df, columns, kind).select(*(F.col(c).alias(f"_fill_{c}") for c in columns)))  # one row
    whole = lambda c: F.round(f"_fill_{c}").cast(kinds[c]) if kinds[c] in ("tinyint", "smallint", "int", "bigint") else F.col(f"_fill_{c}")
    return df.crossJoin(fill).select(*((F.coalesce(clean(c), whole(c)).alias(c) if c in columns else F.col(c)) for c in df.columns))


def _clean(c: str, kind: str) -> Column:
    return F.nanvl(F.col(c), F.lit(None).cast(kind)) if kind in ("float", "double") else F.col(c)


@dataclass(frozen=True)
class Imputer:
    """Fill values of each column, kept from the table that they were fitted on."""

    kind: str
    values: dict[str, float | str | None]

    @staticmethod
    def fit(df: DataFrame, columns: list[str], kind: str = "mean") -> Imputer:
        return Imputer(kind, _fills(df, columns, kind).first().asDict() if columns else {})

    def transform(self, df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        fill = lambda c: F.lit(self.values[c]).cast(kinds[c]) if kinds[c] not in ("tinyint", "smallint", "int", "bigint") else F.round(F.lit(self.values[c])).cast(kinds[c])
        return df.select(*((F.coalesce(_clean(c, kinds[c]), fill(c)).alias(c) if self.values.get(c) is not None else F.col(c)) for c in df.columns))


def _fills(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """One row of the columns' fill values."""
    kinds = dict(df.dtypes)
    clean = lambda c: F.nanvl(F.col(c), F.lit(None).cast(kinds[c])) if kinds[c] in ("float", "double") else F.col(c)
    if kind == "mode":
        parts = [df.select(clean(c).alias("v")).where("v is not null").groupBy("v").count().agg(F.max_by("v", F.struct("count", *([-F.col("v")] if _is_number(kinds[c]) and kinds[c] != "boolean" else []))).alias(c)) if _is_number(kinds[c]) else df.select(F.col(c).alias("v")).where("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").limit(1).agg(F.first("v").alias(c)) for c in columns]
        fill = reduce(lambda a, b: a.crossJoin(b), parts)
    elif kind == "median":
        fill = percentiles(df.select(*(clean(c).cast("double").alias(c) for c in columns)), columns, [0.5]).select(*(F.get(c, F.lit(0)).alias(c) for c in columns))
    elif kind == "mean":
        fill = df.agg(*(F.avg(clean(c)).alias(c) for c in columns))
    else:
        raise ValueError(f"{kind} is none of mean, median and mode")
    return fill.select(*columns)


def impute_knn(df: DataFrame, id_: str, columns: list[str], k: int = 2) -> DataFrame:
    """Missing values as the mean of the k nearest rows that have one. The
    distance is Euclidean over the columns that both rows have, on standard
    scales, weighted up for missing ones. Rows that have the same columns, as rows
    with gaps and rows that fill them, are looked up by nearest(); with many columns, or
    many such kinds, rows with gaps meet all rows, cell by cell of a grid, and only
    the k least distances of a gap leave a cell. A column's mean stands in where no row is comparable. Ids are integers; of equal distances the lower id is nearer."""
    p = len(columns)
    x = df.select(F.col(id_).cast("long").alias("id"), *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns))
    scaler = Scaler.fit(x, columns)
    nan = lambda c: F.coalesce(F.col(c), F.lit(float("nan")))
    every = scaler.transform(x).select("id", F.array(*map(nan, columns)).alias("v"))
    gaps = every.where(F.exists("v", lambda e: F.isnan(e)))

    def run(a, b):
        (ids, g, _), (others, v, _) = a, b
        has_g, has_v = ~np.isnan(g), ~np.isnan(v)
        z, y = np.where(has_g, g, 0.0), np.where(has_v, v, 0.0)
        shared = has_g.astype(float) @ has_v.T.astype(float)
        square = np.zeros(shared.shape)
        for i in range(p):
            square += ((z[:, i, None] - y[None, :, i]) ** 2) * has_g[:, i, None] * has_v[None, :, i]
        d = np.sqrt(np.divide(square * p, shared, out=np.full(shared.shape, np.inf), where=shared > 0))
        d[ids[:, None] == others[None, :]] = np.inf
        order = np.argsort(others, kind="stable")
        others, d, has_v, v = others[order], d[:, order], has_v[order], v[order]
        out = []
        for i in range(p):
            rows_ = np.flatnonzero(~has_g[:, i])
            own = np.flatnonzero(has_v[:, i])
            if len(rows_) and len(own):
                apart = d[np.ix_(rows_, own)]
                near = np.argsort(apart, axis=1, kind="stable")[:, :k]
                r = np.repeat(rows_, near.shape[1])
                out.append((ids[r], np.full(len(r), i), others[own[near.ravel()]], np.take_along_axis(apart, near, 1).ravel(), v[own[near.ravel()], i]))
        if not out:
            return None
        u, i, o, d, value = (np.concatenate(c) for c in zip(*out))
        keep = np.isfinite(d)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (u, i, o, d, value)], ["g", "i", "o", "d", "x"])

    if p <= FEW and (kinds := _kinds(every, p)) is not None:
        near = _near_by_kind(every, kinds, p, k)
    else:
        near = over_pairs(gaps, every, run, "g long, i long, o long, d double, x double", 256, 2048)
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("g", "i").orderBy("d", "o"))).where(F.col("n") <= k)
    got = near.groupBy("g").pivot("i", list(range(p))).agg(F.avg("x"))
    got = got.select("g", *((F.col(str(i)) * scaler.scale[c] + scaler.shift[c]).alias(f"_k{i}") for i, c in enumerate(columns)))
    means = F.broadcast(x.agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns))))
    out = df.join(got, F.col(id_).cast("long") == F.col("g"), "left").crossJoin(means)
    value = lambda c, i: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.col(f"_k{i}"), F.col(f"_m{i}"))
    return out.select(*((value(c, columns.index(c)).alias(c) if c in columns else F.col(c)) for c in df.columns))


def _there(p: int) -> Column:
    """Which columns of v a row has, as bits."""
    return reduce(lambda a, b: a + b, (F.when(~F.isnan(F.get("v", F.lit(i))), 1 << i).otherwise(0) for i in range(p)))


def _kinds(every: DataFrame, p: int, most: int = 64) -> list[tuple[int, int]] | None:
    """Kinds of rows that can fill each other's gaps, by the columns they have: one
    with gaps, and one that has a column of those and another in common. None if they are
    more than ``most``, or a number is infinite."""
    if every.where(F.exists("v", lambda e: F.abs(e) == float("inf"))).take(1):
        return None
    there = [r[0] for r in every.select(_there(p)).distinct().collect()]  # 2^p rows at most
    kinds = [(a, b) for a in there for b in there if a & b and b & ~a]
    return kinds if len(kinds) <= most else None


def _near_by_kind(every: DataFrame, kinds: list[tuple[int, int]], p: int, k: int) -> DataFrame:
    """g, i, o, d, x: of each gap the k nearest rows of each kind that can fill
    it. Of rows at one point only the k of the lowest ids can be among them. A row with
    a gap is none of those that fill it."""
    rows_ = every.withColumn("_has", _there(p))
    out = None
    for a, b in kinds:
        shared, missing = ([i for i in range(p) if bits >> i & 1] for bits in (a & b, b & ~a))
        at = F.array(*(F.get("v", F.lit(i)) for i in shared))
        query = rows_.where(F.col("_has") == a).select("id", at.alias("at"))
        ranked = rows_.where(F.col("_has") == b).select(F.col("id").alias("o"), "v", at.alias("at")).withColumn("_n", F.row_number().over(Window.partitionBy("at").orderBy("o"))).where(F.col("_n") <= k)
        fills = ranked.groupBy("at").agg(F.min("o").alias("n"), F.collect_list(F.struct("o", "v")).alias("own"))  # k rows a point
        found = nearest(query.select(F.col("at").alias("v")).distinct(), fills.select(F.col("at").alias("v"), "n"), len(shared), k, p, len(shared))
        found = found.select(F.col("v").alias("at"), F.explode("near").alias("e")).select("at", "e.d", "e.n").join(fills.select("n", "own"), "n").select("at", "d", F.explode("own").alias("e")).select("at", "d", "e.o", "e.v")
        best = found.withColumn("_n", F.row_number().over(Window.partitionBy("at").orderBy("d", "o"))).where(F.col("_n") <= k)
        each = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.get("v", F.lit(i)).alias("x")) for i in missing)))
        one = query.join(best, "at").select(F.col("id").alias("g"), "o", "d", each.alias("e")).select("g", "e.i", "o", "d", "e.x")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else every.sparkSession.createDataFrame([], "g long, i long, o long, d double, x double")


@dataclass(frozen=True)
class Components:
    """Principal components: means, and a row of loadings for each."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    loadings: tuple[tuple[float, ...], ...]
    variance: tuple[float, ...]

    @staticmethod
    def fit(df: DataFrame, columns: list[str], k: int = 2) -> Components:
        """From the covariance, one pass; p x p numbers reach the driver. Signs
        are such that each component's largest loading is positive."""
        p = len(columns)
        x = [F.col(c).cast("double") for c in columns]
        one = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p))).first()
        cov = np.array([[one[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
        value, vector = np.linalg.eigh(cov)
        order = np.argsort(-value)[:k]
        rows_ = []
        for i in order:
            v = vector[:, i]
            rows_.append(tuple(float(z) for z in v * np.sign(v[np.argmax(np.abs(v))])))
        return Components(tuple(columns), tuple(one[f"m{i}"] or 0.0 for i in range(p)), tuple(rows_), tuple(float(value[i]) for i in order))

    def transform(self, df: DataFrame) -> DataFrame:
        """Other columns, then pc1, pc2, ..."""
        score = lambda row: reduce(lambda a, b: a + b, ((F.col(c).cast("double") - m) * w for c, m, w in zip(self.columns, self.mean, row)))
        return df.select(*(c for c in df.columns if c not in self.columns), *(score(row).alias(f"pc{i}") for i, row in enumerate(self.loadings, 1)))

    def inverse(self, df: DataFrame) -> DataFrame:
        value = lambda j: reduce(lambda a, b: a + b, (F.col(f"pc{i}") * row[j] for i, row in enumerate(self.loadings, 1)), F.lit(self.mean[j]))
        return df.select(*(c for c in df.columns if not c.startswith("pc")), *(value(j).alias(c) for j, c in enumerate(self.columns)))


def embedded(df: DataFrame, id_: str, columns: list[str], kind: str = "isomap", k: int = 5, dimensions: int = 2, most: int = 3000) -> DataFrame:
    """id and e1, e2, ...: isometric mapping ("isomap") or locally linear
    embedding ("lle"). Both need an eigendecomposition over all rows, so they
    run in one task and refuse more than ``most`` rows."""
    if (n := df.count()) > most:
        raise ValueError(f"{n} rows are too many for {kind}; {most} is the most")

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(id_).reset_index(drop=True)
        x = pdf[list(columns)].to_numpy(float)
        if len(x) <= dimensions + 1:
            out = np.zeros((len(x), dimensions))
        else:
            out = (_isomap if kind == "isomap" else _lle)(x, min(k, len(x) - 1), dimensions)
        return pd.DataFrame({id_: pdf[id_], **{f"e{i + 1}": out[:, i] for i in range(dimensions)}})

    schema = f"{id_} {dict(df.dtypes)[id_]}, " + ", ".join(f"e{i + 1} double" for i in range(dimensions))
    return df.select(id_, *columns).groupBy(F.lit(0).alias("_one")).applyInPandas(run, schema)


def _neighbours(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1), 0)) if len(x) < 500 else np.stack([np.sqrt(((x - r) ** 2).sum(1)) for r in x])
    near = np.argsort(d + np.diag(np.full(len(x), np.inf)), axis=1, kind="stable")[:, :k]
    return d, near


def _signed(v: np.ndarray) -> np.ndarray:
    return v * np.where(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])] < 0, -1, 1)


def _isomap(x: np.ndarray, k: int, dimensions: int) -> np.ndarray:
    d, near = _neighbours(x, k)
    n = len(x)
    g = np.full((n, n), np.inf)
    i = np.repeat(np.arange(n), k)
    g[i, near.ravel()] = g[near.ravel(), i] = d[i, near.ravel()]
    np.fill_diagonal(g, 0)
    for m in range(n):  # all shortest paths
        np.minimum(g, g[:, m, None] + g[None, m, :], out=g)
    g[np.isinf(g)] = g[np.isfinite(g)].max() * 2 if np.isfinite(g).any() else 1.0  # unconnected parts
    b = -0.5 * g**2
    b = b - b.mean(0) - b.mean(1)[:, None] + b.mean()
    value, vector = np.linalg.eigh(b)
    top = np.argsort(-value)[:dimensions]
    return _signed(vector[:, top]) * np.sqrt(np.maximum(value[top], 0))


def _lle(x: np.ndarray, k: int, dimensions: int, reg: float = 1e-3) -> np.ndarray:
    _, near = _neighbours(x, k)
    n = len(x)
    w = np.zeros((n, n))
    for i in range(n):
        z = x[near[i]] - x[i]
        c = z @ z.T
        c += np.eye(k) * (reg * np.trace(c) if np.trace(c) > 0 else reg)
        s = np.linalg.solve(c, np.ones(k))
        w[i, near[i]] = s / s.sum()
    m = (np.eye(n) - w).T @ (np.eye(n) - w)
    return _signed(np.linalg.eigh(m)[1][:, 1 : dimensions + 1])


def row_to_text(df: DataFrame, columns: list[str], shuffle_seed: int | None = None) -> Column:
    """"column is value, ..." of each row; with a seed, in an order of its own."""
    parts = F.array_compact(F.array(*(F.concat(F.lit(f"{c} is "), F.col(c).cast("string")) for c in columns)))
    if shuffle_seed is not None:
        parts = F.array_sort(parts, lambda a, b: F.signum(F.xxhash64(a, F.lit(shuffle_seed)).cast("double") - F.xxhash64(b, F.lit(shuffle_seed)).cast("double")).cast("int"))
    return F.array_join(parts, ", ")


@dataclass(frozen=True)
class Prepared:
    """A fitted chain: fill values, codes, scales and components. Text columns
    are filled with their mode before they are coded, others as asked for; a
    table that is transformed gets the values of the one that was fitted."""

    imputers: tuple[Imputer, ...]
    encoder: Encoder
    scaler: Scaler
    components: Components | None
    columns: tuple[str, ...]
    hot: bool

    @staticmethod
    def fit(df: DataFrame, columns: list[str], scaler: str = "standard", imputer: str = "mean", one_hot: bool = False, components: int | None = None) -> Prepared:
        """Indicators of one-hot codes aren't scaled."""
        kinds = dict(df.dtypes)
        x = without_sentinels(df.select(*columns), values=("NaN", "nan"))
        text = [c for c in columns if kinds[c] == "string"]
        imputers = tuple(Imputer.fit(x, own, kind) for own, kind in ((text, "mode"), ([c for c in columns if c not in text], imputer)) if own)
        encoder = Encoder.fit(x, text)
        for own in imputers:
            x = own.transform(x)
        x = encoder.encode(x)
        if one_hot:
            x = encoder.one_hot(x)
        fitted = Scaler.fit(x, [c for c in x.columns if "_OH-" not in c], scaler)
        return Prepared(imputers, encoder, fitted, Components.fit(fitted.transform(x), x.columns, components) if components else None, tuple(columns), one_hot)

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """The columns that were fitted, and those of ``keep`` as they are."""
        x = without_sentinels(df.select(*keep, *self.columns), list(self.columns), values=("NaN", "nan"))
        for own in self.imputers:
            x = own.transform(x)
        x = self.encoder.encode(x)
        if self.hot:
            x = self._one_hot(x, keep)
        x = self.scaler.transform(x)
        return self.components.transform(x) if self.components else x

    def _one_hot(self, x: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        names = self.encoder.one_hot(x.select(*self.columns)).columns
        hot = self.encoder.one_hot(x)
        return hot.select(*(F.col(f"`{c}_OR`").alias(c) for c in keep), *(F.col(f"`{c}`") for c in names))

    def inverse(self, df: DataFrame) -> DataFrame:
        x = self.components.inverse(df) if self.components else df
        x = self.scaler.inverse(x)
        return self.encoder.decode(self.encoder.from_one_hot(x, list(self.columns)) if self.hot else x)
