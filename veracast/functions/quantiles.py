"""Exact percentiles with linear interpolation, of values that are neither
null nor NaN.

Up to ``direct`` rows Spark's exact aggregate is used, whose state holds every
distinct value of a column. Beyond, the values at the wanted ranks are enclosed
by counting: a histogram of CELLS cells round each of them a pass, for all
columns and points in one scan, until a cell holds one value only. Both ways
give the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 4096


def percentiles(df: DataFrame, columns: list[str], points: list[float], direct: int = 1_000_000) -> DataFrame:
    """One row with array columns named as ``columns``, a value for each point;
    null for a column without values."""
    double = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    df = df.select(*(double(c).alias(c) for c in columns))
    if df.limit(direct + 1).count() <= direct:
        return df.agg(*(F.percentile(F.col(c), F.array(*map(F.lit, points))).alias(c) for c in columns))
    one = df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("a", F.min), ("b", F.max)))).first()
    wanted: dict[int, set[int]] = {i: set() for i in range(len(columns))}
    for i in wanted:
        for p in points if one[f"n{i}"] else []:
            first = int(p * (one[f"n{i}"] - 1))
            wanted[i] |= {first, min(first + 1, one[f"n{i}"] - 1)}
    at = _at_ranks(df, columns, wanted, {i: (one[f"a{i}"], one[f"b{i}"]) for i in wanted})
    out = []
    for i in wanted:
        n, values = one[f"n{i}"], []
        for p in points if n else []:
            first = int(p * (n - 1))
            part = p * (n - 1) - first
            values.append(at[i, first] + (part * (at[i, min(first + 1, n - 1)] - at[i, first]) if part else 0.0))
        out.append(values if n else None)
    return df.sparkSession.createDataFrame([tuple(out)], ", ".join(f"`{c}` array<double>" for c in columns))


def _at_ranks(df: DataFrame, columns: list[str], wanted: dict[int, set[int]], limits: dict[int, tuple[float, float]]) -> dict[tuple[int, int], float]:
    """The values at the wanted ranks (from 0) of each column."""
    found: dict[tuple[int, int], float] = {}
    open_ = {(i, rank): (*limits[i], 0) for i in wanted for rank in wanted[i]}  # least, greatest, how many are less
    while open_:
        for (i, rank), (a, b, _) in list(open_.items()):
            if a == b:
                found[i, rank] = a
                del open_[i, rank]
        if not open_:
            break
        brackets = sorted({(i, a, b, before) for (i, _), (a, b, before) in open_.items()})
        cells = []
        for k, (i, a, b, _) in enumerate(brackets):
            x = F.col(columns[i])
            # halves first, as b - a may be too large for a double
            share = (x / 2 - a / 2) / F.lit(b / 2 - a / 2)
            cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1)) if b / 2 - a / 2 > 0 else F.when(x > a, 1).otherwise(0).cast("long")
            cells.append(F.when(x.between(a, b), F.struct(F.lit(k).alias("k"), cell.alias("cell"), x.alias("x"))))
        each = df.select(F.explode(F.array_compact(F.array(*cells))).alias("e")).select("e.*")
        counts: dict[int, list] = {}
        for k, cell, n, a, b in each.groupBy("k", "cell").agg(F.count("x"), F.min("x"), F.max("x")).collect():  # CELLS rows a bracket at most
            counts.setdefault(k, []).append((cell, n, a, b))
        for (i, rank), (a, b, before) in list(open_.items()):
            for _, n, x0, x1 in sorted(counts[brackets.index((i, a, b, before))]):
                if before + n > rank:
                    open_[i, rank] = (x0, x1, before)
                    break
                before += n
    return found
