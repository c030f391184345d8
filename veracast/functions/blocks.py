"""All pairs of two sets of vectors, cell by cell of a grid.

Left vectors are dealt to the rows of a grid and right ones to its columns, by
a hash of their ids, and each is sent to the cells of its row or column: with
p cells a vector is shipped about sqrt(p) times, not once for each block of the
other side. A cell's function sees two NumPy blocks at a time and returns what
remains of their pairs: sums, counts or a few least distances. The pairs
themselves are never materialised: a cell holds its two sides, each of MOST
bytes at most, and the distances of one block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, WIDE = 1024, 2048
MOST = 1 << 24
Block = tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]


def _rows(n: int, width: int, wanted: int) -> int:
    """Rows of a grid for n vectors: as many as wanted, but no fewer than
    memory asks for, nor more than give each some vectors."""
    return max(1, -(-n * width * 8 // MOST), min(wanted, -(-n // 64)))


def _block(table: pa.Table) -> Block:
    ids = table.column("id").to_numpy()
    x = table.column("v").combine_chunks()
    x = (pa.concat_arrays([c.flatten() for c in x.chunks]) if isinstance(x, pa.ChunkedArray) else x.flatten()).to_numpy(zero_copy_only=False)
    more = [n for n in table.schema.names if n not in ("id", "v", "_i", "_j")]
    return ids, x.reshape(len(ids), -1), {c: table.column(c).to_numpy() for c in more}


def _part(block: Block, a: int, n: int) -> Block:
    return block[0][a : a + n], block[1][a : a + n], {c: x[a : a + n] for c, x in block[2].items()}


def over_pairs(left: DataFrame, right: DataFrame, run: Callable[[Block, Block], pa.RecordBatch | None], schema: str, size: int = SIZE, wide: int = WIDE, like: tuple[DataFrame, DataFrame] | None = None, half: bool = False, add: dict[str, str] | None = None) -> DataFrame:
    """The rows of run(left block, right block) for blocks of up to ``size``
    and ``wide`` vectors that hold every pair of (id, v array<double>, ...) once.
    ``like``: frames that are as large, to measure in place of sides that take work to get.
    ``half``: of two sides that are the same set only the cells on and above the
    diagonal; run() gets a third argument, 2 for pairs that stand for their
    mirror images too, or 1. ``add``: columns of the result with how they are added up
    ("sum", "min", "max") for equal others; a cell does so now and then, so that what
    it has to hold doesn't grow with its number of blocks."""
    cores = left.sparkSession.sparkContext.defaultParallelism
    measure = lambda df: df.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    (n, width), (m, _) = (measure(df) for df in like or (left, right))
    wanted = math.ceil(math.sqrt(4 * cores))
    down, across = (_rows(k, width or 1, wanted) for k in (n, m))
    if half:
        down = across = max(1, -(-n * (width or 1) * 8 // MOST), min(math.ceil(math.sqrt(8 * cores)), -(-n // 64)))
    own = lambda k, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k)).cast("int")
    first, last = (F.col("_i"), F.col("_j")) if half else (F.lit(0), F.lit(down - 1))
    a = left.withColumn("_i", own(down, 1)).withColumn("_j", F.explode(F.sequence(first, F.lit(across - 1))))
    b = right.withColumn("_j", own(across, 1 if half else 2)).withColumn("_i", F.explode(F.sequence(F.lit(0), last)))
    # columns of their own, as the sides may stem from one frame
    a, b = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (a, b))
    # a number of partitions that is asked for isn't reduced for having few bytes
    parts = min(down * across, 64 * cores)
    a, b = (df.repartition(parts, "_i", "_j").groupBy("_i", "_j") for df in (a, b))

    def cell(x: pa.Table, y: pa.Table) -> Iterator[pa.RecordBatch]:
        if not x.num_rows or not y.num_rows:
            return
        more = ((1 if x.column("_i")[0].as_py() == y.column("_j")[0].as_py() else 2),) if half else ()
        x, y = _block(x), _block(y)
        for i in range(0, len(x[0]), size):
            for j in range(0, len(y[0]), wide):
                out = run(_part(x, i, size), _part(y, j, wide), *more)
                if out is not None and out.num_rows:
                    yield out

    names = [f.split()[0] for f in schema.split(",")]

    def added(found: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        one = pa.Table.from_batches(found).group_by([c for c in names if c not in add]).aggregate(list(add.items()))
        plain = {f"{c}_{how}": c for c, how in add.items()}
        return one.rename_columns([plain.get(c, c) for c in one.column_names]).select(names).combine_chunks().to_batches()

    def all_of(x: pa.Table, y: pa.Table) -> pa.Table:
        found: list[pa.RecordBatch] = []
        held = 0
        for out in cell(x, y):
            found.append(out)
            held += out.num_rows
            if add and held > 4 * (x.num_rows + y.num_rows):
                found = added(found)
                held = sum(f.num_rows for f in found)
        return pa.Table.from_batches(found) if found else pa.table({c: pa.array([], t) for c, t in zip(names, _types(schema))})

    return a.cogroup(b).applyInArrow(all_of, schema)


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
    return [kinds[f.split()[1]] for f in schema.split(",")]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, by products of matrices; one that is small beside its
    vectors, where these would cancel, is taken from the differences."""
    middle = (x.mean(axis=0) + y.mean(axis=0)) / 2 if len(x) and len(y) else 0.0
    x, y = x - middle, y - middle
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    d = (-2 * x) @ y.T
    d += xx[:, None]
    d += yy[None, :]
    i, j = np.nonzero(~(d > 1e-6 * (xx.max(initial=0) + yy.max(initial=0))))
    np.maximum(d, 0, out=d)
    step = max(1, (1 << 22) // max(1, x.shape[1]))
    for k in range(0, len(i), step):
        apart = x[i[k : k + step]] - y[j[k : k + step]]
        d[i[k : k + step], j[k : k + step]] = np.einsum("ij,ij->i", apart, apart)
    return d


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean; see squares()."""
    d = squares(x, y)
    return np.sqrt(d, out=d)


def least_of(d: np.ndarray, k: int) -> pa.ListArray:
    """The k least numbers of each row, as lists."""
    k = min(k, d.shape[1])
    least = np.partition(d, k - 1, axis=1)[:, :k]
    return pa.ListArray.from_arrays(np.arange(len(d) + 1, dtype=np.int32) * k, pa.array(least.ravel()))
