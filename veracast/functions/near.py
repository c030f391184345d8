"""Nearest points of few dimensions, exactly, without meeting all pairs.

Space is cut into cells of about equally many target points (cuts come from a
sample, and change nothing but balance). A query's distance to its kth neighbour
in its own cell bounds how far it has to look; it is then sent to the cells that
are as near as that. Within a cell, blocks of queries meet blocks of points in
order of the distance of their boxes, until no nearer one can follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF, BLOCK, FEW = 20_000, 256, 6
SLACK = 1 - 1e-9


def _cuts(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and place of each cut of a balanced tree, from the root."""
    dims, at = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)

    def cut(node: int, x: np.ndarray) -> None:
        if node < len(at) and len(x):
            c = int(np.argmax(np.ptp(x, axis=0)))
            dims[node], at[node] = c, np.median(x[:, c])
            right = x[:, c] >= at[node]
            cut(2 * node + 1, x[~right])
            cut(2 * node + 2, x[right])

    cut(0, x)
    return dims, at


def _cell(x: np.ndarray, dims: np.ndarray, at: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range((len(at) + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] >= at[node])
    return (node - len(at)).astype(np.int32)


def _blocks(x: np.ndarray) -> list[np.ndarray]:
    """Rows in blocks that lie close together, each in the order of x."""
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK:
            done.append(np.sort(rows))
        else:
            own = x[rows]
            order = np.argpartition(own[:, int(np.argmax(np.ptp(own, axis=0)))], len(rows) // 2)
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def least(q: np.ndarray, t: np.ndarray, n: np.ndarray, k: int, over: float = 1, by: float = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of each q the k nearest t: distances sqrt(|q - t|^2 over / by), infinite where
    there are fewer, and their n. Of equal distances the lower n is nearer."""
    order = np.argsort(n, kind="stable")
    t, n = t[order], n[order]
    d_, n_ = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    blocks = _blocks(t) if len(t) else []
    if not blocks or not len(q):
        return d_, n_
    low, high = np.array([t[b].min(axis=0) for b in blocks]), np.array([t[b].max(axis=0) for b in blocks])
    for rows in _blocks(q):
        x = q[rows]
        gap = np.maximum(0, np.maximum(low - x.max(axis=0), x.min(axis=0) - high))
        bound = np.sqrt((gap**2).sum(axis=1) * over / by) * SLACK
        best, whose = d_[rows], n_[rows]
        for b in np.argsort(bound, kind="stable"):
            if bound[b] > best[:, -1].max():
                break
            y, m = t[blocks[b]], n[blocks[b]]
            d = np.zeros((len(x), len(y)))
            for c in range(x.shape[1]):
                d += (x[:, c, None] - y[None, :, c]) ** 2
            d = np.sqrt(d * over / by)
            mine = np.flatnonzero(d.min(axis=1) <= best[:, -1])
            if len(mine):
                near = np.argsort(d[mine], axis=1, kind="stable")[:, :k]
                both = np.concatenate([best[mine], np.take_along_axis(d[mine], near, 1)], axis=1), np.concatenate([whose[mine], m[near]], axis=1)
                first = np.lexsort((both[1], both[0]), axis=1)[:, :k]
                best[mine], whose[mine] = (np.take_along_axis(z, first, 1) for z in both)
        d_[rows], n_[rows] = best, whose
    return d_, n_


def _matrix(column, width: int) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


def nearest(query: DataFrame, target: DataFrame, width: int, k: int, over: float = 1, by: float = 1, leaf: int = LEAF) -> DataFrame:
    """v and near, up to k (d, n) in order, of each of the distinct query points
    (v array<double>); target points are distinct too, (v, n long). Numbers are finite."""
    spark = query.sparkSession
    cores = spark.sparkContext.defaultParallelism
    depth = max(0, (-(-target.count() // leaf) - 1).bit_length())
    some = target.select("v").orderBy(F.xxhash64("v")).limit(min(100_000, 64 << depth)).collect() if depth else []
    dims, at = _cuts(np.array([r.v for r in some]).reshape(-1, width), depth)
    cells = 1 << depth
    parts = min(4 * cells, 16 * cores) if depth else 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("_c", pa.array(_cell(_matrix(batch.column("v"), width), dims, at)))

    query = query.select("v").mapInArrow(place, "v array<double>, _c int")
    target = target.select("v", F.col("n").cast("long").alias("n")).mapInArrow(place, "v array<double>, n long, _c int")
    # columns of their own, as the sides may stem from one frame
    query, target = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (query, target))
    by_cell = lambda df: df.repartition(parts, "_c").groupBy("_c")

    if depth:
        lows, highs = ([f(F.get("v", F.lit(c))).alias(f"{n}{c}") for c in range(width)] for n, f in (("a", F.min), ("b", F.max)))
        boxes = target.groupBy("_c").agg(*lows, *highs).orderBy("_c").collect()  # a row a cell
        low, high = (np.array([[r[f"{n}{c}"] for c in range(width)] for r in boxes]) for n in "ab")
        known = np.array([r["_c"] for r in boxes], np.int32)

        def reach(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows:
                return pa.table({"v": pa.array([], pa.list_(pa.float64())), "r": pa.array([], pa.float64())})
            x = _matrix(a.column("v"), width)
            d, _ = least(x, _matrix(b.column("v"), width), b.column("n").to_numpy(), k, over, by)
            return pa.table({"v": _lists(x), "r": pa.array(d[:, -1])})

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, r = _matrix(batch.column("v"), width), batch.column("r").to_numpy()
                for i in range(0, len(x), 1024):
                    p = x[i : i + 1024]
                    square = np.zeros((len(p), len(low)))
                    for c in range(width):
                        square += np.maximum(0, np.maximum(low[:, c] - p[:, c, None], p[:, c, None] - high[:, c])) ** 2
                    q, to = np.nonzero(np.sqrt(square * over / by) * SLACK <= r[i : i + 1024, None])
                    yield pa.RecordBatch.from_arrays([_lists(p[q]), pa.array(known[to])], ["v", "_c"])

        query = by_cell(query).cogroup(by_cell(target)).applyInArrow(reach, "v array<double>, r double").mapInArrow(send, "v array<double>, _c int")

    def find(a: pa.Table, b: pa.Table) -> pa.Table:
        x = _matrix(a.column("v"), width)
        d, n = least(x, _matrix(b.column("v"), width), b.column("n").to_numpy(), k, over, by)
        q, i = np.nonzero(d < np.inf)
        return pa.table({"v": _lists(x[q]), "d": pa.array(d[q, i]), "n": pa.array(n[q, i])})

    found = by_cell(query).cogroup(by_cell(target)).applyInArrow(find, "v array<double>, d double, n long")
    return found.groupBy("v").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "n"))), 1, k).alias("near"))
