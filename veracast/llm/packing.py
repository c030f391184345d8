"""Packing documents into windows by minimum bin slack.

A document of n tokens fills n // capacity windows by itself; what remains is
packed with other remainders. All that packing needs to know is how many
remainders there are of each length: at most ``capacity`` numbers, however
many documents. The driver takes the longest remaining length, finds by a
bitset subset-sum over the remaining multiset the sum closest to what is left
of the window, reads the counts back, and repeats the pattern as often as the
multiset allows. One pattern thus stands for any number of windows, and there
are about as many patterns as lengths.

A remainder's place follows from its rank among those of its length: ranks are
counted in buckets by a hash of doc_id (so that a common length isn't one
task's work), and a sorted list of rank ranges gives pattern, window and
offset. Windows that a document fills by itself aren't ranked: each document
has a run of numbers, by sums of how many windows it fills. Rows of one id and
length are one row with their number. Only ids and lengths are shuffled, never
a text, and what reaches the driver is a row a length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, reliable
from .mixing import _each, bucket

CAPACITY = 2048
BUCKETS = 4096


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset within counts (length: how many) whose sum is closest to
    room without exceeding it, as length: how many."""
    steps: list[tuple[int, int, int]] = []  # (length, how many at once, sums reachable before)
    reach, within = 1, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, some = min(counts[length], room // length), 1
        while left > 0:
            take = min(some, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & within
            left -= take
            some *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= length * take
    return out


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(length: how many, windows filled like this), until counts is used up."""
    counts = {k: v for k, v in counts.items() if v > 0}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = fullest(counts, capacity - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((chosen, times))
    return out


def _ranges(found: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """By length and first rank: how many a window, first window, first offset."""
    rows, used, window = [], {}, 0
    for chosen, times in found:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.append((length, used.get(length, 0), n, window, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        window += times
    rows.sort()
    length, rank, n, first, offset = np.array(rows, np.int64).reshape(-1, 5).T
    return {"key": (length << 40) + rank, "rank": rank, "n": n, "window": first, "offset": offset}


def packed(docs: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, piece, start, n_tokens, window and offset of every piece of docs.

    Tokens are runs of characters other than white space; ``start`` and
    ``offset`` count them from the start of the document and of the window.
    Texts that are null or have no token take no window and aren't in the
    result; a very long text fills windows by itself, but for its last piece. A
    null doc_id is carried along, and repeated rows are packed one by
    one. Documents of equal length go by bucket, then id. Other columns aren't
    looked at; an empty table gives an empty result."""
    rows = Rows(docs)
    tokens = F.coalesce(F.regexp_count(rows["text"], F.lit(r"\S+")), F.lit(0)).cast("long")
    sized = rows.df.select(rows["doc_id"].alias("doc_id"), tokens.alias("tokens"), bucket(rows["doc_id"], rows["text"], buckets).alias("bucket")).where("tokens > 0")
    sized = reliable(sized.groupBy("bucket", "doc_id", "tokens").agg(F.count(F.lit(1)).alias("n")))
    sized = sized.select("*", F.expr(f"tokens div {capacity}").alias("whole"), F.expr(f"tokens % {capacity}").alias("rest"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    until = lambda what, *by: F.coalesce(F.sum(what).over(before.partitionBy(*by[:-1]).orderBy(*by[-1])), F.lit(0))
    held = reliable(sized.where("rest > 0").groupBy("rest", "bucket").agg(F.sum("n").alias("n")))
    counts = {rest: n for rest, n in held.groupBy("rest").agg(F.sum("n")).collect()}  # a row a length: fewer than capacity
    found = patterns(counts, capacity)
    plan = docs.sparkSession.sparkContext.broadcast(_ranges(found))
    # a row a bucket
    wholes = sized.groupBy("bucket").agg(F.sum(F.col("n") * F.col("whole")).alias("n"))
    wholes = wholes.select(F.col("bucket").alias("b"), (until("n", ["bucket"]) + sum(times for _, times in found)).alias("window"))
    ranks = held.select(F.col("rest").alias("r"), F.col("bucket").alias("b"), until("n", "rest", ["bucket"]).alias("first"))
    order = ["doc_id", "tokens"]
    placed = sized.select("*", until(F.col("n") * F.col("whole"), "bucket", order).alias("window_in"), until("n", "bucket", "rest", order).alias("rank_in"))
    placed = placed.join(F.broadcast(wholes), F.col("bucket") == wholes["b"]).join(ranks, (F.col("bucket") == ranks["b"]) & (F.col("rest") == F.col("r")), "left")
    placed = placed.select("doc_id", "tokens", "whole", F.col("n").alias("_copies"), (F.col("window") + F.col("window_in")).alias("window"), (F.coalesce("first", F.lit(0)) + F.col("rank_in")).alias("rank"))
    each = _each(placed).select(F.col("doc_id").cast("long").alias("doc_id"), "tokens", (F.col("window") + F.col("_at") * F.col("whole")).alias("window"), (F.col("rank") + F.col("_at")).alias("rank"), F.explode(F.expr(f"sequence(0L, (tokens - 1) div {capacity})")).alias("piece"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = plan.value
        for batch in batches:
            tokens, window, rank, piece = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tokens", "window", "rank", "piece"))
            start, offset, window = piece * capacity, np.zeros(len(piece), np.int64), window + piece
            length = np.minimum(tokens - start, capacity)
            rest = np.flatnonzero(length < capacity)
            if len(rest):
                rank, size = rank[rest], length[rest]
                at = np.searchsorted(ranges["key"], (size << 40) + rank, side="right") - 1
                turn = rank - ranges["rank"][at]
                window[rest] = ranges["window"][at] + turn // ranges["n"][at]
                offset[rest] = ranges["offset"][at] + turn % ranges["n"][at] * size
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("piece"), *(pa.array(x, pa.int64()) for x in (start, length, window, offset))], ["doc_id", "piece", "start", "n_tokens", "window", "offset"])

    return each.mapInArrow(place, "doc_id long, piece long, start long, n_tokens long, window long, offset long")
