"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its shingles of ``k`` words and is embedded as
COORDINATES minwise values. In each of ``trees`` independent trees a node's
documents branch on a few of the coordinates, chosen by the node's own hash:
a child holds those that agree on the value there. A pair of similarity s
follows a chosen coordinate together with probability s, and 1/threshold
coordinates are chosen, so pairs at the threshold keep one shared path in
expectation while others die out. A small node is compared exhaustively.
Documents much like the rest of a large node, which branching can't part, are
compared with all of it and taken out. Trees are repeated for recall.

In Spark: one pass over the texts gives 128 bytes of sketch a document and its
first-level node keys; from there on no text moves. Exact copies collapse on a
digest of the signature. Nodes are shuffled by key once and read in key order,
so all a task holds is the node at hand; a node beyond ``most_in_task`` rows
is first split by further levels across tasks. The matches, at most one edge a
document and node, are joined to groups by alternating large-star and
small-star steps, every step written to the checkpoint folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, reliable, small
from .words import mix, pieces, shingle_hashes, word_hashes

COORDINATES = 128
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 31, COORDINATES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.int64).astype(np.uint32)
_ODD = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a word, their minwise values as rows of uint32)."""
    words, offset = word_hashes(texts)
    shingles, offset = shingle_hashes(words, offset, k)
    rows = np.flatnonzero(np.diff(offset))
    out = np.empty((len(rows), COORDINATES), np.uint32)
    if len(rows):
        base = (shingles >> np.uint64(32)).astype(np.uint32)
        x = np.empty_like(base)
        y = np.empty_like(base)
        for c in range(COORDINATES):
            np.multiply(base, _A[c], out=x)
            np.bitwise_xor(x, _B[c], out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
            out[:, c] = np.minimum.reduceat(x, offset[rows])
    return rows, out


def _digest(values: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((values.astype(np.uint64) + np.uint64(salt)) * _ODD).sum(axis=1, dtype=np.uint64)


def _chosen(key: int, many: int) -> np.ndarray:
    """The coordinates on which the node of this key branches."""
    return np.random.default_rng(key & ((1 << 63) - 1)).choice(COORDINATES, many, replace=False)


def first_keys(values: np.ndarray, trees: int, many: int) -> np.ndarray:
    """Keys of each row's first-level nodes, (rows, trees * many)."""
    out = []
    for tree in range(trees):
        for c in _chosen(tree + 1, many):
            out.append(mix((values[:, c].astype(np.uint64) << np.uint64(20)) + np.uint64((tree << 8) + int(c))))
    return np.stack(out, axis=1).view(np.int64)


def needed(threshold: float) -> int:
    """Equal bytes of two sketches at this similarity; one in 256 is equal by chance."""
    return math.ceil(COORDINATES * (threshold + (1 - threshold) / 256))


def compare(ids: np.ndarray, sketch: np.ndarray, need: int, active: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges from each member of a group of matching rows to its least id,
    by breadth-first search: what is matched already isn't compared again.
    active: the rows that are compared with all rows; by default all are. A
    row that isn't active may be in the groups of several that are."""
    edges = []
    if active is None:
        active = np.ones(len(ids), bool)
    left = np.arange(len(ids))
    for pivot in np.flatnonzero(active):
        at = np.searchsorted(left, pivot)
        if at == len(left) or left[at] != pivot:
            continue
        left = np.delete(left, at)
        front, group = [pivot], [pivot]
        while front and len(left):
            one = front.pop()
            if not active[one]:
                continue
            equal = np.concatenate([(sketch[part] == sketch[one]).sum(axis=1) for part in np.array_split(left, len(left) // 65536 + 1)]) >= need
            if equal.any():
                more = left[equal].tolist()
                group += more
                front += more
                left = left[~equal]
        passive = [x for x in group if not active[x]]
        if passive:
            left = np.union1d(left, passive)
        if len(group) > 1:
            members = ids[group]
            root = int(members.min())
            edges += [(int(x), root) for x in members if x != root]
    return edges


def join_node(key: int, ids: np.ndarray, sketch: np.ndarray, need: int, many: int, limit: int, threshold: float, depth: int = 0) -> list[tuple[int, int]]:
    """Edges among a node's rows, by further branching if it is large."""
    n = len(ids)
    if n <= limit or depth == 16:
        return compare(ids, sketch, need)
    alike = np.zeros(n)
    for c in range(COORDINATES):
        alike += np.bincount(sketch[:, c], minlength=256)[sketch[:, c]] - 1
    dense = alike / COORDINATES / (n - 1) > 0.5 * threshold
    edges = compare(ids, sketch, need, dense) if dense.any() else []
    ids, sketch = ids[~dense], sketch[~dense]
    for c in _chosen(key, many):
        order = np.argsort(sketch[:, c], kind="stable")
        cuts = np.flatnonzero(np.diff(sketch[order, c].astype(np.int16))) + 1
        for child in np.split(order, cuts):
            if len(child) > 1:
                step = int(mix(np.array([(key ^ (int(c) << 8) ^ int(sketch[child[0], c])) & ((1 << 64) - 1)], np.uint64))[0])
                edges += join_node(step, ids[child], sketch[child], need, many, limit, threshold, depth + 1)
    return edges


def matches(keys: np.ndarray, ids: np.ndarray, sketch: np.ndarray, threshold: float, many: int, limit: int) -> list[tuple[int, int]]:
    """Edges within the nodes of rows in key order."""
    need = needed(threshold)
    cuts = np.flatnonzero(np.diff(keys)) + 1
    start, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    two = start[end - start == 2]
    hit = two[(sketch[two] == sketch[two + 1]).sum(axis=1) >= need]
    a, b = ids[hit], ids[hit + 1]
    found = list(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist()))
    for s, e in zip(start[end - start > 2], end[end - start > 2]):
        found += join_node(int(keys[s]), ids[s:e], sketch[s:e], need, many, limit, threshold)
    return found


def groups(texts: list[pa.Array], threshold: float = 0.5, k: int = 3, trees: int = 5, limit: int = 400) -> np.ndarray:
    """The least row of each row's group, for texts that fit into memory."""
    many, root, done = math.ceil(1 / threshold), [], 0
    rows, values = [], []
    for part in texts:
        at, value = signatures(part, k)
        rows.append(at + done)
        values.append(value)
        done += len(part)
    root = np.arange(done)
    if not done or not sum(map(len, rows)):
        return root
    ids, value = np.concatenate(rows), np.concatenate(values)
    keys = first_keys(value, trees, many)
    sketch = value.astype(np.uint8)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for c in range(keys.shape[1]):
        order = np.argsort(keys[:, c], kind="stable")
        for u, v in matches(keys[order, c], ids[order], sketch[order], threshold, many, limit):
            a, b = top(u), top(v)
            root[max(a, b)] = min(a, b)
    return np.array([top(x) for x in range(done)])


def _edges(threshold: float, many: int, limit: int):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in key order; the last node of a batch waits for the next."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            found = [(a, b) for a, b in set(matches(*(np.concatenate(x) for x in zip(*parts)), threshold, many, limit)) if a != b]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            sketch = _sketches(batch.column("sketch"))
            last = int(np.searchsorted(keys, keys[-1]))
            if last or held and held[-1][0][-1] != keys[0]:
                yield out([*held, (keys[:last], ids[:last], sketch[:last])])
                held = []
            held.append((keys[last:].copy(), ids[last:].copy(), sketch[last:].copy()))
        if held:
            yield out(held)

    return edges


def _sketches(data: pa.Array) -> np.ndarray:
    sketch = np.frombuffer(data.buffers()[2], np.uint8)
    return sketch[: (data.offset + len(data)) * COORDINATES].reshape(-1, COORDINATES)[data.offset :]


def _split(nodes: DataFrame, big: DataFrame, threshold: float, many: int, most: int = 50_000) -> tuple[list[DataFrame], DataFrame]:
    """(edges, children's rows) of one level for nodes too large for a task.
    Rows like the node's pivot (its least id) are of its group and go no
    further, after they were compared with the node's other rows; these go to
    the node's children.

    Unequal bytes are a metric, so a row at distance d of the pivot needs
    comparing only with those at most d + the largest distance of a match from
    it. ``most`` bounds the rows of either side that a task compares."""
    need = needed(threshold)
    reach = COORDINATES - need
    rows = nodes.join(big, "key")
    pivots = reliable(rows.groupBy("key").agg(F.min_by("sketch", "id").alias("pivot"), F.min("id").alias("first")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = (_sketches(batch.column("sketch")) != _sketches(batch.column("pivot"))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "sketch", "first")), pa.array(far, pa.int64())], ["key", "id", "sketch", "first", "far"])

    marked = reliable(rows.join(small(pivots, 100_000), "key").select("key", "id", "sketch", "first", "pivot").mapInArrow(measure, "key long, id long, sketch binary, first long, far long"))
    like = F.col("far") <= reach

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, sketch = batch.column("key").to_numpy(), batch.column("id").to_numpy(), _sketches(batch.column("sketch"))
            for one in np.unique(key):  # as many as there are nodes beyond a task's bound
                at = np.flatnonzero(key == one)
                for c in _chosen(int(one), many):
                    step = mix(one.astype(np.uint64) ^ (np.uint64(int(c)) << np.uint64(8)) ^ sketch[at, c].astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(step.view(np.int64)), pa.array(ids[at]), batch.column("sketch").take(pa.array(at))], ["key", "id", "sketch"])

    def cross(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            names = ["key", "l", "r", "id", "sketch", "first", "far"]
            a, b = (t.rename_columns(names).sort_by("far").combine_chunks() for t in (left, right))
            a_far, b_far = a["far"].to_numpy(), b["far"].to_numpy()
            a_sketch, b_sketch = (_sketches(t["sketch"].combine_chunks()) for t in (a, b))
            a_first, b_id, rest = a["first"].to_numpy(), b["id"].to_numpy(), np.arange(b.num_rows)
            for i in range(a.num_rows - 1, -1, -1):
                n = int(np.searchsorted(b_far[rest], a_far[i] + reach, side="right"))
                if not n:
                    break  # the next ones are nearer to the pivot still
                hit = (b_sketch[rest[:n]] == a_sketch[i]).sum(axis=1) >= need
                if hit.any():
                    found.append((b_id[rest[:n][hit]], np.full(int(hit.sum()), a_first[i])))
                    rest = np.concatenate([rest[:n][~hit], rest[n:]])
        u, v = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    widest = marked.where(like).groupBy("key").agg(F.max("far").alias("widest"))
    asked = marked.join(small(reliable(widest), 100_000), "key").where(F.col("far") <= reach + F.col("widest")).drop("widest")
    cells = reliable(asked.groupBy("key").agg(*(F.greatest(F.lit(1), F.ceil(F.sum(side.cast("long")) / most)).alias(n) for n, side in (("ln", like), ("rn", ~like)))))
    asked = asked.join(small(cells, 100_000), "key")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("long")
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    left = asked.where(like).withColumn("l", own("ln")).withColumn("r", all_("rn"))
    right = asked.where(~like).withColumn("l", all_("ln")).withColumn("r", own("rn"))
    sides = [df.select("key", "l", "r", "id", "sketch", "first", "far") for df in (left, right)]
    sides = [df.toDF(*(f"{c}{k}" for c in df.columns)).groupBy(f"key{k}", f"l{k}", f"r{k}") for k, df in enumerate(sides)]
    crossed = sides[0].cogroup(sides[1]).applyInArrow(cross, "u long, v long")
    edges = [marked.where(like & (F.col("id") != F.col("first"))).select(F.col("id").alias("u"), F.col("first").alias("v")), crossed]
    return edges, reliable(marked.where(~like).select("key", "id", "sketch").mapInArrow(descend, "key long, id long, sketch binary"))


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the least vertex of u's connected component, u another."""
    edges = reliable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return edges
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        star = lower.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        edges = reliable(star.distinct())


def duplicates(docs: DataFrame, threshold: float = 0.5, k: int = 3, trees: int = 5, limit: int = 400, most_in_task: int = 200_000) -> DataFrame:
    """(doc_id, kept_doc_id) of every document that another one replaces: the
    least doc_id of its group, a connected component of pairs whose estimated
    similarity reaches the threshold.

    Texts that are null, empty or without words, and rows with a null doc_id,
    are in no group. A text of fewer than k words is one shingle, so it matches
    only its copies; a very long text is sketched whole. Rows of one doc_id are one document; ties can't occur, as
    the least id is kept. Other columns aren't looked at. An empty table gives
    an empty result. Similarity is estimated from sketches and not confirmed on
    the shingles, so near the threshold pairs are missed, and some just under
    it are taken: at 0.5, recall is 0.64 for pairs of 0.50-0.55, 0.94 for
    0.55-0.60 and above 0.99 beyond, and of pairs of 0.45-0.50 0.27 are taken."""
    many = math.ceil(1 / threshold)
    rows = Rows(docs)
    asked = rows.df.select(rows["doc_id"].cast("long").alias("id"), rows["text"].alias("text")).where("id is not null and text is not null")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                at, values = signatures(part.column("text"), k)
                keys = first_keys(values, trees, many)
                digest = np.stack([_digest(values, 1), _digest(values, 2)], axis=1)
                sketch = values.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(at)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(at), [None, pa.py_buffer(np.ascontiguousarray(digest))]).cast(pa.binary()), pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * keys.shape[1], pa.array(keys.ravel())), pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), len(at), [None, pa.py_buffer(np.ascontiguousarray(sketch))]).cast(pa.binary())],
                    ["id", "digest", "keys", "sketch"],
                )

    signed = asked.mapInArrow(sign, "id long, digest binary, keys array<long>, sketch binary")
    signed = reliable(signed.withColumn("rep", F.min("id").over(Window.partitionBy("digest"))).drop("digest"))
    nodes = signed.where("id = rep").select(F.explode("keys").alias("key"), "id", "sketch")
    edges, done = [], []
    for _ in range(16):
        big = reliable(nodes.groupBy("key").count().where(F.col("count") > most_in_task).select("key"))
        if big.isEmpty():
            break
        big = small(big, 100_000)
        found, children = _split(nodes, big, threshold, many)
        edges += found
        done.append(nodes.join(big, "key", "left_anti"))
        nodes = children
    for part in [*done, nodes]:
        ordered = part.repartition("key").sortWithinPartitions("key")
        edges.append(ordered.mapInArrow(_edges(threshold, many, limit), "u long, v long"))
    found = edges[0]
    for more in edges[1:]:
        found = found.unionByName(more)
    # an id whose rows differ may stand in several digests
    own = signed.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    multiple = signed.select("id", "rep").distinct().groupBy("id").count().where("count > 1").isEmpty()
    if not multiple:
        return components(found.unionByName(own)).select(F.col("u").alias("doc_id"), F.col("v").alias("kept_doc_id"))
    root = components(found)
    near = signed.select("id", "rep").join(root, F.col("rep") == F.col("u"), "left").select("id", F.coalesce("v", "rep").alias("kept"))
    return near.where("id <> kept").distinct().select(F.col("id").alias("doc_id"), F.col("kept").alias("kept_doc_id"))


def keep_one(docs: DataFrame, threshold: float = 0.5, k: int = 3, trees: int = 5) -> DataFrame:
    """docs with one document of each group of duplicates(), all its columns.

    Of several rows with one doc_id that have words, the one of least text
    hash stays. Rows without a doc_id or without words all stay. Very long texts,
    ties and other columns are as in duplicates(); an empty table stays empty."""
    gone = reliable(duplicates(docs, threshold, k, trees).select(F.col("doc_id").alias("_gone")))
    rows = Rows(docs)
    id_, text = rows["doc_id"].cast("long"), rows["text"]
    kept = rows.df.join(gone.hint("shuffle_hash"), id_ == F.col("_gone"), "left_anti")
    repeated = reliable(rows.df.where(id_.isNotNull()).groupBy(id_.alias("_again")).count().where("count > 1").select("_again"))
    if repeated.isEmpty():
        return rows.give(kept)
    many = kept.join(repeated, id_ == F.col("_again"), "left_semi")
    has_words = F.coalesce(text.rlike("[0-9A-Za-z]|[^\\x00-\\x7f]"), F.lit(False))
    first = many.where(has_words).withColumn("_n", F.row_number().over(Window.partitionBy(id_).orderBy(F.xxhash64(text), text))).where("_n = 1")
    parts = [kept.join(repeated, id_ == F.col("_again"), "left_anti"), first, many.where(~has_words)]
    return rows.give(reduce(DataFrame.union, (part.select(*rows.own) for part in parts)))
