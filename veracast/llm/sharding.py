"""Sharding by fixed virtual slots.

A record's slot is a hash of its id modulo a fixed number of slots and never
changes. Which shard a slot is on is a small table, written under a version;
rebalancing reads the latest version, moves as few bytes as it can off the
overfull shards, and writes the next one, so that records move by slot and a
reader that holds an older version still finds a consistent layout.

Bytes are aggregated by slot with partial sums, so what the driver sees is a
row a slot, whatever the input. Records then find their shard by a lookup in
an array of that length, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows

SLOTS, SHARDS = 4096, 16


def slot_of(id_: Column, text: Column, slots: int) -> Column:
    """By the first 28 bits of the MD5 of the id; of the text where there is no id."""
    key = F.coalesce(id_.cast("string"), F.md5(text), F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long") % slots


def bytes_by_slot(docs: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of text in each slot."""
    rows = Rows(docs)
    sums = rows.df.groupBy(slot_of(rows["doc_id"], rows["text"], slots).alias("slot")).agg(F.sum(F.coalesce(F.octet_length(rows["text"]).cast("long"), F.lit(0))).alias("bytes"))
    out = [0] * slots
    for slot, size in sums.collect():  # a row a slot at most
        out[slot] = size
    return out


def rebalanced(owner: list[int], size: list[int], shards: int, slack: float = 0.02) -> list[int]:
    """owner (shard of each slot) edited until no shard is above its even share
    of bytes by more than slack, or no move helps. Slots on shards that no
    longer exist are placed first, largest first, on the emptiest shard; then
    the fullest shard gives the emptiest its largest slot that makes neither
    worse. Ties go to the lower shard and slot."""
    owner = list(owner)
    load = [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(owner):
        if 0 <= shard < shards:
            load[shard] += size[slot]
            held[shard].add(slot)
        else:
            homeless.append(slot)

    def place(slot: int, shard: int) -> None:
        owner[slot] = shard
        load[shard] += size[slot]
        held[shard].add(slot)

    for slot in sorted(homeless, key=lambda s: (-size[s], s)):
        place(slot, min(range(shards), key=lambda i: (load[i], len(held[i]), i)))
    most = sum(size) / shards * (1 + slack)
    while True:
        full = max(range(shards), key=lambda i: (load[i], -i))
        empty = min(range(shards), key=lambda i: (load[i], i))
        gap = load[full] - load[empty]
        fits = [s for s in held[full] if 0 < size[s] < gap and size[s] <= max(gap // 2, 1)]
        if load[full] <= most or not fits:
            return owner
        slot = max(fits, key=lambda s: (size[s], -s))
        held[full].discard(slot)
        load[full] -= size[slot]
        place(slot, empty)


class SlotMap:
    """The versions of a slot-to-shard map, each a Parquet folder of its own
    below ``path``; a version is never changed once it is written."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path.rstrip("/"), slots

    def versions(self, begun: bool = False) -> list[int]:
        """Those whose write has been committed, or also those that were begun."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(at)]
        return sorted(int(n.removeprefix("version=")) for n, p in names if n.startswith("version=") and (begun or fs.exists(hadoop.Path(p, "_SUCCESS"))))

    def read(self, version: int | None = None) -> list[int]:
        version = self.versions()[-1] if version is None else version
        out = [-1] * self.slots
        for slot, shard in self.spark.read.parquet(f"{self.path}/version={version}").select("slot", "shard").collect():
            out[slot] = shard
        return out

    def write(self, owner: Iterable[int]) -> int:
        """Add a version, one above the last that was begun, and return it. If
        another writer has taken it by then, this one fails."""
        version = max(self.versions(begun=True), default=0) + 1
        rows = self.spark.createDataFrame(list(enumerate(owner)), "slot int, shard int")
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version}")
        return version

    def rebalance(self, size: list[int], shards: int, slack: float = 0.02) -> int:
        """The version that holds these bytes evenly: the latest, if nothing
        has to move, else a new one. Without a version, slots start in turn."""
        versions = self.versions()
        owner = self.read(versions[-1]) if versions else [s % shards for s in range(self.slots)]
        if not versions:
            versions = [self.write(owner)]
        edited = rebalanced(owner, size, shards, slack)
        return versions[-1] if edited == owner else self.write(edited)


def sharded(docs: DataFrame, path: str, slots: int = SLOTS, shards: int = SHARDS, slack: float = 0.02) -> DataFrame:
    """doc_id, slot, shard, map_version and n_bytes of every row of docs, by the map at path.

    A null text has 0 bytes, a very long one as many as it has; a row without a doc_id is placed by its text, and
    one without either goes to the slot of the empty key. Repeated rows have
    one slot; of slots and shards that are equally full the lower goes first. Other columns aren't looked at. An empty table has an empty
    result but writes the first version."""
    kept = SlotMap(docs.sparkSession, path, slots)
    version = kept.rebalance(bytes_by_slot(docs, slots), shards, slack)
    owner = kept.read(version)
    rows = Rows(docs)
    df = rows.df.select(rows["doc_id"].alias("doc_id"), slot_of(rows["doc_id"], rows["text"], slots).alias("slot"), F.coalesce(F.octet_length(rows["text"]).cast("long"), F.lit(0)).alias("n_bytes"))
    shard = F.element_at(F.split(F.lit(",".join(map(str, owner))), ","), (F.col("slot") + 1).cast("int"))
    return df.select("doc_id", "slot", shard.cast("int").alias("shard"), F.lit(version).alias("map_version"), "n_bytes")
