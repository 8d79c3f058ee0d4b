"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots. The bytes of each slot are summed, and a
slot-to-shard map, stored as a table with one version per edit, places whole slots into shards.
Rebalancing or adding a shard edits the map and never the hash, so only the rows of the moved slots
change their place. Only the map (one row per slot, a fixed number) passes through the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, new_path, utf8

N_SLOTS = 8192
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] and bytes_of[slot]; version grows by one with each edit."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    bytes_of: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for shard, size in zip(self.shard_of, self.bytes_of):
            out[shard] += size
        return out


def first_map(bytes_of: Sequence[int], n_shards: int) -> SlotMap:
    """Largest slot first, each to the shard with the least bytes (ties: the lower number)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    heap = [(0, s) for s in range(n_shards)]
    shard_of = [0] * len(bytes_of)
    for slot in sorted(range(len(bytes_of)), key=lambda i: (-bytes_of[i], i)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + bytes_of[slot], shard))
    return SlotMap(1, n_shards, tuple(shard_of), tuple(bytes_of))


def grown(m: SlotMap, n_more: int = 1) -> SlotMap:
    """Adds shards. Slots move only into the new ones, each time from the fullest shard, until those have their share."""
    n = m.n_shards + n_more
    share = sum(m.bytes_of) / n
    shard_of, loads = list(m.shard_of), m.loads() + [0] * n_more
    own: dict[int, list[int]] = {s: [] for s in range(m.n_shards)}
    for slot in sorted(range(len(shard_of)), key=lambda i: (m.bytes_of[i], i)):
        own[shard_of[slot]].append(slot)
    for new in range(m.n_shards, n):
        while donors := [s for s in range(m.n_shards) if own[s] and loads[s] > share]:
            donor = max(donors, key=lambda s: (loads[s], -s))
            slot = own[donor].pop()
            size = m.bytes_of[slot]
            if loads[new] + size > share + size / 2:
                break
            shard_of[slot] = new
            loads[donor] -= size
            loads[new] += size
    return SlotMap(m.version + 1, n, tuple(shard_of), m.bytes_of)


def shrunk(m: SlotMap, n_shards: int) -> SlotMap:
    """Keeps the first n_shards shards. The slots of the others go, largest first, each to the shard with the least bytes."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    shard_of, loads = list(m.shard_of), m.loads()[:n_shards]
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    for slot in sorted((i for i, s in enumerate(shard_of) if s >= n_shards), key=lambda i: (-m.bytes_of[i], i)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + m.bytes_of[slot], shard))
    return SlotMap(m.version + 1, n_shards, tuple(shard_of), m.bytes_of)


def rebalanced(m: SlotMap, bytes_of: Sequence[int], tolerance: float = 0.01) -> SlotMap:
    """Edits the map for new sizes: slots move from the fullest to the emptiest shard while a move narrows their gap
    and the fullest is more than tolerance above the mean. The other slots stay."""
    m = replace(m, bytes_of=tuple(bytes_of))
    shard_of, loads = list(m.shard_of), m.loads()
    mean = sum(loads) / len(loads)
    own: dict[int, set[int]] = {s: set() for s in range(m.n_shards)}
    for slot, shard in enumerate(shard_of):
        own[shard].add(slot)
    while True:
        full, empty = max(range(m.n_shards), key=lambda s: (loads[s], -s)), min(range(m.n_shards), key=lambda s: (loads[s], s))
        gap = loads[full] - loads[empty]
        fits = [s for s in own[full] if 0 < bytes_of[s] < gap]
        if loads[full] <= mean * (1 + tolerance) or not fits:
            break
        slot = min(fits, key=lambda s: (abs(gap / 2 - bytes_of[s]), s))
        own[full].remove(slot)
        own[empty].add(slot)
        shard_of[slot] = empty
        loads[full] -= bytes_of[slot]
        loads[empty] += bytes_of[slot]
    return replace(m, version=m.version + 1, shard_of=tuple(shard_of))


def store_map(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Adds the map's version to the table at path; versions written before stay."""
    rows = [(slot, shard, size, m.n_shards) for slot, (shard, size) in enumerate(zip(m.shard_of, m.bytes_of))]
    spark.createDataFrame(rows, "virtual_slot int, shard int, slot_bytes long, n_shards int").coalesce(1).write.parquet(f"{path}/version={m.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The stored map of a version, by default the newest."""
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.where(F.col("version") == version).orderBy("virtual_slot").collect()
    return SlotMap(version, rows[0].n_shards, tuple(r.shard for r in rows), tuple(r.slot_bytes for r in rows))


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """key, size (UTF-8 bytes and OVERHEAD), text_crc32, virtual_slot. The slot depends on key and text alone.
    Null keys and null texts are hashed like values; a null text counts as empty, of size OVERHEAD."""
    body = utf8(F.col(text))
    crc = F.crc32(body)
    return docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(key), crc), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def shard(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Places every row of docs into a shard; shards get nearly equal bytes.

    Returns key, size, text_crc32, virtual_slot, shard, slot (the row's place in its shard, gapless from 0, by
    virtual slot and key), map_version. map_path: where the versions of the map are kept. If versions are there,
    the newest is edited for the sizes of docs: more shards take slots from all others, fewer shards take those of the
    ones that go, as many are rebalanced; else a first map is made. A stored map of another number of slots raises
    ValueError. An empty table gives no rows; very long texts count whole. Repeated rows are rows of their own and share a slot. Columns of docs other than key and text
    are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = materialize(hashed(docs, key, text, n_slots), "shard-rows")
    per_slot = {r.virtual_slot: r for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    sizes = [per_slot[s].b if s in per_slot else 0 for s in range(n_slots)]
    path = map_path or new_path(spark, "slot-map")
    try:
        old = load_map(spark, path) if map_path else None
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None and len(old.shard_of) != n_slots:
        raise ValueError(f"the map at {path} has {len(old.shard_of)} slots, not {n_slots}")
    if old is None:
        m = first_map(sizes, n_shards)
    elif n_shards < old.n_shards:
        m = shrunk(replace(old, bytes_of=tuple(sizes)), n_shards)
    elif n_shards > old.n_shards:
        m = grown(replace(old, bytes_of=tuple(sizes)), n_shards - old.n_shards)
    else:
        m = rebalanced(old, sizes)
    store_map(spark, m, path)
    first, places = [0] * m.n_shards, []
    for s in range(n_slots):
        places.append((s, m.shard_of[s], first[m.shard_of[s]]))
        first[m.shard_of[s]] += per_slot[s].n if s in per_slot else 0
    placed = spark.createDataFrame(places, "virtual_slot int, shard int, first long")  # one row per virtual slot
    nth = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("key", "text_crc32", "size"))
    return (
        rows.withColumn("nth", nth)
        .join(F.broadcast(placed), "virtual_slot")
        .select("key", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(m.version).alias("map_version"))
    )
