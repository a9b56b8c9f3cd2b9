"""Sharding by fixed virtual slots.

Rows are hashed into a fixed number of virtual slots. Bytes and rows are summed per slot, and a versioned map sends each slot to a
shard. Rebalancing or adding shards edits the map, so rows move slot by slot. The map and the sums have as many rows as there are
virtual slots whatever the input, so both are handled on the driver and the map is broadcast.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postingflow.llm.common import table
from postingflow.session import cut_lineage, shared_folder

SLOTS = 4096
OVERHEAD = 8
SLACK = 0.0005
MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_bytes long, slot_rows long"


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map: shard, bytes and rows of each virtual slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    slot_bytes: tuple[int, ...]
    slot_rows: tuple[int, ...]

    def loads(self) -> list[int]:
        """Bytes of each shard."""
        out = [0] * self.shards
        for shard, size in zip(self.shard_of, self.slot_bytes):
            out[shard] += size
        return out


def measured_rows(docs: DataFrame, block: int = 4096) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32 (a null text counts as empty) and virtual_slot of every row.

    The slot is a hash of id, checksum, size and, of rows alike in all three, the number of the copy: rows without an id or with one
    that repeats are spread like others. Copies are counted before they are numbered, and a large group is numbered in blocks, each in
    a task of its own.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    alike = ["doc_id", "size", "text_crc32"]
    rows = docs.select("doc_id", (F.length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    counted = rows.groupBy(*alike).agg(F.count(F.lit(1)).alias("_n"))
    blocks = counted.select(*alike, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(block).cast("long"))).alias("_from"))
    spread = blocks.repartition(*alike, "_from")
    each = spread.select(*alike, F.explode(F.sequence("_from", F.least(F.col("_from") + block, "_n") - 1)).alias("_copy"))
    key = F.xxhash64(*alike, F.col("_copy"))
    return each.select(*alike, F.pmod(key, F.lit(SLOTS)).cast("int").alias("virtual_slot"))


def slot_sums(rows: DataFrame) -> tuple[list[int], list[int]]:
    """Bytes and rows per virtual slot: at most SLOTS rows reach the driver."""
    size, count = [0] * SLOTS, [0] * SLOTS
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        size[r.virtual_slot], count[r.virtual_slot] = r.b, r.n
    return size, count


def first_map(slot_bytes: list[int], slot_rows: list[int], shards: int) -> SlotMap:
    """Version 1: the largest slot left goes to the shard with the fewest bytes, ties to the smaller numbers."""
    heap = [(0, s) for s in range(shards)]
    shard_of = [0] * len(slot_bytes)
    for slot in sorted(range(len(slot_bytes)), key=lambda i: (-slot_bytes[i], i)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + slot_bytes[slot], shard))
    return SlotMap(1, shards, tuple(shard_of), tuple(slot_bytes), tuple(slot_rows))


def rebalance(old: SlotMap, slot_bytes: list[int], slot_rows: list[int], shards: int | None = None, slack: float = 0.02) -> SlotMap:
    """The next version for new sums and, if given, more shards: slots leave shards above the mean, the others stay where they are.

    A slot moves from the fullest shard to the emptiest one while that lowers the larger of the two; it ends when the fullest is
    within ``slack`` of the mean or no move helps. With more shards, slots move into the new shards only.
    """
    shards = shards or old.shards
    if shards < old.shards:
        raise ValueError("shards can be added, not removed")
    shard_of, loads = list(old.shard_of), [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        loads[shard] += slot_bytes[slot]
        held[shard].append(slot)
    mean = sum(loads) / shards
    takers = range(old.shards, shards) if shards > old.shards else range(shards)
    while max(loads) > mean * (1 + slack):
        full, empty = loads.index(max(loads)), min(takers, key=lambda s: (loads[s], s))
        gap = (loads[full] - loads[empty]) / 2
        movable = [s for s in held[full] if 0 < slot_bytes[s] < 2 * gap]
        if not movable:
            break
        slot = min(movable, key=lambda s: (abs(slot_bytes[s] - gap), s))
        held[full].remove(slot)
        held[empty].append(slot)
        shard_of[slot] = empty
        loads[full] -= slot_bytes[slot]
        loads[empty] += slot_bytes[slot]
    return SlotMap(old.version + 1, shards, tuple(shard_of), tuple(slot_bytes), tuple(slot_rows))


def map_frame(spark: SparkSession, m: SlotMap) -> DataFrame:
    """The map as a table of SLOTS rows."""
    return spark.createDataFrame([(m.version, i, *x) for i, x in enumerate(zip(m.shard_of, m.slot_bytes, m.slot_rows))], MAP_SCHEMA)


def store_map(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Add one version to the stored map. A version that is there already raises, so of two editors of one version the second has to load again."""
    map_frame(spark, m).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={m.version}")


def load_map(spark: SparkSession, path: str, shards: int, version: int) -> SlotMap:
    """One stored version."""
    rows = spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}").orderBy("virtual_slot").collect()
    return SlotMap(version, shards, *(tuple(r[c] for r in rows) for c in ("shard", "slot_bytes", "slot_rows")))


def place(rows: DataFrame, m: SlotMap) -> DataFrame:
    """Add shard and slot: the row's place in its shard, gapless from 0, by virtual slot, then id, then checksum.

    A window orders one virtual slot at a time; where a slot starts in its shard follows from the row counts in the map.
    """
    used: dict[int, int] = {}
    starts = []
    for i, (shard, n) in enumerate(zip(m.shard_of, m.slot_rows)):
        starts.append((i, shard, used.get(shard, 0)))
        used[shard] = used.get(shard, 0) + n
    starts_frame = rows.sparkSession.createDataFrame(starts, "virtual_slot int, shard int, _start long")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("_at", F.row_number().over(inside) - 1)
            .join(F.broadcast(starts_frame), "virtual_slot")  # SLOTS rows, whatever the input
            .withColumn("slot", F.col("_start") + F.col("_at"))
            .drop("_start", "_at"))


def shard_documents(docs: DataFrame, shards: int = 24, store: str | None = None) -> DataFrame:
    """Every row of ``docs`` with its shard under the ``bytes`` law: shards have nearly equal bytes.

    Null texts have no bytes; rows without an id and repeated rows are spread like others and get places of their own; an empty table
    gives an empty result. Only doc_id and text are read, so further columns don't matter. A row larger than a shard's share makes
    its shard larger. Version 1 of the map, from the bytes per slot, is written to ``store`` (a new folder under the shared one unless
    given), read again and rebalanced; rows are placed by the edited version 2.
    """
    spark = docs.sparkSession
    store = store or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = cut_lineage(measured_rows(docs))
    sums = slot_sums(rows)
    store_map(spark, first_map(*sums, shards), store)
    store_map(spark, rebalance(load_map(spark, store, shards, 1), *sums, slack=SLACK), store)
    m = load_map(spark, store, shards, 2)
    return place(rows, m).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(m.version).alias("map_version"))


def op3_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in shards 0 to 23."""
    return shard_documents(table(spark, folder, "documents"))


QUERIES = {"op3_virtual_slots": (op3_virtual_slots, None)}
