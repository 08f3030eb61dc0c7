"""Shards of near equal bytes through fixed virtual slots and a stored, versioned slot map."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollcall.llm.common import others, quoted, shared_dir

SLOTS = 4096
FRESH = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
_MAP_SCHEMA = "version int, slot int, shard int, rows bigint, bytes bigint, start bigint"


@dataclass(frozen=True)
class SlotMap:
    """Which shard each virtual slot is in. ``loads`` are (rows, bytes) per slot."""

    version: int
    shards: tuple[int, ...]
    loads: tuple[tuple[int, int], ...]

    def shard_bytes(self, count: int) -> list[int]:
        out = [0] * count
        for shard, (_, size) in zip(self.shards, self.loads, strict=True):
            out[shard] += size
        return out

    def rows(self) -> list[tuple]:
        """Rows of the stored table; ``start`` is the place of the slot's first row within its shard."""
        filled, out = {}, []
        for slot, (shard, (rows, size)) in enumerate(zip(self.shards, self.loads, strict=True)):
            out.append((self.version, slot, shard, rows, size, filled.get(shard, 0)))
            filled[shard] = filled.get(shard, 0) + rows
        return out

    def write(self, spark: SparkSession, path: str) -> None:
        """Store this version in its own folder under ``path``; a version that is there already is an error."""
        spark.createDataFrame(self.rows(), _MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/v{self.version}")

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """The versions under ``path`` whose write was completed."""
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        there = [entry.getPath() for entry in files.listStatus(root)]
        done = [p.getName() for p in there if files.exists(root.suffix(f"/{p.getName()}/_SUCCESS"))]
        return sorted(int(name[1:]) for name in done if name[1:].isdigit())

    @staticmethod
    def read(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given or else the latest version of a stored map."""
        version = SlotMap.versions(spark, path)[-1] if version is None else version
        rows = sorted(spark.read.schema(_MAP_SCHEMA).parquet(f"{path}/v{version}").collect(), key=lambda r: r.slot)
        return SlotMap(version, tuple(r.shard for r in rows), tuple((r.rows, r.bytes) for r in rows))


def document_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def virtual_slot(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The fixed slot of a record: by its doc_id, or by its text if it has none."""
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.when(doc_id.isNull(), text)), F.lit(slots)).cast("int")


def slot_loads(docs: DataFrame, slots: int = SLOTS) -> tuple[tuple[int, int], ...]:
    """Rows and bytes of each slot; as many numbers as there are slots, however many documents there are."""
    slot = virtual_slot(F.col("doc_id"), F.col("text"), slots)
    found = docs.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("rows"), F.sum(document_size(F.col("text"))).alias("bytes"))
    loads = [(0, 0)] * slots
    for row in found.collect():
        loads[row.slot] = (row.rows, row.bytes)
    return tuple(loads)


def plan_slots(loads, shards: int, version: int = 1) -> SlotMap:
    """Deal slots to shards, the largest first, each to the shard with the fewest bytes."""
    heap = [(0, shard) for shard in range(shards)]
    dealt = [0] * len(loads)
    for slot in sorted(range(len(loads)), key=lambda s: (-loads[s][1], s)):
        size, shard = heapq.heappop(heap)
        dealt[slot] = shard
        heapq.heappush(heap, (size + loads[slot][1], shard))
    return SlotMap(version, tuple(dealt), tuple(loads))


def rebalance(old: SlotMap, loads, shards: int) -> SlotMap:
    """Edit a map for new loads or another number of shards, moving few bytes.

    Slots of shards that are gone move; then, while it brings the shards closer,
    the slot that best halves the gap moves from the fullest to the emptiest.
    """
    dealt = list(old.shards)
    used = [0] * shards
    homeless = []
    for slot, shard in enumerate(dealt):
        if shard < shards:
            used[shard] += loads[slot][1]
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-loads[s][1], s)):
        dealt[slot] = min(range(shards), key=lambda s: (used[s], s))
        used[dealt[slot]] += loads[slot][1]
    own = [[slot for slot in range(len(dealt)) if dealt[slot] == shard] for shard in range(shards)]
    for _ in range(len(dealt)):
        full, empty = max(range(shards), key=lambda s: (used[s], -s)), min(range(shards), key=lambda s: (used[s], s))
        gap = used[full] - used[empty]
        fit = [slot for slot in own[full] if 0 < loads[slot][1] < gap]
        if not fit:
            break
        slot = min(fit, key=lambda s: (abs(2 * loads[s][1] - gap), s))
        own[full].remove(slot)
        own[empty].append(slot)
        dealt[slot] = empty
        used[full] -= loads[slot][1]
        used[empty] += loads[slot][1]
    return SlotMap(old.version + 1, tuple(dealt), tuple(loads))


def map_path(spark: SparkSession, folder: str, name: str) -> str:
    """Where the map of a table is kept: one stable path for each folder of tables and name."""
    return f"{shared_dir(spark)}/slot-maps/{re.sub('[^A-Za-z0-9.]+', '-', folder).strip('-')}/{name}"


def current_map(spark: SparkSession, loads, shards: int, path: str | None) -> SlotMap:
    """The map to use: the latest one stored under ``path``, edited and stored as a new version if loads or shards have changed."""
    if path is None:
        return plan_slots(loads, shards)
    if not SlotMap.versions(spark, path):
        found = plan_slots(loads, shards)
    else:
        found = SlotMap.read(spark, path)
        if found.loads == loads and max(found.shards) < shards <= 1 + max(found.shards):
            return found
        if len(found.loads) != len(loads):
            raise ValueError(f"the map in {path} has {len(found.loads)} slots, not {len(loads)}: slots are fixed")
        found = rebalance(found, loads, shards)
    found.write(spark, path)
    return found


def assign_shards(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """``docs`` plus ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``, one row per row.

    The law is ``bytes``: the shards' sizes are near equal. ``slot`` is the
    row's place within its shard, from 0 without gaps; ``grown_shard`` is null
    under this law. The slot map is the latest one stored under ``path``; if the
    loads of the slots or the number of shards have changed, it is edited and
    stored as the next version. Without ``path`` a map is planned for this call.

    A null text has size 1 and the checksum of no bytes. Rows without doc_id go
    by their text. Repeated rows go to one slot, each with a place of its own.
    Columns of ``docs`` named like the new ones, in whatever case, are replaced.
    An empty table gives an empty result. Texts are moved once, to their slot.
    """
    spark = docs.sparkSession
    slot_map = current_map(spark, slot_loads(docs, slots), shards, path)
    kept = others(docs.columns, FRESH)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select(
        F.struct(*[F.col(quoted(c)) for c in kept]).alias("doc"), F.col("doc_id").alias("by"), document_size(F.col("text")).alias("size"),
        crc.alias("text_crc32"), virtual_slot(F.col("doc_id"), F.col("text"), slots).alias("virtual"),
    )
    place = F.row_number().over(Window.partitionBy("virtual").orderBy("by", "text_crc32", "size"))
    dealt = spark.createDataFrame(slot_map.rows(), _MAP_SCHEMA).select(F.col("slot").alias("virtual"), "shard", "start")
    rows = rows.withColumn("place", place).join(F.broadcast(dealt), "virtual")  # as many rows as there are slots
    return rows.select(
        "doc.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
