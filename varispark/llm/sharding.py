"""Shards by fixed virtual slots: records hash into slots, slots carry bytes, and a versioned map sends slots to shards.

A record's slot never changes, so rebalancing edits the map and moves whole slots only. Everything that touches
records is DataFrame functions; the driver sees one row for each slot, of which there is a fixed number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, read, written

SLOTS = 8192
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """shard[s] is the shard of slot s, under this version."""

    version: int
    shard: tuple[int, ...]

    def edited(self, moves: dict[int, int]) -> SlotMap:
        return SlotMap(self.version + 1, tuple(moves.get(s, x) for s, x in enumerate(self.shard)))


def first_map(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1: slots by falling bytes, each to the shard with the fewest so far."""
    loads = [(0, k) for k in range(shards)]
    shard = [0] * slots
    for s in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, k = heapq.heappop(loads)
        shard[s] = k
        heapq.heappush(loads, (load + sizes.get(s, 0), k))
    return SlotMap(1, tuple(shard))


def rebalanced(old: SlotMap, sizes: dict[int, int], shards: int, slack: float = 0.0) -> SlotMap:
    """The next version: as few bytes move as bring every shard within `slack` of the mean, where slots allow.

    New shards start empty; shards beyond `shards` are emptied. Of the fullest shard, the largest slot that the
    emptiest can take without passing the mean moves, or else the one that brings the two closest together; a shard
    that has none gives way to the next fullest. In the end no shard holds more than the emptiest by more than its
    smallest slot.
    """
    loads, own = [0] * shards, [[] for _ in range(shards)]
    loose = []
    for s, k in enumerate(old.shard):
        if k < shards:
            loads[k] += sizes.get(s, 0)
            own[k].append(s)
        else:
            loose.append(s)
    moves: dict[int, int] = {}
    for s in sorted(loose, key=lambda s: -sizes.get(s, 0)):
        k = min(range(shards), key=lambda k: (loads[k], k))
        moves[s] = k
        loads[k] += sizes.get(s, 0)
        own[k].append(s)
    mean = sum(loads) / shards
    for _ in range(4 * len(old.shard)):
        low = min(range(shards), key=lambda k: (loads[k], k))
        if max(loads) <= mean * (1 + slack) and loads[low] >= mean * (1 - slack):
            break
        for top in sorted(range(shards), key=lambda k: (-loads[k], k)):
            gap = loads[top] - loads[low]
            useful = [s for s in own[top] if 0 < sizes.get(s, 0) < gap]
            if useful:
                break
        else:
            break
        fitting = [s for s in useful if loads[low] + sizes[s] <= mean]
        s = max(fitting, key=lambda s: (sizes[s], -s)) if fitting else min(useful, key=lambda s: (abs(gap - 2 * sizes[s]), s))
        own[top].remove(s)
        own[low].append(s)
        loads[top] -= sizes[s]
        loads[low] += sizes[s]
        moves[s] = low
    return old.edited(moves)


def save_map(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Store a version beside the others under path, as path/version=N."""
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, m.shard))), ",")).alias("slot", "shard"))
    rows.select("slot", F.col("shard").cast("int").alias("shard")).coalesce(1).write.parquet(f"{path}/version={m.version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("slot int, shard int").parquet(f"{path}/version={version}")


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot). Null texts have size OVERHEAD and the checksum of no bytes.

    The slot hashes doc_id with the text's checksum: rows without a doc_id spread too, equal rows share a slot.
    """
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return out.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_totals(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows): a row for each slot comes to the driver, whatever the number of records."""
    totals = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r["virtual_slot"]: (r["b"], r["n"]) for r in totals}


def placed(rows: DataFrame, slot_map: DataFrame, totals: dict[int, tuple[int, int]], m: SlotMap) -> DataFrame:
    """rows with shard and slot, their place in the shard: slots of a shard in order, rows of a slot by doc_id.

    Numbering runs within virtual slots, so it takes thousands of tasks, not one for each shard.
    """
    before, at = [0] * len(m.shard), [0] * (max(m.shard, default=0) + 1)
    for s, k in enumerate(m.shard):
        before[s] = at[k]
        at[k] += totals.get(s, (0, 0))[1]
    offsets = F.split(F.lit(",".join(map(str, before))), ",")
    w = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")
    numbered = rows.withColumn("slot", F.row_number().over(w) - 1 + F.element_at(offsets, F.col("virtual_slot") + 1).cast("long"))
    known = F.broadcast(slot_map.withColumnRenamed("slot", "virtual_slot"))  # one row a slot: SLOTS rows
    return numbered.join(known, "virtual_slot", "left")


def shard_documents(docs: DataFrame, shards: int, path: str | None = None, slots: int = SLOTS, history: Iterable[int] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, slot, shard) of all documents, near equal in bytes over the shards.

    path: where map versions are kept, a new folder if None; history: shard counts of earlier versions, each of
    which is stored and then edited into the next. An empty table gives no row; ties and repeated rows each keep a
    place of their own; columns besides doc_id and text are ignored.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "slot-map")
    rows = written(slotted(docs, slots), "slotted")
    totals = slot_totals(rows)
    sizes = {s: b for s, (b, _) in totals.items()}
    counts = [*history, shards]
    m = first_map(sizes, counts[0], slots)
    save_map(spark, m, path)
    for n in counts[1:]:
        m = rebalanced(m, sizes, n)
        save_map(spark, m, path)
    return placed(rows, load_map(spark, path, m.version), totals, m)


def op5_query(spark, sf_dir: str) -> DataFrame:
    """40 shards by the second version of the map, edited from a first one of 32 shards."""
    out = shard_documents(read(spark, sf_dir, "documents"), 40, history=[32])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
