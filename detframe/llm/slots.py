"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot follows from its id alone and never changes. Bytes are summed per slot, and only the small map from
slots to shards is edited when loads drift or shards are added; each edit is a new version, and older ones stay
readable.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from detframe.llm.common import land
from detframe.session import shared_dir

SHARDS, SLOTS = 16, 4096
#: The gap between the fullest and the emptiest shard that is left alone, as a share of the mean.
TOLERANCE = 0.001


def slot_of(doc_id: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(slots)).cast("int")


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalanced(held: list[int], loads: list[int], shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[int]:
    """The map edited until loads are near equal: a slot goes from the fullest shard to the emptiest, or the two swap
    slots, as long as that lessens the gap. Shards up to ``shards`` that hold nothing yet are filled."""
    out, total = list(held), [0] * shards
    for slot, shard in enumerate(out):
        total[shard] += loads[slot]
    own = [sorted((loads[s], s) for s in range(len(out)) if out[s] == k) for k in range(shards)]
    while True:
        low, high = min(range(shards), key=lambda k: (total[k], k)), max(range(shards), key=lambda k: (total[k], -k))
        gap = total[high] - total[low]
        if gap <= tolerance * sum(total) / shards:
            return out
        best = _best_exchange(own[high], own[low], gap)
        if best is None:
            return out
        give, take = best
        for (load, slot), source, target in [(give, high, low)] + ([(take, low, high)] if take else []):
            own[source].remove((load, slot))
            own[target] = list(heapq.merge(own[target], [(load, slot)]))
            out[slot] = target
            total[source] -= load
            total[target] += load


def _best_exchange(rich: list[tuple[int, int]], poor: list[tuple[int, int]], gap: int):
    """The slot, or pair of slots, whose exchange moves nearest to half the gap; none if nothing lessens it."""
    best, error = None, gap / 2
    i = 0
    poor = [(0, None), *poor]
    for give in rich:
        while i + 1 < len(poor) and give[0] - poor[i + 1][0] >= gap / 2:
            i += 1
        for take in poor[i:i + 2]:
            moved = give[0] - take[0]
            if 0 < moved < gap and abs(moved - gap / 2) < error:
                best, error = (give, take if take[1] is not None else None), abs(moved - gap / 2)
    return best


class SlotMaps:
    """Versions of a slot-to-shard map in the shared folder: each version stores the slots it moved."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark).rstrip('/')}/{name}"

    def write(self, version: int, held: list[int], before: list[int] | None = None) -> None:
        edits = [(slot, shard) for slot, shard in enumerate(held) if before is None or before[slot] != shard]
        self.spark.createDataFrame(edits, "vslot int, shard int").coalesce(1).write.parquet(f"{self.path}/version={version}")

    def read(self, version: int) -> DataFrame:
        """``vslot, shard`` as of a version: a slot's last edit up to then (a fixed number of rows)."""
        parts = [self.spark.read.parquet(f"{self.path}/version={v}").withColumn("version", F.lit(v)) for v in range(version + 1)]
        edits = parts[0]
        for part in parts[1:]:
            edits = edits.unionByName(part)
        return edits.groupBy("vslot").agg(F.max_by("shard", "version").alias("shard"))


def sizes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), slot_of(F.col("doc_id").cast("long"), slots).alias("vslot"))


def slot_loads(sized: DataFrame, slots: int = SLOTS) -> list[int]:
    loads = [0] * slots
    for row in sized.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect():  # at most one row per slot
        loads[row.vslot] = row.bytes
    return loads


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version`` of every row.

    The law is ``bytes``: sizes of shards are near equal. ``size`` is the text's bytes plus one (null: one);
    ``text_crc32`` is null for a null text; ``slot`` is the row's place in its shard, gapless from 0 (virtual slots in order,
    within one by doc_id, checksum and size; equal rows in any order). Version 0 of the map deals slots round, version 1 is
    rebalanced by bytes. Other columns are not read; null ids share a slot; an empty table gives an empty result.
    """
    sized = land(sizes(docs, slots))
    loads = slot_loads(sized, slots)
    start = first_map(slots, shards)
    edited = rebalanced(start, loads, shards)
    store = SlotMaps(docs.sparkSession, f"slots-{uuid.uuid4().hex}")
    store.write(0, start)
    store.write(1, edited, start)
    counts = sized.groupBy("vslot").agg(F.count(F.lit(1)).alias("n"))  # as many rows as slots
    place = store.read(1).join(counts, "vslot", "left").fillna(0, ["n"])
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    place = place.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (sized.withColumn("at", F.row_number().over(within) - 1).join(F.broadcast(place.drop("n")), "vslot")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(1).alias("map_version")))
