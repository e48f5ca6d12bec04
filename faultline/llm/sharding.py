"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed by id, checksum and size into ``SLOTS`` slots, once and for all, so the
different texts of one id, or of rows without an id, lie in many slots.  The bytes of each
slot are summed, and a map from slots to shards makes the shards' sizes near equal:
the largest slot goes to the smallest shard.  The map, one row a slot and version, is a
table in the shared folder.  Rebalancing edits it: the next version keeps every slot
where it is but those that must move, taken from shards above the mean, so growing by
a shard moves slots to the new one only.  Records never change their slot.

A record's size is the UTF-8 bytes of its text (null: none) plus one.  Its place in the
shard is gapless: slots follow each other, within a slot its ``PARTS`` parts (by a hash of
the whole record, so that a slot or id with many records is ordered by many tasks), within a
part records by id, checksum and size.  Ids may be of any type.  Repeated rows are records of
their own in one slot, which no map can split, and their order does not matter as they are equal.  An empty table gives an
empty result and a map of empty slots.  Only doc_id and text are read.
"""

import heapq

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.llm.base import stage

SLOTS = 4096
SHARDS = 8
#: Parts of a slot that are ordered apart.
PARTS = 64
MAP = "version int, virtual_slot int, shard int, bytes long, n_rows long"


def records(docs, slots=SLOTS):
    """doc_id, size, text_crc32, virtual_slot and part of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    crc, size = F.crc32(text), (F.octet_length(text) + 1).cast("long")
    key = F.xxhash64("doc_id", crc, size)
    return docs.select(
        "doc_id",
        size.alias("size"),
        crc.alias("text_crc32"),
        F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"),
        F.pmod(F.hash("doc_id", crc, size), F.lit(PARTS)).alias("part"),
    )


def part_sizes(rows):
    """Bytes and rows of every part of every slot."""
    sizes = rows.groupBy("virtual_slot", "part").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n_rows")
    )
    return stage(sizes, "slot-parts")


def slot_sizes(parts, slots=SLOTS):
    """{slot: (bytes, rows)} of every slot, at most ``slots`` entries."""
    found = parts.groupBy("virtual_slot").agg(F.sum("bytes").alias("b"), F.sum("n_rows").alias("n"))
    sizes = dict.fromkeys(range(slots), (0, 0))
    sizes.update({r["virtual_slot"]: (r["b"], r["n"]) for r in found.collect()})
    return sizes


def balance(sizes, shards=SHARDS):
    """{slot: shard}: largest slots first, each to the smallest shard so far."""
    heap = [(0, 0, shard) for shard in range(shards)]
    owner = {}
    for slot in sorted(sizes, key=lambda s: (-sizes[s][0], s)):
        held, n, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (held + sizes[slot][0], n + 1, shard))
    return owner


def rebalance(owner, sizes, shards):
    """The map edited for ``shards`` shards: shards above the mean give slots to those below.

    New shards only receive, and slots of shards that are gone go to the smallest.  Else
    a slot moves only if that brings the two shards closer together.
    """
    held = dict.fromkeys(range(shards), 0)
    for slot, shard in owner.items():
        held[shard] = held.get(shard, 0) + sizes[slot][0]
    mean = sum(held.values()) / shards
    fresh = set(range(shards)) - set(owner.values())
    shrinks = any(shard >= shards for shard in owner.values())
    edited = dict(owner)
    for slot in sorted(owner, key=lambda s: (-sizes[s][0], s)):
        here, size = owner[slot], sizes[slot][0]
        there = min(fresh or range(shards), key=lambda s: (held[s], s))
        closer = size > 0 and held[here] - mean >= size / 2 and mean - held[there] >= size / 2
        if here >= shards or (closer and not shrinks):
            edited[slot] = there
            held[here] -= size
            held[there] += size
    return edited


def slot_map(spark, owner, sizes, version):
    """One version of the map as a table in the shared folder."""
    rows = [(version, slot, owner[slot], *sizes[slot]) for slot in sorted(owner)]
    return stage(spark.createDataFrame(rows, MAP), f"slot-map-v{version}")


def place(rows, parts, mapped):
    """Every record's shard and its gapless place there.

    ``parts`` has the rows of the slots' parts, ``mapped`` is one map version.
    """
    # the map has a row for each of the fixed slots, the offsets one for each part
    owned = parts.join(F.broadcast(mapped.select("virtual_slot", "shard")), "virtual_slot")
    before = (
        W.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = owned.select(
        "virtual_slot",
        "part",
        "shard",
        F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("_before"),
    )
    inside = W.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    local = rows.withColumn("_local", F.row_number().over(inside) - 1)
    return local.join(F.broadcast(offsets), ["virtual_slot", "part"]).withColumn(
        "slot", F.col("_before") + F.col("_local")
    ).drop("_before", "_local", "part")


def shard(docs, shards=SHARDS, slots=SLOTS):
    """(records with shard and place, the slot map's first version)."""
    rows = records(docs, slots)
    parts = part_sizes(rows)
    sizes = slot_sizes(parts, slots)
    mapped = slot_map(docs.sparkSession, balance(sizes, shards), sizes, 1)
    return place(rows, parts, mapped), mapped
