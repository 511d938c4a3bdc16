"""Sharding by longest processing time: groups that stay together, largest first, each to the least-loaded shard."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import files_for, kept, written

#: With P packs, groups over ``total / (shards * FINE * P)`` bytes are scheduled one by one by the driver: at most ``shards * FINE * P`` of them.
FINE = 64
#: Groups that a pack is meant for, and the most packs.
PACK_GROUPS, PACKS = 50_000, 64
#: Rows that share a window task when slots are numbered.
SLOT_ROWS = 200_000


def schedule(sizes: list[tuple[int, object]], loads: list[float]) -> list[tuple[object, int]]:
    """Give each (size, name), in the order given, to the least-loaded shard (ties: the lowest); ``loads`` is updated."""
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for size, name in sizes:
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        loads[k] = load + size
        out.append((name, k))
    return out


def _packer(loads: list[float]):
    """Schedule the groups of each pack, which come together and largest first, on top of its share of the loads; ties go to another shard first in each pack."""

    def pack(batches):
        n, turn, heap = len(loads), None, []
        for batch in batches:
            shards = []
            for own, size in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                if own != turn:
                    turn, heap = own, [(load, (k - own) % n) for k, load in enumerate(loads)]
                    heapq.heapify(heap)
                load, k = heap[0]
                heapq.heapreplace(heap, (load + size, k))
                shards.append((k + turn) % n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shards, pa.int32())], ["text_key", "shard"])

    return pack


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", fine: int = FINE) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, size, text_crc32, shard, slot``.

    A group is all rows of one text; its size is the sum of their UTF-8 bytes plus 8 a row.  The
    groups over ``1 / (shards * fine * P)`` of all bytes are scheduled by the driver through one
    heap.  All others are hashed over ``P`` packs, as many as the groups need whatever the session
    shuffles with, sorted there by size, and each pack is scheduled through a heap of its own that
    starts from its share of the loads so far.  A pack leaves the shards that it fills at most
    one of its groups apart, so all packs leave these within ``1 / fine`` of a mean shard; a task
    streams its groups and holds the heap alone.  A text goes to the groups' table by its
    SHA-256, summed before the shuffle, and comes back by a join that can be split.

    ``slot`` numbers a shard's rows from 0 without gaps, by hash bucket, then id and checksum.

    A null text is an empty one of its own, size 8; null ids and repeated rows each take a slot.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    key = F.when(text.isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(raw, 256)))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), key.alias("text_key"))
    rows = kept(rows)
    groups = written(rows.groupBy("text_key").agg(F.sum("size").alias("bytes")), "groups")
    total, groups_n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    packs = min(files_for(groups_n, PACK_GROUPS), PACKS)
    large = F.col("bytes").cast("double") * (shards * fine * packs) > float(total)
    loads = [0.0] * shards
    first = groups.where(large).orderBy(F.desc("bytes"), "text_key").collect()  # at most shards * fine * packs rows
    placed = schedule([(r["bytes"], bytes(r["text_key"])) for r in first], loads)
    share = [x / packs for x in loads]
    small = groups.where(~large).withColumn("pack", F.pmod(F.xxhash64("text_key"), F.lit(packs)).cast("int"))
    small = small.repartition(packs, "pack").sortWithinPartitions("pack", F.desc("bytes"), "text_key")
    where = small.select("text_key", "bytes", "pack").mapInArrow(_packer(share), "text_key binary, shard int")
    where = where.union(spark.createDataFrame(placed, "text_key binary, shard int"))
    out = written(rows.join(where, "text_key").drop("text_key"), "placed")

    buckets = max(1, -(-out.count() // SLOT_ROWS))
    out = out.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    counts = out.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.join(counts.select("shard", "bucket", before.alias("before")), ["shard", "bucket"])
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + number - 1).alias("slot"))
