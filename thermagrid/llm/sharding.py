"""Sharding by bytes: Karmarkar-Karp differencing of indivisible groups of equal texts."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_size, ranked, stored

#: Groups larger than 1/HEAVY of a shard's fair share are placed one by one: HEAVY * shards of them at most.
HEAVY = 50
#: The others are placed in this many bundles a shard.
BUNDLES = 200


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item.  Every item starts as a partial partition of its own; the two with the largest spread
    are combined again and again, the largest parts of one with the smallest of the other."""
    if not sizes:
        return []
    heap: list[tuple[int, int, list[tuple[int, int]]]] = []
    kids: list[tuple[int, int]] = []  # parts as trees of item or earlier part

    def leaf(item: int) -> int:
        kids.append((-1, item))
        return len(kids) - 1

    for item, size in enumerate(sizes):
        parts = [(0, -1)] * (shards - 1) + [(size, leaf(item))]
        heap.append((-size, item, parts))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = []
        for (x, m), (y, n) in zip(a, reversed(b), strict=True):
            if m < 0 or n < 0:
                joined.append((x + y, max(m, n)))
            else:
                kids.append((m, n))
                joined.append((x + y, len(kids) - 1))
        joined.sort()
        heapq.heappush(heap, (joined[0][0] - joined[-1][0], serial, joined))
        serial += 1
    shard_of = [0] * len(sizes)
    for shard, (_, root) in enumerate(heap[0][2]):
        todo = [root] if root >= 0 else []
        while todo:
            m, n = kids[todo.pop()]
            if m < 0:
                shard_of[n] = shard
            else:
                todo += [m, n]
    return shard_of


def shard(docs: DataFrame, shards: int, heavy: int = HEAVY, bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs (doc_id, text).

    Size: UTF-8 bytes plus 8.  Rows of equal texts are one group and stay together; a null text groups with the empty
    one.  A group larger than 1/heavy of a shard's share is an item of its own; the rest go by hash into
    shards * bundles bundles, one item each.  So the driver differences at most shards * (heavy + bundles) items,
    however many rows there are, and the table of items that is broadcast has the same bound.  slot: gapless from 0
    within the shard, by doc_id, from a distributed prefix sum.  Repeated rows each get a slot.  Other columns are
    ignored.  No rows: no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (byte_size(text) + 8).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("group"),
        ),
        "shard",
    )
    groups = rows.groupBy("group", "text_crc32").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("group", "text_crc32"), F.lit(shards * bundles))
    big = F.col("bytes") * (shards * heavy) > total
    items = (
        groups.select(
            F.when(big, F.col("group")).alias("group"),
            F.when(big, F.col("text_crc32")).alias("crc"),
            F.when(~big, bundle).alias("bundle"),
            "bytes",
        )
        .groupBy("group", "crc", "bundle")
        .agg(F.sum("bytes").alias("bytes"))
        .collect()  # at most shards * (heavy + bundles) rows
    )
    items.sort(key=lambda x: (x["bytes"], x["bundle"] or -1, x["group"] or 0, x["crc"] or 0))
    placed = difference([x["bytes"] for x in items], shards)
    own = T.StructType([T.StructField("group", T.LongType()), T.StructField("text_crc32", T.LongType()), T.StructField("own", T.IntegerType())])
    light = T.StructType([T.StructField("bundle", T.LongType()), T.StructField("light", T.IntegerType())])
    alone = spark.createDataFrame([(x["group"], x["crc"], k) for x, k in zip(items, placed, strict=True) if x["bundle"] is None], own)
    bundled = spark.createDataFrame([(x["bundle"], k) for x, k in zip(items, placed, strict=True) if x["bundle"] is not None], light)
    dealt = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(alone), ["group", "text_crc32"], "left")
        .join(F.broadcast(bundled), "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own", "light").alias("shard"))
    )
    return ranked(dealt, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
