"""Pack indivisible groups into a fixed number of shards of near equal bytes.

Best-fit decreasing: groups sorted by size enter the shard with the tightest remaining
capacity that holds them, found in a balanced search tree.  Only groups above 1/1000 of
a shard are packed one by one: there are at most 1000 per shard.  The smaller ones are
first put together by hash into at most 1000 bundles per shard.  So the packing sees
at most 2000 items per shard whatever the size of the table, and groups stay whole.

A group larger than a shard cannot be whole without breaking the law of equal bytes:
it is cut by doc_id into pieces of about a quarter of a shard.

Rows: a NULL text has no bytes and is a group of its own, apart from the empty text.
Repeated rows belong to the same group.  With an empty table the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import order_key, stage, with_start

GRAINS = 1000  # a shard's bytes divided by this part groups from bundles
ROW_BYTES = 16


class Bins:
    """A treap of (room, bin); priorities are a hash of the bin, so runs agree."""

    def __init__(self, count: int, room: int):
        self.root = None
        for number in range(count):
            self.add(room, number)

    def add(self, room: int, number: int) -> None:
        node = [(room, number), (number * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1), None, None]
        left, right = self._split(self.root, node[0])
        self.root = self._merge(self._merge(left, node), right)

    def take(self, size: int) -> tuple[int, int]:
        """Remove and return the bin with the least room for ``size``, else the roomiest."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            key = self._end(left, 3)
            self.root, _ = self._split(left, key)
        else:
            key = self._end(right, 2)
            _, rest = self._split(right, (key[0], key[1] + 1))
            self.root = self._merge(left, rest)
        return key

    @staticmethod
    def _end(node: list, side: int) -> tuple[int, int]:
        while node[side] is not None:
            node = node[side]
        return node[0]

    def _split(self, node, key):
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], more = self._split(node[3], key)
            return node, more
        less, node[2] = self._split(node[2], key)
        return less, node

    def _merge(self, left, right):
        if left is None or right is None:
            return left if right is None else right
        if left[1] >= right[1]:
            left[3] = self._merge(left[3], right)
            return left
        right[2] = self._merge(left, right[2])
        return right


def best_fit_decreasing(items: Iterable[tuple[str, int]], shards: int) -> dict[str, int]:
    """The shard of each item; what fits nowhere goes where most room is left."""
    items = sorted(items, key=lambda x: (-x[1], x[0]))
    bins = Bins(shards, -(-sum(size for _, size in items) // shards))
    placed = {}
    for item, size in items:
        room, number = bins.take(size)
        placed[item] = number
        bins.add(room - size, number)
    return placed


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = stage(docs.select(
        "doc_id", order_key().alias("order_key"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2("text", 256)), F.unhex(F.lit(""))).alias("digest")), "sizes")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    room = max(1, math.ceil(total / shards))
    pieces = F.when(F.col("bytes") > room, F.ceil(4 * F.col("bytes") / room)).otherwise(1)
    large = stage(rows.groupBy("digest").agg(F.sum("size").alias("bytes")).where(
        F.col("bytes") > room / GRAINS).select("digest", pieces.alias("pieces")), "large")
    item = (F.when(F.col("pieces").isNull(), F.concat(F.lit("b"), F.pmod(
        F.xxhash64("digest"), F.lit(shards * GRAINS)).cast("string")))
        .otherwise(F.concat(F.lit("g"), F.hex("digest"), F.lit("."), F.pmod(
            F.xxhash64("order_key"), F.col("pieces")).cast("string"))))
    # at most GRAINS groups above 1/GRAINS of a shard fit into each shard's bytes
    items = rows.join(F.broadcast(large), "digest", "left").withColumn("item", item)
    sizes = items.groupBy("item").agg(F.sum("size").alias("bytes")).collect()
    placed = spark.createDataFrame(
        list(best_fit_decreasing(((r["item"], r["bytes"]) for r in sizes), shards).items()),
        "item string, shard int")
    placed_rows = items.join(F.broadcast(placed), "item").select(
        "doc_id", "order_key", "size", "text_crc32", "shard")
    return with_start(placed_rows, ["shard"], ["order_key", "doc_id", "text_crc32"],
                      F.lit(1)).select(
        "doc_id", "size", "text_crc32", "shard", F.col("start").cast("long").alias("slot"))
