"""Shards of near equal bytes by longest-processing-time scheduling.

Documents of equal text stay together. A group larger than one grain (all bytes over
``shards * GRAINS``) is an item of its own; there are at most ``shards * GRAINS`` such
groups at any input size. The other groups are gathered by hash into as many parcels,
each of about one grain at most. The items, at most ``2 * shards * GRAINS`` of them, are
sorted by size and go one by one to the least loaded shard through a heap.

Defined results: a null text has no bytes (its group is that of the null texts), its
checksum is 0; repeated rows are separate documents with places of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgauge.session import settle

GRAINS = 256
#: Places in a shard are numbered within this many parts of it.
SLOT_PARTS = 64


def lpt(shards: int):
    """Function over batches of all items that yields the shard of each."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        items = pd.concat(held, ignore_index=True)
        items = items.sort_values(["bytes", "big", "item"], ascending=[False, True, True])
        heap = [(0, s) for s in range(shards)]
        chosen = []
        for size in items["bytes"]:
            load, shard = heap[0]
            chosen.append(shard)
            heapq.heapreplace(heap, (load + int(size), shard))
        yield items.assign(shard=chosen)[["big", "item", "shard"]]

    return assign


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.col("text").cast("string")
    narrow = settle(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
            F.when(text.isNull(), F.lit(None)).otherwise(F.xxhash64(text)).alias("_text"),
        ).withColumn("_group", F.xxhash64("_text", F.coalesce(F.col("size"), F.lit(0)))).drop("_text")
    )
    grains = shards * GRAINS
    everything = narrow.agg(F.sum("size")).first()[0] or 0
    grain = everything / grains
    groups = settle(narrow.groupBy("_group").agg(F.sum("size").alias("bytes")))
    parcel = F.pmod(F.xxhash64("_group"), F.lit(grains))
    items = groups.filter(F.col("bytes") > grain).select(
        F.lit(True).alias("big"), F.col("_group").alias("item"), "bytes"
    ).unionByName(
        groups.filter(F.col("bytes") <= grain)
        .groupBy(parcel.alias("item"))
        .agg(F.sum("bytes").alias("bytes"))
        .select(F.lit(False).alias("big"), "item", "bytes")
    )
    placed = settle(
        items.repartition(1).mapInPandas(lpt(shards), "big boolean, item long, shard int")
    )
    big = placed.filter("big").select(F.col("item").alias("_group"), F.col("shard").alias("_own"))
    small = placed.filter("not big").select(F.col("item").alias("_parcel"), F.col("shard").alias("_shared"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SLOT_PARTS)).cast("int")
    dealt = (
        narrow.withColumn("_parcel", parcel)
        .join(F.broadcast(big), "_group", "left")
        .join(F.broadcast(small), "_parcel", "left")
        .select(
            "doc_id", "size", "text_crc32", part.alias("_part"),
            F.coalesce("_own", "_shared").alias("shard"),
        )
    )
    counts = dealt.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("shard").alias("_shard"), F.col("_part").alias("_of"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    within = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("_place", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), (F.col("shard") == F.col("_shard")) & (F.col("_part") == F.col("_of")))
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_start") + F.col("_place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
