"""Rendezvous sharding: each record goes to the shard that wins a seeded draw on its key.

Shard j draws u(key, j) in (0, 1) and bids -weight_j / ln(u). The highest bid wins, so shard j gets its
share of the weights, and a new shard takes rows only into itself: the other bids stay as they were.

Slots are numbered in groups by a hash of key and text, so that different rows of one key (or of none) do not meet in one task.

Defined cases: a null key is a key like any other (all such rows share a shard); repeated rows of one key
share a shard and get slots of their own, in any order among equal rows; an empty table gives an empty result; a null text has size 8; a
very long text is only measured. Other columns of the table are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups that split each shard where slots are numbered; their rows are numbered in parallel.
SLOT_GROUPS = 1024
OVERHEAD_BYTES = 8


def _draw(key: Column, shard: int, seed: int) -> Column:
    """Uniform in (0, 1) from the top 53 bits of a 64-bit hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(shard)), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def rendezvous(key: Column, weights: Sequence[float], seed: int = 17) -> Column:
    """Shard (from 0) of a key among len(weights) weighted shards."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, and one of them positive")
    bids = [
        F.struct((F.lit(-float(w)) / F.log(_draw(key, j, seed))).alias("bid"), F.lit(j).alias("shard"))
        for j, w in enumerate(weights)
        if w > 0
    ]
    return (F.greatest(*bids) if len(bids) > 1 else bids[0]).getField("shard")


def slots(df: DataFrame, shard: str, order: Sequence[str], spread: str, groups: int = SLOT_GROUPS) -> DataFrame:
    """Add `slot`, gapless from 0 in each shard, without bringing a shard to one task.

    `spread` is a long hash column. Its top bits cut each shard into groups, which follow each other:
    a group's first slot is the number of rows in the groups before it.
    """
    group = F.shiftrightunsigned(F.col(spread), 64 - (groups.bit_length() - 1)).cast("int")
    rows = df.withColumn("__group", group)
    sizes = rows.groupBy(shard, "__group").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(
        F.col(shard).alias("__shard"), F.col("__group").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")
    )
    # At most one row for each shard and group, whatever the input: small enough to send to every task.
    joined = rows.join(F.broadcast(first), (F.col(shard) == F.col("__shard")) & (F.col("__group") == F.col("__of")))
    within = Window.partitionBy(shard, "__group").orderBy(spread, *order)
    return joined.withColumn("slot", (F.col("__first") + F.row_number().over(within) - 1).cast("long")).drop(
        "__group", "__shard", "__of", "__first"
    )


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], seed: int = 17) -> DataFrame:
    """Shard, slot and the shard after growth for each document, with its size and checksum."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights, seed).alias("shard"),
        rendezvous(F.col("doc_id"), grown, seed).alias("grown_shard"),
        F.xxhash64(F.col("doc_id"), F.lit(seed), F.crc32(text).cast("long")).alias("__h"),
    )
    return slots(rows, "shard", ["doc_id", "text_crc32", "size"], "__h").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
