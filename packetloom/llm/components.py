"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step hangs neighbours on smaller nodes, so the edges become stars around the smallest node of each component.
Every step is written to the shared folder; nothing about single nodes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node that has an edge (a, b) of longs; the label is the component's smallest node."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc_low")
        large = cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc_large")
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")), "cc_low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        if state == (state := _state(now)):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
