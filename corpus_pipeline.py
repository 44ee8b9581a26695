"""A corpus pipeline of five stages: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. The first four return rows of
the documents table, unchanged; the last gives each row's shard and slot. Rows are carried whole, so further columns
pass through; names that begin with two underscores are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm import decontam, mixing, near_dup, quality, sharding
from packetloom.llm.registry import SHARDS, mix_levels, with_domain
from packetloom.llm.shared import cut, table

#: Part of the tokens that the mix may take, each document once at most.
MIX_SHARE = 0.9


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the rules and the classifiers."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return near_dup.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages."""
    return decontam.keep(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the mix takes."""
    mixed = mixing.mix(with_domain(docs, "__domain"), mix_levels("__domain"), share=MIX_SHARE, max_epochs=1)
    return mixed.where("__copies > 0").select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return sharding.assign(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: The classifier and the near-duplicate classes cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
    return docs
