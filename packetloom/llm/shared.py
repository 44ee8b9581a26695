"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex class of the bytes that separate words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What a null doc_id counts as where documents are ordered: it comes before all others.
NULL_KEY = -(1 << 63)

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, else one of our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="packetloom-")
    return _own_dir[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(NULL_KEY)).cast("long")


def mark_of(doc_id: Column, text: Column) -> Column:
    """128 bits of SHA-256 of a text (null as the empty one), for a null doc_id others: with the key what tells documents apart."""
    return F.unhex(F.substring(F.sha2(F.concat(F.when(doc_id.isNull(), "-").otherwise("+"), F.coalesce(text, F.lit(""))), 256), 1, 32))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, mark): rows with equal key and mark hold the same document."""
    return docs.select("doc_id", "text", key_of(F.col("doc_id")).alias("key"), mark_of(F.col("doc_id"), F.col("text")).alias("mark"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
