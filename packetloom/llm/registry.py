"""Queries of this subpackage's operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, line_dedup, lm, mixing, near_dup, quality, sharding, substring_dedup, url_filter, warc
from .oracle import ORACLE_SQL as ORACLE_SQL
from .shared import table

SHARDS = 24

URL_RULES = (
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
)

#: Domain of a source: by the number in its name.
DOMAINS = ("web", "books", "code", "forum")


def mix_levels(domain: str = "domain") -> tuple[mixing.Level, ...]:
    return (
        mixing.Level(domain, {"web": 0.45, "books": 0.25, "code": 0.2, "forum": 0.1}, other=0.05),
        mixing.Level("lang", {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, other=0.1),
        mixing.Level("source"),
    )


def with_domain(docs: DataFrame, name: str = "domain") -> DataFrame:
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"([0-9]{1,9})$", 1)
    at = F.when(number != "", number.cast("int") % len(DOMAINS) + 1)
    return docs.withColumn(name, F.coalesce(F.element_at(F.array(*map(F.lit, DOMAINS)), at), F.lit("other")))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs, size=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    mixed = mixing.mix(docs, mix_levels(), share=0.6, max_epochs=2)
    return mixed.select("doc_id", "domain", "lang", "source", F.col("__tokens").alias("n_tokens"), F.col("__copies").alias("n_copies"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.new_archive_path(spark)
    warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read_archive(spark, path)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.classes(docs).select("doc_id", "class_id", "n_links")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, table(spark, sf_dir, "labels"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontam": op6_decontam,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_line_dedup": op8_line_dedup,
    "op9_sharding": op9_sharding,
    "op10_url_filter": op10_url_filter,
}
