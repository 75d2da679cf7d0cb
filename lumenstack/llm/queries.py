"""The thin registered queries: each applies an operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.llm import oracles
from lumenstack.llm.text import fold
from lumenstack.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenstack.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenstack.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenstack.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenstack.llm.quality import fit, score_quality

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 2)
    scored = score_quality(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenstack.llm.language import identify_language, learn_samples

    docs = table(spark, sf_dir, "documents")
    samples = learn_samples(docs, fold(F.col("doc_id")) != 2)
    found = identify_language(docs, samples)
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenstack.llm.decontamination import find_hits

    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.array_join("items", ",").cast("binary")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenstack.llm.sharding import shard_by_bytes

    found = shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenstack.llm.order_minhash import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenstack.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenstack.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
