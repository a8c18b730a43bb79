"""Registered queries of the training-data operators: each over its whole table, as its contract says."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, compact_windows, decontaminate, licenses, pii, quality, secrets, sharding, simhash, suffix_dedup
from tidemark.llm.common import documents

#: For the registered query only; real runs pass a key of their own.
DEMO_KEY = b"tidemark demonstration key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir), DEMO_KEY)


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_passages(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir)).drop("marks")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 16)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


QUERIES = {f.__name__: f for f in (op1_pii, op2_compact_windows, op3_license_scan, op4_suffix_dedup, op5_simhash, op6_secret_scan, op7_sharding, op8_byte_bpe, op9_quality, op10_decontamination)}
ORACLE_SQL: dict[str, str] = {}
