"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, fingerprint, licences, lines, mixing, near, phrases, quality, sharding, substrings, tokens, warc, whitening
from tessella.llm.common import documents


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(documents(spark, sf_dir))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op2(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op3(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.op4(documents(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.op5(documents(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op6(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.op8(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op9(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op10(documents(spark, sf_dir))


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.op11(documents(spark, sf_dir))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.op12(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op13(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_token_counts": op4_token_counts,
        "op5_near_dedup": op5_near_dedup,
        "op6_warc": op6_warc,
        "op7_quality_rules": op7_quality_rules,
        "op8_fingerprints": op8_fingerprints,
        "op9_sharding": op9_sharding,
        "op10_bpe": op10_bpe,
        "op11_licences": op11_licences,
        "op12_phrases": op12_phrases,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.sql(),
        "op3_line_dedup": lines.sql(),
        "op6_warc": warc.sql(),
        "op7_quality_rules": quality.sql(),
        "op8_fingerprints": fingerprint.sql(),
        "op11_licences": licences.sql(),
        "op12_phrases": phrases.sql(),
    }
