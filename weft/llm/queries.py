"""The queries of the operators for training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontam, fim, html, license, lm, merkle, mix, neardup, pii, quality, shard, tokens, warc
from weft.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.materialised(table(spark, sf_dir, "documents"), key=20240229)


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op3_dom_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85, rows=6, bands=24)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    return quality.judged(table(spark, sf_dir, "documents")).select(*columns)


def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.report(table(spark, sf_dir, "documents"))


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.sharded(table(spark, sf_dir, "documents"))


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scanned(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transformed(table(spark, sf_dir, "documents")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def lm_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op2_ppm."""
    return op2_ppm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def pii_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op6_bootstrapped_pii."""
    return op6_bootstrapped_pii(spark, sf_dir).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_training_order, op2_ppm, op3_dom_boosting, op4_superminhash, op5_quality_rules, op6_bootstrapped_pii, op7_winnowing, op8_flow_mix, op9_kd_shards, op10_license_digests, op11_fill_in_middle, op12_merkle, op13_warc, lm_base_columns, pii_base_columns)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_superminhash": neardup.ORACLE_SQL,
        "op5_quality_rules": quality.ORACLE_SQL,
        "op7_winnowing": decontam.ORACLE_SQL,
        "op10_license_digests": license.ORACLE_SQL,
        "op11_fill_in_middle": fim.ORACLE_SQL,
        "op12_merkle": merkle.ORACLE_SQL,
        "op13_warc": warc.ORACLE_SQL,
        "lm_base_columns": lm.BASE_SQL,
        "pii_base_columns": pii.BASE_SQL,
    }
