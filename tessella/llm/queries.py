"""The registered queries of this subpackage, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, hard_negatives, host_rules, language_id, license_scan, minhash, mixing, quality_classifier, sharding, spelling, suffix_dedup, window_dedup
from .common import table
from .sql import ORACLES


def op1_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op2_suffix_runs_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "passes", "part", "shards", "orders")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op5_window_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sampled_splitter_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_format.read_back(*chat_format.format_conversations(chat_format.with_probe(table(spark, sf_dir, "conversations"))))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.vocabulary(table(spark, sf_dir, "documents"), drop_every=199))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, "vec_id", "label", "embedding", F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (
        op1_bbit_minhash, op2_suffix_runs_dedup, op3_source_mixing, op4_license_scan, op5_window_index_dedup,
        op6_latent_decontamination, op7_byte_cnn_language, op8_host_quality_rules, op9_subword_quality, op10_sampled_splitter_sharding, op11_chat_format, op12_spelling_variants, op13_hard_negatives)}
    return found | {"pipeline": pipeline}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
