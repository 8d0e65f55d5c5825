"""The operators as queries over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import conversations, decontam, html_text, importance, licenses, line_dedup, matroska, mixing, near_dup, pii, quality, token_counts, warc
from sievework.llm.common import read
from sievework.llm.oracles import ORACLES  # noqa: F401


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op5_media_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digest(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return done.select("doc_id", quality.held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("_th")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_by_document(read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.cluster(read(spark, sf_dir, "documents"), percent=85).drop("_th")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(read(spark, sf_dir, "conversations")))


def op12_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_round_trip,
        op2_license_scan,
        op3_main_text,
        op4_pii_spans,
        op5_media_digest,
        op6_quality,
        op7_decontamination,
        op8_source_mix,
        op9_line_dedup,
        op10_near_duplicates,
        op11_conversation_repair,
        op12_importance_sample,
        op13_token_counts,
    )
}
