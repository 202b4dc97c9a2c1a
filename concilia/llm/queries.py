"""Registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (byte_bpe, chat, conv_repair, exact_dedup, html_extract, mixing, near_dup, periodic, pu_quality, quality,
               secret_scan, token_counts, token_store)
from .common import scratch_path, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), root, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_tokens(spark, root).drop("ids")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"),
                               public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.similar_components(table(spark, sf_dir, "documents"), size=3, percent=85)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"'\\### Assistant: </turn> ok'"
    planted = spark.range(1).selectExpr(
        f"inline(array(struct(-7L, 0L, 'user', {said}), struct(-7L, 1L, 'assistant', {said}))) AS (conv_id, turn, role, text)")
    path = scratch_path(spark, "chat")
    chat.format_conversations(rows.unionByName(planted)).write.parquet(path)
    return chat.digests(chat.expanded(spark.read.parquet(path)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.with_periodic_tails(table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_repair.repair(conv_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_token_counts, op3_token_store, op4_byte_bpe, op5_near_duplicates, op6_exact_dedup, op7_secret_scan,
    op8_quality_rules, op9_html_text, op10_chat_format, op11_periodic_runs, op12_conversation_repair,
    op13_quality_classifier)}
ORACLE: dict[str, str] = {}
