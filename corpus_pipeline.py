"""A training corpus in five stages, each written as Parquet and read again.

Quality rules, exact dedup, near dedup (five-word shingles, similarity 0.8),
mixing to target weights, and byte-level BPE. All but the last stage return
the columns of ``documents``; the first three drop rows, mixing puts the
rows in mixture order, encoding returns one row each with its token ids,
their digests and its ``position`` in the mixture: the order in which the mixed rows lie in
their files, which a scan does not keep.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from concilia.llm import byte_bpe, exact_dedup, mixing, near_dup, quality
from concilia.llm.common import in_file_order, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(in_file_order(docs.select("doc_id", "text"), "position"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                               public_tokenizers.PATTERN, carry=("position",), ids=True)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix),
          ("byte_bpe", encode)]

#: Robust covariances, sketches and merges are no SQL; a test compares the stages with brute force on a
#: small table, where quality is decided by the base rules alone.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
