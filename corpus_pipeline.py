"""A corpus pipeline: quality, line dedup, near-dedup, decontamination, tokens.

Every stage reads what its predecessor wrote and returns the columns of ``documents``,
but for the last, which adds the ids of each text. No stage collects documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe, decontaminate, line_dedup, minhash, quality
from quadrille.llm._common import free_name, fresh_path, materialize

#: A document is rejected only where a low quality is likelier than a high one.
REJECT_BELOW = 0.5
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs.columns, "_quality")
    return quality.with_score(docs, model, score).where(F.col(score) >= REJECT_BELOW).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs, and documents of which nothing is left."""
    names = {c: f"{free_name(docs.columns, '_kept')}{k}" for k, c in enumerate(docs.columns) if c.lower() in ("n_lines", "n_deleted")}
    left = line_dedup.dedup_lines(docs.withColumnsRenamed(names), counts=True).where("n_deleted = 0 or n_deleted < n_lines")
    return left.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five words, 0.8 or more."""
    return minhash.keep_one(docs, n=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out, and drops documents that were nothing else. Texts that
    were blank before lose nothing, so they stay."""
    blank = free_name(docs.columns, "_blank")
    marked = docs.withColumn(blank, ~F.col("text").rlike(r"\S"))
    left = decontaminate.remove_hits(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return left.where(F.col("text").isNull() | F.col(blank) | F.col("text").rlike(r"\S")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, n_tokens, ids and decoded text of each document."""
    return bpe.encode_documents(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("bpe encoding", token_stage),
]

#: Trained trees and BPE are no SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), "stage", f"{folder}/{k}")
    return docs
