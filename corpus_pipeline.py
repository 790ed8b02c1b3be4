"""The corpus pipeline: quality, near-duplicates, benchmark passages, secrets, token ids.

Every stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns the columns of documents;
the last returns each document's token ids. Filtering stages keep the rows that they do not reject as they are.

Defined cases, in every stage: an empty table gives an empty one; extra columns are kept, whatever they are called (the last
stage returns its own columns); texts are worked on whole. Further, by stage:

* quality: null and empty texts are scored by their few features; equal texts, and so repeated rows, share their fate;
* near duplicates: null and empty texts are one class; repeated rows are one document; different texts under one doc_id, or
  under none, are documents of their own;
* decontamination: null and empty texts stay; rows go by text and doc_id, so repeated rows share their fate;
* secrets: null texts stay null, empty ones empty, every row stays;
* tokens: a null text has no ids; repeated rows each get theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatewatch.llm import bpe, decontaminate, neardup, quality, secrets
from gatewatch.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, fitted on the rated documents among them, does not hold good."""
    return quality.select(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return neardup.keep_one(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold an exact or edited copy of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the text, which changes n_chars; null texts stay null."""
    return secrets.redacted(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document."""
    encoded = bpe.encode(docs, bpe.tokenizer_path(), keep=("doc_id", "lang", "source"), full=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("secrets", redact_secrets),
    ("tokens", encode_tokens),
]
#: SQL expresses neither the classifier nor the signatures; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on the Parquet files that the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
