"""The corpus pipeline: classify, filter by rules, drop near duplicates, mix sources, tokenise.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet in the shared
folder and read again as the next stage's documents. All stages but the last return the columns of
``documents``; the last returns token ids with their digests, a row per document taken into the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from visitlens.llm import bpe, mixing, ngram_join, quality_classifier, quality_rules
from visitlens.llm.common import persisted, read


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of ``sf_dir``, predicts to be good."""
    return quality_classifier.accepted(docs, quality_classifier.learned(docs, read(spark, sf_dir, "labels")))


def filter_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return ngram_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emit(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: ``doc_id, ids, n_tokens, ids_sha256, decoded_sha256``."""
    return bpe.tokenised(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", filter_by_rules),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenise),
]

#: SQL cannot express the fitted classifier or the merges; tests/llm/test_pipeline.py holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = persisted(docs, f"stage-{n}")
    return docs
