"""A training corpus from ``documents``: quality classifier, exact and near deduplication, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``. The classifier drops what it predicts to be of
label 0; of exact copies the largest doc_id stays, of near-duplicates (five-word shingles, similarity 0.8 or more) the
smallest; mixing returns a document as often as its leaf's epochs take it; the last stage returns digests of the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabscope.llm import exact_dedup, minhash_forest, quality_classifier, queries, source_mixing
from tabscope.session import scratch_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(queries.LEARNED)
    return quality_classifier.keep_good(docs, labels, "quality")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_forest.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.mixed(docs, **queries.MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.encoded(docs)


STAGES = [("quality classifier", classify), ("exact dedup", drop_copies), ("near dedup", drop_near_copies),
          ("source mixing", mix), ("bpe encoding", encode)]

#: SQL has no form of the classifier or the automaton; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what stands between two of them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
