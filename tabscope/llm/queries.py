"""Registered queries of this subpackage, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm import (
    bpe,
    conversations,
    exact_dedup,
    licenses,
    minhash_forest,
    personal_data,
    quality_classifier,
    quality_rules,
    secrets,
    source_mixing,
    token_counts,
    toxicity,
    vector_codes,
)
from tabscope.llm.common import read_documents
from tabscope.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

#: Folder of the public vocabularies; on a cluster, every machine's copy.
TOKENIZERS = "/opt/tokenizers"

# How the byte-level vocabulary splits text, and its free identifier.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_DOCUMENT = 50_256

#: Labels that may be learned from: a fifth of the identifiers is held out.
LEARNED = "pmod(crc32(CAST(doc_id AS STRING)), 5) <> 0"

MIX = {"budget_share": 0.6, "epochs": 3, "seed": 7, "weights": {
    "domain": {"domain0": 2, "domain1": 3, "domain2": 1, "domain3": 2}, "language": {"en": 4, "de": 2, "fr": 2, "es": 3}}}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = quality_rules.judged(read_documents(spark, sf_dir), _labels(spark, sf_dir), "quality")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(read_documents(spark, sf_dir), width=2)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.chosen(read_documents(spark, sf_dir), **MIX)


def op4_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.judged(read_documents(spark, sf_dir).select("doc_id", "text"))
    return found.selectExpr(
        "carried AS doc_id", *(f"CAST(size(filter(base, z -> z.kind = '{k}')) AS BIGINT) AS n_{k}" for k in personal_data.PATTERNS),
        f"sha2({personal_data.joined('base')}, 256) AS base_sha256", f"{personal_data.joined('spans')} AS spans")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    model = quality_classifier.train(docs, _labels(spark, sf_dir).where(LEARNED), "quality")
    return quality_classifier.scored(docs, model).selectExpr(
        "doc_id", f"NOT ({LEARNED}) AS held_out", "score", f"CAST(score >= {quality_classifier.THRESHOLD}D AS INT) AS predicted")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(read_documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PRE_SPLIT)
    joined = "array_join(transform({}, z -> concat_ws(':', z.kind, z.start, z.end)), ',')"
    return found.selectExpr(
        "doc_id", *(f"CAST(size(filter(spans, z -> z.kind = '{k}')) AS BIGINT) AS n_{k}" for k in secrets.KINDS[:3]),
        f"sha2({joined.format(f"filter(spans, z -> z.kind <> 'random')")}, 256) AS base_sha256", f"{joined.format('spans')} AS spans")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(read_documents(spark, sf_dir)).withColumns(
        {c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, order = token_counts.write_token_files(
        read_documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PRE_SPLIT, END_OF_DOCUMENT)
    counts = token_counts.counted(blocks, END_OF_DOCUMENT)
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(read_documents(spark, sf_dir))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_documents(spark, sf_dir))


def encoded(docs: DataFrame) -> DataFrame:
    """Digests of the tokens of every text and of what they decode to."""
    return bpe.encoded(docs, f"{TOKENIZERS}/word_bpe_49k.json").selectExpr(
        "doc_id", "CAST(size(ids) AS BIGINT) AS n_tokens", "sha2(array_join(ids, ' '), 256) AS ids_sha256",
        "sha2(decoded, 256) AS decoded_sha256")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, _labels(spark, sf_dir).where(LEARNED), "toxic")
    return toxicity.scored(docs, model).selectExpr(
        "doc_id", f"NOT ({LEARNED}) AS held_out", "score", f"CAST(score >= {toxicity.THRESHOLD}D AS INT) AS predicted")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.repaired(rows, absent="absent", keep_lines=False)[0]


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books, _ = vector_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return vector_codes.with_label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality_rules, op2_minhash_forest, op3_source_mixing, op4_pii_sanitise, op5_quality_classifier,
    op6_secret_scan, op7_license_scan, op8_token_counts, op9_exact_dedup, op10_bpe_codec, op11_toxicity, op12_conversation_repair,
    op13_vector_codes)}


def build() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
