"""Heuristic target scores over a profile: name, type and quality add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.scores import REJECTED_TYPES, quality_score, type_score
from tabscope.functions.text import has_id_marker, name_score


def name_scores(names: DataFrame) -> DataFrame:
    """Add ``name_score`` and ``id_marker`` to a relation with a ``column`` column."""
    return names.withColumns({"name_score": name_score(F.col("column")), "id_marker": has_id_marker(F.col("column"))})


def heuristic_scores(prof: DataFrame) -> DataFrame:
    """One row per column: the three scores, their total and the facts behind them."""
    parts = prof.select(
        "ordinal", "column",
        name_score(F.col("column")).alias("name_score"),
        type_score(F.col("semantic_type")).alias("type_score"),
        quality_score(F.col("semantic_type"), F.col("n_rows"), F.col("n_unique"), F.col("missing_ratio"),
                      F.col("is_unique"), F.col("is_constant")).alias("quality_score"),
        "n_unique", "missing_ratio", "semantic_type", "is_unique", "is_constant")
    return parts.withColumn("total", F.expr("name_score + type_score + quality_score"))


def eligible() -> Column:
    """Columns that may be a target: they vary and are neither dates nor of unknown type."""
    return ~F.col("is_constant") & (F.col("n_unique") >= 2) & ~F.col("semantic_type").isin(REJECTED_TYPES)


def ranked_scores(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("total"), "ordinal")


def top_candidates(scores: DataFrame, n: int = 5) -> DataFrame:
    return ranked_scores(scores).limit(n)


def heuristic_pick(scores: DataFrame) -> DataFrame:
    """The best eligible column, also when its total is negative; no row when none is eligible."""
    return ranked_scores(scores.where(eligible())).limit(1)
