"""Statistical target ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.scores import (
    classification_score,
    regression_score,
    task_by_statistics,
    task_by_type,
)
from tabscope.functions.text import has_id_marker
from tabscope.operators.order import monotonicity
from tabscope.operators.profile import profile

RANKING_COLUMNS = [
    "ordinal", "column", "kind", "missing_ratio", "n_unique", "monotonicity", "dominance", "entropy_norm",
    "regression_score", "classification_score", "candidate_score", "reject_id_like", "reject_temporal", "reject",
    "task_statistical", "task_by_type",
]


def kind() -> Column:
    """numeric (booleans too), temporal or categorical.

    Text is temporal when one format parses every value, also when it has no value at all.
    """
    temporal = F.expr("declared_type IN ('date', 'timestamp', 'timestamp_ntz') OR coalesce(all_dates, false)")
    return F.when(F.col("is_numeric_like"), "numeric").when(temporal, "temporal").otherwise("categorical")


def ranking_scores(df: DataFrame, order_by: Sequence[str] | str | None = None, prof: DataFrame | None = None) -> DataFrame:
    """Unsorted ranking rows with unrounded statistics."""
    prof = profile(df) if prof is None else prof
    steps = monotonicity(df, order_by).select("ordinal", F.col("monotonicity").alias("steps"))
    # One row per numeric column.
    joined = prof.withColumn("kind", kind()).join(F.broadcast(steps), "ordinal", "left")
    n_present = F.col("n_rows") - F.col("n_missing")
    # Steps of a boolean column count as flips, all of which are level or up.
    mono = F.when(F.col("is_boolean"), F.when(n_present >= 3, 1.0).otherwise(0.0)).otherwise(F.coalesce("steps", F.lit(0.0)))
    numeric, categorical = F.col("kind") == "numeric", F.col("kind") == "categorical"
    stats = joined.withColumns({
        "monotonicity": F.when(numeric, mono),
        # A column without values counts as fully dominated and without entropy; NULL says not computed (approximate profile).
        "dominance": F.when(categorical, F.when(n_present > 0, F.col("dominance")).otherwise(1.0)),
        "entropy_norm": F.when(categorical, F.when(n_present > 0, F.col("entropy")).otherwise(0.0))})
    scored = stats.withColumns({
        "regression_score": F.when(numeric, regression_score(
            F.col("std"), F.col("missing_ratio"), F.col("n_unique"), F.col("monotonicity"), F.col("n_rows"))),
        "classification_score": F.when(categorical, classification_score(
            F.col("n_unique"), F.col("n_rows"), F.col("missing_ratio"), F.col("dominance"), F.col("entropy_norm"))),
        "reject_id_like": has_id_marker(F.col("column")) | (
            F.col("n_unique") >= 0.9 * F.greatest(F.col("n_rows"), F.lit(1))),
        "reject_temporal": F.col("kind") == "temporal",
        "task_statistical": task_by_statistics(F.col("kind"), F.col("is_boolean"), F.col("n_unique"), F.col("n_rows"),
                                               F.col("integer_share")),
        "task_by_type": task_by_type(F.col("is_numeric_like"))})
    return scored.withColumns({
        "candidate_score": F.greatest("regression_score", "classification_score"),
        "reject": F.col("reject_id_like") | F.col("reject_temporal")}).select(*RANKING_COLUMNS)


def ranked(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.asc("reject"), F.desc_nulls_last("candidate_score"), "ordinal")


def target_ranking(df: DataFrame, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """All columns, best target first; statistics are shown to 4 places, scores come from unrounded ones."""
    shown = ranking_scores(df, order_by)
    for c in ("missing_ratio", "monotonicity", "dominance", "entropy_norm"):
        shown = shown.withColumn(c, F.round(c, 4))
    return ranked(shown)


def ranking_pick(scores: DataFrame) -> DataFrame:
    """First non-rejected column, the first rejected one when there is no other."""
    return ranked(scores).limit(1)


def task_types(df: DataFrame) -> DataFrame:
    """Task of each column as a target under both rules."""
    prof = profile(df).withColumn("kind", kind())
    return prof.select(
        "ordinal", "column", "kind",
        task_by_statistics(F.col("kind"), F.col("is_boolean"), F.col("n_unique"), F.col("n_rows"), F.col("integer_share"))
        .alias("task_statistical"),
        task_by_type(F.col("is_numeric_like")).alias("task_by_type"))
