"""Choosing the target: user choice, then suggestion, then score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.operators.heuristics import eligible
from tabscope.operators.suggestions import checked_suggestions

DECISION = "priority int, total double, ordinal int, target string, source string, reason string"


def checked_choices(prof: DataFrame, choices: DataFrame) -> DataFrame:
    """Validate a relation with a ``choice`` column against a profile: adds ``ordinal``, ``accepted``, ``reason``."""
    known = prof.select(F.col("column").alias("_column"), "ordinal", "is_constant", "n_unique")
    joined = choices.join(F.broadcast(known), F.col("choice") == F.col("_column"), "left")
    reason = (
        F.when(F.col("choice").isNull() | (F.col("choice") == ""), "no choice given")
        .when(F.col("_column").isNull(), F.format_string("column '%s' does not exist", "choice"))
        .when(F.col("is_constant") | (F.col("n_unique") < 2),
              F.format_string("column '%s' is constant or has fewer than 2 values", "choice"))
        .otherwise("chosen by the user")
    )
    return joined.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "chosen by the user") \
        .drop("_column", "is_constant", "n_unique")


def choose_target(prof: DataFrame, scores: DataFrame, user_choice: str | None = None,
                  suggestions: DataFrame | None = None, only_heuristics: bool = False) -> DataFrame:
    """One-row decision ``(target, source, reason)``.

    ``suggestions`` is a parsed relation (see :mod:`tabscope.operators.suggestions`); of several
    accepted ones the most confident wins, then the first column. ``only_heuristics`` skips both
    the user choice and the suggestions. The last candidate is the answer "none".
    """
    spark = prof.sparkSession
    picked = scores.where(eligible()).selectExpr(
        "3 AS priority", "total", "ordinal", "column AS target", "'heuristics' AS source",
        "'picked by name, type and quality' AS reason")
    candidates = [picked]
    refusal = F.lit("no choice given")
    chosen = spark.range(1).select(F.lit(user_choice).cast("string").alias("choice"))
    if not only_heuristics:
        checked = checked_choices(prof, chosen)
        candidates.append(checked.where("accepted").selectExpr(
            "1 AS priority", "0D AS total", "ordinal", "choice AS target", "'user_choice' AS source", "reason"))
        if suggestions is not None:
            accepted = checked_suggestions(suggestions, prof).where("accepted")
            candidates.append(accepted.selectExpr(
                "2 AS priority", "confidence AS total", "ordinal", "target", "'suggestion' AS source",
                "'suggested column' AS reason"))
        nothing = checked.select(F.concat(F.lit("no suitable column; "), "reason").alias("reason"))
    else:
        nothing = chosen.select(F.concat(F.lit("no suitable column; "), refusal).alias("reason"))
    candidates.append(nothing.selectExpr(
        "9 AS priority", "0D AS total", "-1 AS ordinal", "CAST(NULL AS STRING) AS target", "'none' AS source", "reason"))
    everything = candidates[0]
    for more in candidates[1:]:
        everything = everything.unionByName(more)
    first = everything.orderBy("priority", F.desc_nulls_last("total"), "ordinal").limit(1)
    return first.select("target", "source", "reason")


def choose_by_ranking(scores: DataFrame, user_choice: str | None = None, suggestion: str | None = None) -> DataFrame:
    """One-row decision ``(target, source, task)`` over ranking rows.

    A named column only has to exist. Otherwise the first row of the ranking wins, rejected or not.
    """
    named = F.when(F.col("column") == F.lit(user_choice), 1).when(F.col("column") == F.lit(suggestion), 2).otherwise(3)
    first = scores.withColumn("priority", named).orderBy(
        "priority", F.asc("reject"), F.desc_nulls_last("candidate_score"), "ordinal").limit(1)
    source = F.when(F.col("priority") == 1, "user_choice").when(F.col("priority") == 2, "suggestion").otherwise("ranking")
    return first.select(F.col("column").alias("target"), source.alias("source"), F.col("task_statistical").alias("task"))
