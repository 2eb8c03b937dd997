"""Target suggestions that arrive as text responses in a column.

A response is JSON with ``target``, ``confidence`` and ``reason``, possibly inside a code fence
or, when the whole text is not JSON, somewhere in prose as a flat ``{...}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.scores import REJECTED_TYPES
from tabscope.functions.values import reference, stripped

FENCE = "```"


def parsed_suggestions(responses: DataFrame, column: str = "response") -> DataFrame:
    """Add ``target``, ``confidence``, ``reason`` and ``parse_status``.

    Status: ``ok``, ``no_json``, ``no_object``, ``bad_confidence`` (neither absent nor a number),
    ``no_target`` or ``bad_target`` (no string). Fields are NULL unless the status is ``ok``.
    """
    text = F.expr(stripped(reference(column)))
    bare = F.when(
        text.startswith(FENCE),
        F.expr(stripped("replace(replace(_text, '```json', ''), '```', '')"))).otherwise(F.col("_text"))
    whole = F.try_parse_json("_bare")
    inner = F.try_parse_json(F.regexp_extract("_bare", r"\{[^{}]*\}", 0))
    parsed = responses.withColumn("_text", text).withColumn("_bare", bare)
    parsed = parsed.withColumn("_json", F.when(whole.isNotNull(), whole).otherwise(inner))

    def shape(path: str) -> Column:
        return F.expr(f"schema_of_variant(try_variant_get(_json, '{path}', 'variant'))")

    parsed = parsed.withColumns({"_root": F.expr("schema_of_variant(_json)"), "_target": shape("$.target"),
                                 "_conf": shape("$.confidence")})
    numeric = F.col("_conf").isNull() | F.col("_conf").rlike("^(BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL)")
    name = F.expr("try_variant_get(_json, '$.target', 'string')")
    empty = F.col("_target").isNull() | (F.col("_target") == "VOID") | (name == "")
    status = (
        F.when(F.col("_json").isNull(), "no_json")
        .when(~F.col("_root").startswith("OBJECT"), "no_object")
        .when(~numeric, "bad_confidence")
        .when(empty, "no_target")
        .when(F.col("_target") != "STRING", "bad_target")
        .otherwise("ok")
    )
    parsed = parsed.withColumn("parse_status", status)
    ok = F.col("parse_status") == "ok"
    confidence = F.coalesce(F.expr("try_variant_get(_json, '$.confidence', 'double')"), F.lit(0.0))
    reason = F.coalesce(F.expr("try_variant_get(_json, '$.reason', 'string')"), F.lit("no reason given"))
    return parsed.withColumns({
        "target": F.when(ok, name), "confidence": F.when(ok, confidence), "reason": F.when(ok, reason),
    }).drop("_text", "_bare", "_json", "_root", "_target", "_conf")


def checked_suggestions(parsed: DataFrame, prof: DataFrame) -> DataFrame:
    """Add ``accepted`` and ``verdict`` by looking the suggested column up in a profile."""
    known = prof.select(F.col("column").alias("_column"), "ordinal", "is_constant", "n_unique", "semantic_type")
    # One row per column of the profiled table.
    joined = parsed.join(F.broadcast(known), F.col("target") == F.col("_column"), "left")
    verdict = (
        F.when(F.col("parse_status") != "ok", F.col("parse_status"))
        .when(F.col("_column").isNull(), "unknown_column")
        .when(F.col("is_constant"), "constant")
        .when(F.col("n_unique") < 2, "too_few_values")
        .when(F.col("semantic_type").isin(REJECTED_TYPES), "wrong_type")
        .otherwise("accepted")
    )
    return joined.withColumn("verdict", verdict).withColumn("accepted", F.col("verdict") == "accepted") \
        .drop("_column", "is_constant", "n_unique", "semantic_type")
