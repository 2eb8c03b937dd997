"""Column profile: one row per column of a table.

Two kinds of pass over the data, joined on the column ordinal. The first is a plain
aggregation without a shuffle of rows (counts, ranges, spread); the second is the value
frequency relation of :mod:`tabscope.operators.frequencies`.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions import text as tx
from tabscope.functions.scores import MAX_CLASSES
from tabscope.functions.values import (
    INTEGRAL,
    TEMPORAL,
    TEXTUAL,
    FRACTIONAL,
    as_double,
    grouping_value,
    integer_share,
    is_missing,
    is_numeric,
    is_numeric_like,
    positional,
    present,
    quoted,
    rendered,
    rendered_time,
)
from tabscope.operators.frequencies import STATS_SCHEMA, families, frequency_stats, most_frequent, unpivoted

# Columns aggregated in one plan; more would leave generated code for the interpreter.
COLUMNS_PER_PASS = 40

PROFILE_COLUMNS = [
    "ordinal", "column", "declared_type", "semantic_type", "n_rows", "n_unique", "unique_ratio", "is_unique",
    "n_missing", "missing_ratio", "is_constant", "example", "min_value", "max_value", "datetime_parse_rate",
    "min_numeric", "max_numeric", "std", "integer_share", "dominance", "entropy", "all_dates", "is_boolean",
    "is_numeric_like",
]


def _declared_class(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, TEMPORAL):
        return "datetime"
    if isinstance(data_type, INTEGRAL):
        return "integer"
    if isinstance(data_type, FRACTIONAL):
        return "float"
    if is_numeric(data_type):
        return "numeric"
    return "text" if isinstance(data_type, TEXTUAL) else "unknown"


def _fits_hash_aggregate(data_type: T.DataType) -> bool:
    """Types whose first value can be kept in a fixed-width aggregation buffer."""
    return isinstance(data_type, (*INTEGRAL, *FRACTIONAL, *TEMPORAL, T.BooleanType))


def _pass_one_cell(ordinal: int, field: T.StructField) -> str:
    data_type = field.dataType
    ref = f"c{ordinal}"
    value = present(ref, data_type)
    low_text = high_text = example = "CAST(NULL AS STRING)"
    low = high = std = whole = "CAST(NULL AS DOUBLE)"
    if is_numeric(data_type):
        double = as_double(ref, data_type)
        low_text, high_text = f"CAST(min({value}) AS STRING)", f"CAST(max({value}) AS STRING)"
        low, high = f"min({double})", f"max({double})"
        whole = "1D" if isinstance(data_type, INTEGRAL) else integer_share(double)
    elif isinstance(data_type, TEMPORAL):
        low_text, high_text = rendered_time(f"min({ref})"), rendered_time(f"max({ref})")
    if is_numeric_like(data_type):
        std = f"stddev_samp({as_double(ref, data_type)})"
    if _fits_hash_aggregate(data_type):
        example = rendered(f"first({value}, true)", data_type)
    return (
        f"named_struct('ordinal', {ordinal}, 'n_rows', count(1), 'n_missing', count_if({is_missing(ref, data_type)}), "
        f"'min_value', {low_text}, 'max_value', {high_text}, 'min_numeric', {low}, 'max_numeric', {high}, "
        f"'std', {std}, 'integer_share', {whole}, 'example', {example})"
    )


def pass_one(df: DataFrame) -> DataFrame:
    """Counts, ranges and spread of every column, one row per column."""
    fields = df.schema.fields
    data = positional(df)
    parts = []
    for start in range(0, len(fields), COLUMNS_PER_PASS):
        chunk = range(start, min(start + COLUMNS_PER_PASS, len(fields)))
        cells = ", ".join(_pass_one_cell(i, fields[i]) for i in chunk)
        parts.append(data.agg(F.expr(f"array({cells}) AS cells")).select(F.inline("cells")))
    return reduce(DataFrame.unionByName, parts)


def examples(df: DataFrame, order_by: str | None = None) -> DataFrame | None:
    """(ordinal, example) where pass one gives none: first value in ``order_by``, else of any partition."""
    fields = df.schema.fields
    data = positional(df)
    if order_by is not None:
        key = f"c{df.columns.index(order_by)}"
        cells = ", ".join(
            f"named_struct('ordinal', {i}, 'first_value', " + rendered(
                f"min_by({present(f'c{i}', f.dataType)}, CASE WHEN NOT {is_missing(f'c{i}', f.dataType)} THEN {key} END)",
                f.dataType) + ")"
            for i, f in enumerate(fields))
        return data.agg(F.expr(f"array({cells}) AS cells")).select(F.inline("cells"))
    # A limit of one stops each task at its first value: next to nothing is read.
    parts = [
        data.where(f"c{i} IS NOT NULL").selectExpr(f"{i} AS ordinal", f"{rendered(f'c{i}', f.dataType)} AS first_value").limit(1)
        for i, f in enumerate(fields) if not _fits_hash_aggregate(f.dataType)
    ]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _schema_facts(fields: Sequence[T.StructField]) -> Column:
    """What the schema says, as an array indexed by ordinal."""
    facts = [{
        "column": f.name, "declared_type": f.dataType.simpleString(), "declared_class": _declared_class(f.dataType),
        "is_numeric_like": is_numeric_like(f.dataType)} for f in fields]
    shape = "array<struct<column:string, declared_type:string, declared_class:string, is_numeric_like:boolean>>"
    return F.from_json(F.lit(json.dumps(facts)), shape)


# Text is looked at: boolean words, then dates, then few values against many.
SEMANTIC_TYPE = f"""
    CASE WHEN fact.declared_class != 'text' THEN fact.declared_class
         WHEN coalesce(boolean_share, 0D) >= {tx.BOOLEAN_SHARE}D THEN 'boolean'
         WHEN coalesce(parse_rate, 0D) >= {tx.DATE_SHARE}D THEN 'datetime'
         WHEN n_rows = 0 THEN 'unknown'
         WHEN n_unique <= {MAX_CLASSES} OR n_unique / n_rows <= 0.05D THEN 'categorical'
         ELSE 'text' END
"""


def profile(df: DataFrame, order_by: str | None = None, exact: bool = True, rsd: float = 0.02) -> DataFrame:
    """One row per column with :data:`PROFILE_COLUMNS`.

    ``order_by`` makes ``example`` the first value in that order; without it any non-missing
    value may be shown. ``exact=False`` replaces distinct counts by estimates wherever no rule
    can turn on the difference (see :func:`undecided`); dominance and entropy are then NULL for
    the estimated columns.
    """
    if not df.columns:
        raise ValueError("the table has no columns")
    fields = df.schema.fields
    base = pass_one(df)
    estimates: dict[int, int] = {}
    if exact:
        stats = frequency_stats(df)
    else:
        # One number per column: a small, bounded result on which the plan depends.
        n_rows = df.count()
        estimates = {i: e for i, e in estimated_distinct(df, rsd).items() if not undecided(e, n_rows, rsd)}
        rough = frozenset(i for i in estimates if isinstance(fields[i].dataType, TEXTUAL))
        wanted = [i for i in range(len(fields)) if i not in estimates or i in rough]
        if wanted:
            stats = frequency_stats(df, wanted, rough)
        else:
            stats = df.sparkSession.createDataFrame([], STATS_SCHEMA)
    # One row per column on every side: bounded by the width of the table, not by its rows.
    joined = base.join(F.broadcast(stats), "ordinal", "left")
    first = examples(df, order_by)
    if first is None:
        joined = joined.withColumn("first_value", F.lit(None).cast("string"))
    else:
        joined = joined.join(F.broadcast(first), "ordinal", "left")
    if estimates:
        known = F.create_map(*[F.lit(v) for pair in estimates.items() for v in pair])[F.col("ordinal")]
        joined = joined.withColumns({
            "n_unique": F.coalesce(known.cast("bigint"), "n_unique"),
            "dominance": F.when(known.isNull(), F.col("dominance")),
            "entropy": F.when(known.isNull(), F.col("entropy"))})
    return _finished(joined, fields, order_by is not None)


def _finished(joined: DataFrame, fields: Sequence[T.StructField], ordered: bool) -> DataFrame:
    known = joined.withColumns({
        "fact": _schema_facts(fields)[F.col("ordinal")],
        "n_unique": F.expr("CAST(coalesce(n_unique, 0) AS BIGINT)")})
    known = known.withColumn("semantic_type", F.expr(SEMANTIC_TYPE))
    parsed = "fact.declared_class = 'text' AND semantic_type = 'datetime'"
    low, high = (f"CASE WHEN {parsed} THEN {rendered_time(f'parsed_{e}', '+00:00')} ELSE {e}_value END AS {e}_value"
                 for e in ("min", "max"))
    return known.selectExpr(
        "ordinal", "fact.column AS column", "fact.declared_type AS declared_type", "semantic_type", "n_rows", "n_unique",
        "coalesce(try_divide(CAST(n_unique AS DOUBLE), n_rows), 0D) AS unique_ratio",
        "n_missing = 0 AND n_unique = n_rows AS is_unique",
        "n_missing",
        "coalesce(try_divide(CAST(n_missing AS DOUBLE), n_rows), 0D) AS missing_ratio",
        "n_unique = 1 OR (n_unique = 0 AND n_missing > 0) AS is_constant",
        "first_value AS example" if ordered else "coalesce(example, first_value) AS example",
        low, high,
        "CASE WHEN fact.declared_class = 'text' AND semantic_type != 'boolean' THEN coalesce(parse_rate, 0D) END "
        "AS datetime_parse_rate",
        "min_numeric", "max_numeric", "std",
        "CASE WHEN n_missing < n_rows THEN integer_share END AS integer_share",
        "dominance", "entropy",
        "CASE WHEN fact.declared_class = 'text' THEN coalesce(all_dates, true) END AS all_dates",
        "fact.declared_class = 'boolean' AS is_boolean", "fact.is_numeric_like AS is_numeric_like",
    )


def estimated_distinct(df: DataFrame, rsd: float) -> dict[int, int]:
    """Estimated distinct count per ordinal: one sketch per column, no shuffle of values."""
    fields = df.schema.fields
    out = dict.fromkeys(range(len(fields)), 0)
    for (family, _), members in families(df).items():
        def cell(i: int) -> str:
            ref, data_type = f"c{i}", fields[i].dataType
            return rendered(ref, data_type) if family == "string" else grouping_value(ref, data_type)

        counts = unpivoted(df, {i: cell(i) for i in members}).groupBy("ordinal").agg(
            F.approx_count_distinct("value", rsd).alias("estimate"))
        out.update({r.ordinal: r.estimate for r in counts.collect()})
    return out


def undecided(estimate: int, n_rows: int, rsd: float) -> bool:
    """Could an error of 3 * rsd move the column across a threshold of any rule?

    Thresholds: constant and binary columns, class limits (10, 20, 50, 0.05 n, 0.3 n) and
    identifier limits (0.9 n, n). Small counts are always taken exactly.
    """
    if estimate <= 2 * MAX_CLASSES:
        return True
    return any(abs(estimate - mark) <= 3 * rsd * mark for mark in (s * n_rows for s in (0.05, 0.3, 0.9, 1.0)))


# --- reading a profile -----------------------------------------------------------------------


def key_candidates(prof: DataFrame) -> DataFrame:
    """Columns without missing values in which every row differs."""
    return prof.where(F.col("is_unique") & (F.col("missing_ratio") == 0)).select("ordinal", "column")


def with_many_missing(prof: DataFrame, over: float = 0.1) -> DataFrame:
    return prof.where(F.col("missing_ratio") > over)


def notes(prof: DataFrame) -> DataFrame:
    """(ordinal, column, kind, note): remarks on missing values, constants and broken identifiers."""
    name = F.col("column")
    remarks = F.array(
        F.when(F.col("missing_ratio") >= 0.3, F.struct(
            F.lit("missing").alias("kind"),
            F.format_string("Column '%s' has a high share of missing values: %.1f%%.", name,
                            100 * F.col("missing_ratio")).alias("note"))),
        F.when(F.col("is_constant"), F.struct(
            F.lit("constant").alias("kind"),
            F.format_string("Column '%s' is constant.", name).alias("note"))),
        F.when(F.lower(name).isin(tx.ID_NOTE_NAMES) & ~F.col("is_unique"), F.struct(
            F.lit("identifier").alias("kind"),
            F.format_string("Column '%s' looks like an identifier but is not unique.", name).alias("note"))),
    )
    kept = F.filter(remarks, lambda r: r.isNotNull())
    return prof.select("ordinal", "column", F.explode(kept).alias("r")).select("ordinal", "column", "r.kind", "r.note")


def table_profile(prof: DataFrame) -> DataFrame:
    """One row for the table: size, columns as a map, key candidates and notes."""
    ordered = F.array_sort(F.collect_list(F.when(
        F.col("is_unique") & (F.col("missing_ratio") == 0), F.struct("ordinal", "column"))))
    rank = F.expr("array_position(array('missing', 'constant', 'identifier'), kind) AS rank")
    remarks = notes(prof).agg(F.array_sort(F.collect_list(F.struct("ordinal", rank, "note"))).alias("r"))
    details = [c for c in PROFILE_COLUMNS if c not in ("ordinal", "n_rows")]
    table = prof.agg(
        F.first("n_rows").alias("n_rows"),
        F.count(F.lit(1)).cast("int").alias("n_cols"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", F.struct(*details))))).alias("columns"),
        F.transform(ordered, lambda x: x["column"]).alias("primary_key_candidates"),
    )
    # Exactly one row on each side.
    joined = table.withColumn("one", F.lit(1)).join(F.broadcast(remarks.withColumn("one", F.lit(1))), "one")
    return joined.select("n_rows", "n_cols", "columns", "primary_key_candidates",
                         F.transform("r", lambda x: x["note"]).alias("notes"))


def profile_json(prof: DataFrame) -> DataFrame:
    """The table profile as one JSON document."""
    return table_profile(prof).select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("profile"))


def profile_table(prof: DataFrame) -> DataFrame:
    """Summary of a profile, values of mixed type rendered as text."""
    return prof.select("ordinal", "column", "declared_type", "semantic_type", "n_unique", "unique_ratio", "is_unique",
                       "n_missing", "missing_ratio", "is_constant", "min_value", "max_value", "datetime_parse_rate",
                       "example")


def sorted_profile(prof: DataFrame, metric: str) -> DataFrame:
    return prof.orderBy(quoted(metric).desc_nulls_last(), "ordinal")


def column_type(prof: DataFrame, column: str) -> DataFrame:
    return prof.where(F.col("column") == column).select("semantic_type")


def profile_digest(prof: DataFrame, max_columns: int = 60, max_name: int = 60) -> DataFrame:
    """(ordinal, line): short text per column; columns beyond the limit share one closing line."""
    short = F.when(F.length("column") > max_name, F.concat(F.substring("column", 1, max_name), F.lit("…"))) \
        .otherwise(F.col("column"))

    def flag(name: str) -> Column:
        return F.initcap(F.col(name).cast("string"))

    line = F.format_string("- %s | type=%s | n_unique=%d | missing_ratio=%.2f | is_unique=%s | is_constant=%s",
                           short, F.col("semantic_type"), F.col("n_unique"), F.col("missing_ratio"),
                           flag("is_unique"), flag("is_constant"))
    shown = prof.where(F.col("ordinal") < max_columns).select("ordinal", line.alias("line"))
    over = prof.where(F.col("ordinal") >= max_columns).agg(F.count(F.lit(1)).alias("k")).where("k > 0")
    rest = over.select(F.lit(max_columns).alias("ordinal"), F.format_string("... (+%d more)", F.col("k")).alias("line"))
    return shown.unionByName(rest)


def column_preview(df: DataFrame, column: str) -> DataFrame:
    """One row on one column: type, counts, range to 2 places or most frequent value, task by type."""
    data_type = df.schema[column].dataType
    numeric = is_numeric_like(data_type)
    one = df.select(quoted(column).alias("c0"))
    stats = profile(df.select(quoted(column))).select(
        F.lit(column).alias("column"), "declared_type", "n_unique", "n_missing",
        F.round(100 * F.col("missing_ratio"), 1).alias("missing_percent"),
        F.round("min_numeric", 2).alias("min"), F.round("max_numeric", 2).alias("max"),
        F.lit("regression" if numeric else "classification").alias("task"))
    if numeric:
        return stats.withColumn("mode", F.lit(None).cast("string"))
    mode = most_frequent(one.withColumnRenamed("c0", column), [column]).select("column", F.col("value").alias("mode"))
    return stats.join(F.broadcast(mode), "column", "left").fillna("none", subset=["mode"])
