"""Value frequencies of all columns and the statistics that follow from them.

``V(ordinal, value, cnt)`` holds one row per column and distinct value. It is built once per
*grouping family* (whole numbers, doubles, timestamps, text), so values keep their Spark type
through the shuffle, map-side partial aggregation folds a hot value into one row per task, and
every family reads only its own columns.

``F(ordinal, cnt, mult)`` counts how many values of a column occur ``cnt`` times. Distinct
count, dominance and entropy need nothing else, and a column of N cells has fewer than
sqrt(2N) different frequencies, so what is left per column after this second, map-side
combined aggregation is small whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions import text as tx
from tabscope.functions.scores import LOG_FLOOR
from tabscope.functions.values import (
    DIGEST_OVER,
    TEXTUAL,
    grouping_family,
    grouping_value,
    positional,
    reference,
    rendered,
)

STATS_SCHEMA = (
    "ordinal int, n_unique bigint, dominance double, entropy double, boolean_share double, "
    "parse_rate double, all_dates boolean, parsed_min timestamp, parsed_max timestamp"
)
FORMATS = range(len(tx.DATE_FORMATS))


def families(df: DataFrame, ordinals: Sequence[int] | None = None) -> dict[tuple[str, bool], list[int]]:
    """Ordinals per (grouping family, holds text that may be dates or boolean words)."""
    wanted = range(len(df.columns)) if ordinals is None else ordinals
    out: dict[tuple[str, bool], list[int]] = {}
    for i in wanted:
        data_type = df.schema.fields[i].dataType
        out.setdefault((grouping_family(data_type), isinstance(data_type, TEXTUAL)), []).append(i)
    return out


def unpivoted(df: DataFrame, cells: dict[int, str]) -> DataFrame:
    """(ordinal, value): one row per non-NULL cell; ``cells`` are expressions over ``positional(df)``."""
    pairs = ", ".join(f"named_struct('ordinal', {i}, 'value', {cell})" for i, cell in cells.items())
    return positional(df).selectExpr(f"inline(array({pairs}))").where("value IS NOT NULL")


def value_frequencies(df: DataFrame, ordinals: Sequence[int], rough: frozenset[int] = frozenset()) -> DataFrame:
    """V for columns of one grouping family.

    Columns in ``rough`` need no exact distinct count: of those, only values that bear on the
    date and boolean rules stay apart and all others share one row.
    """
    fields = df.schema.fields
    cells = {}
    for i in ordinals:
        ref = f"c{i}"
        cells[i] = grouping_value(ref, fields[i].dataType)
        if isinstance(fields[i].dataType, TEXTUAL):  # a digest does not show the word, so it is marked
            cells[i] = f"CASE WHEN length({ref}) > {DIGEST_OVER} AND {tx.is_boolean_token(ref)} THEN concat({cells[i]}, '!') ELSE {cells[i]} END"
        if i in rough:
            telling = f"{tx.is_boolean_token(ref)} OR {tx.looks_like_date(ref)}"
            cells[i] = f"CASE WHEN {ref} IS NULL THEN NULL WHEN {telling} THEN {cells[i]} ELSE '' END"
    return unpivoted(df, cells).groupBy("ordinal", "value").agg(F.expr("count(1) AS cnt"))


def frequency_counts(values: DataFrame, with_text_rules: bool) -> DataFrame:
    """F(ordinal, cnt, reading, shape, mult).

    Every value counts once under reading -1. Text that parses as a date counts again under each
    listed format that reads it, else under its shape, month first and day first, with the earliest and
    latest date; reading -1 also counts boolean words.
    """
    if not with_text_rules:
        return values.groupBy("ordinal", "cnt").agg(F.expr("count(1) AS mult"))
    listed = [f"named_struct('reading', {j}, 'shape', '', 'date', {tx.parsed_date('value', j)})" for j in FORMATS]
    shaped = [f"named_struct('reading', {j}, 'shape', form, 'date', {name})" for j, name in ((tx.MONTH_FIRST, "month_first"), (tx.DAY_FIRST, "day_first"))]
    plain = "named_struct('reading', -1, 'shape', '', 'date', CAST(NULL AS TIMESTAMP))"
    told = values.selectExpr(
        "ordinal", "cnt", "value", f"({tx.is_boolean_token('value')} OR length(value) > {DIGEST_OVER} AND endswith(value, '!')) AS word",
        f"{tx.looks_like_date('value')} AS near")
    for step in tx.date_steps("value", "near"):
        told = told.selectExpr("*", *(f"{expression} AS {name}" for name, expression in step.items()))
    dates = (f"CASE WHEN near AND shape IS NULL THEN array({plain}, {', '.join(listed)}) "
             f"WHEN form IS NOT NULL THEN array({plain}, {', '.join(shaped)}) ELSE array({plain}) END")
    # The shapes that pass are few, whatever the values: the grammar is finite.
    read = told.selectExpr("ordinal", "cnt", "word", f"inline({dates})").where("reading = -1 OR date IS NOT NULL")
    return read.groupBy("ordinal", "cnt", "reading", "shape").agg(
        F.expr("count(1) AS mult"), F.expr("count_if(word AND reading = -1) AS words"),
        F.expr("min(date) AS earliest"), F.expr("max(date) AS latest"))


def _grouped(df: DataFrame, keys: list[str], aggregates: list[str]) -> DataFrame:
    named = ", ".join(aggregates)
    return df.groupBy(*keys).agg(F.expr(f"struct({named}) AS s")).select(*keys, "s.*")


def _column_stats(counts: DataFrame, with_text_rules: bool) -> DataFrame:
    every = "reading = -1" if with_text_rules else "true"
    sized = counts.selectExpr("*", f"sum(CASE WHEN {every} THEN cnt * mult END) OVER (PARTITION BY ordinal) AS n_present")
    share = "(cnt / n_present)"
    keys = ["ordinal", "n_present", "reading", "shape"] if with_text_rules else ["ordinal", "n_present"]
    aggregates = ["sum(mult) AS n_unique", f"max({share}) AS dominance",
                  f"sum(-mult * {share} * log2({share} + {LOG_FLOOR!r}D)) AS bits"]
    if with_text_rules:
        aggregates += ["sum(cnt * words) / first(n_present) AS boolean_share", "sum(cnt * mult) / first(n_present) AS rate",
                       "min(earliest) AS earliest", "max(latest) AS latest"]
    stats = _grouped(sized, keys, aggregates)
    entropy = f"CASE WHEN n_unique > 1 THEN bits / (log2(n_unique) + {LOG_FLOOR!r}D) ELSE 0D END AS entropy"
    if not with_text_rules:
        return stats.selectExpr(
            "ordinal", "n_unique", "dominance", entropy, "CAST(NULL AS DOUBLE) AS boolean_share",
            "CAST(NULL AS DOUBLE) AS parse_rate", "CAST(NULL AS BOOLEAN) AS all_dates",
            "CAST(NULL AS TIMESTAMP) AS parsed_min", "CAST(NULL AS TIMESTAMP) AS parsed_max")
    # At most one row per format and shape is left. The first listed format that reads enough values wins, else the shape and
    # order that read most; of equal ones the month comes first.
    rank = (f"struct(least(reading, {tx.MONTH_FIRST}) AS a, CASE WHEN reading < {tx.MONTH_FIRST} THEN 0D ELSE -rate END AS b, reading AS c, shape AS d)")
    wins = f"reading >= 0 AND rate >= {tx.DATE_SHARE}D"
    whole = ", ".join(f"max({c}) FILTER (WHERE reading = -1) AS {c}" for c in ("n_unique", "dominance", "bits", "boolean_share"))
    return _grouped(stats, ["ordinal"], [
        whole,
        f"min_by(struct(rate, earliest, latest), {rank}) FILTER (WHERE {wins}) AS won",
        "max(rate) FILTER (WHERE reading >= 0) AS best",
    ]).selectExpr(
        "ordinal", "n_unique", "dominance", entropy, "boolean_share", "coalesce(won.rate, best, 0D) AS parse_rate",
        "coalesce(best = 1D, false) AS all_dates", "won.earliest AS parsed_min", "won.latest AS parsed_max")


def frequency_stats(df: DataFrame, ordinals: Sequence[int] | None = None, rough: frozenset[int] = frozenset()) -> DataFrame:
    """One row of :data:`STATS_SCHEMA` per column that has a value."""
    parts = []
    for (_, is_text), members in families(df, ordinals).items():
        counts = frequency_counts(value_frequencies(df, members, rough), is_text)
        parts.append(_column_stats(counts, is_text))
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, cnt) with whole values as text."""
    pairs = ", ".join(f"named_struct('name', {k}, 'value', {rendered(reference(c), df.schema[c].dataType)})"
                      for k, c in enumerate(columns))
    cells = df.selectExpr(f"inline(array({pairs}))").where("value IS NOT NULL")
    counts = cells.groupBy("name", "value").agg(F.expr("count(1) AS cnt"))
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(names[F.col("name")].alias("column"), "value", "cnt")


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, cnt): the mode of each column as text, the smallest value on ties."""
    parts = []
    by_key: dict[str, list[str]] = {}
    for c in columns:
        by_key.setdefault(_sort_key(reference(c), df.schema[c].dataType)[1], []).append(c)
    for members in by_key.values():
        pairs = ", ".join(
            f"named_struct('name', {k}, 'value', {rendered(reference(c), df.schema[c].dataType)}, "
            f"'key', {_sort_key(reference(c), df.schema[c].dataType)[0]})" for k, c in enumerate(members))
        cells = df.selectExpr(f"inline(array({pairs}))").where("value IS NOT NULL")
        counts = cells.groupBy("name", "value", "key").agg(F.expr("count(1) AS cnt"))
        best = counts.groupBy("name").agg(F.expr("min_by(struct(value, cnt), struct(-cnt, key)) AS m"))
        names = F.array(*[F.lit(c) for c in members])
        parts.append(best.select(names[F.col("name")].alias("column"), "m.value", "m.cnt"))
    return reduce(DataFrame.unionByName, parts)


def _sort_key(ref: str, data_type: T.DataType) -> tuple[str, str]:
    """(expression, type) by which values sort, so that 9 comes before 10."""
    if isinstance(data_type, T.DecimalType):
        return ref, data_type.simpleString()
    family = grouping_family(data_type)
    return (rendered(ref, data_type) if family == "string" else grouping_value(ref, data_type)), family
