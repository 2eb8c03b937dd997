import datetime as dt
import json
from decimal import Decimal

import pytest

from tabscope import (
    column_preview, key_candidates, notes, profile, profile_digest, profile_json, sorted_profile, table_profile)
from tabscope.operators.frequencies import frequency_counts


def by_column(df, **options):
    return {r["column"]: r for r in profile(df, **options).collect()}


def strings(spark, values):
    return spark.createDataFrame([(v,) for v in values], "s string")


def test_empty_table(spark):
    p = by_column(spark.createDataFrame([], "i int, s string"))
    assert p["i"].n_rows == 0 and p["i"].unique_ratio == 0 and p["i"].missing_ratio == 0
    assert p["i"].is_unique and not p["i"].is_constant
    assert p["s"].semantic_type == "unknown" and p["i"].semantic_type == "integer"


def test_nan_counts_as_missing(spark):
    p = by_column(spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "v double"))["v"]
    assert (p.n_missing, p.n_unique, p.is_constant, p.example) == (2, 1, True, "1.0")
    assert p.min_numeric == p.max_numeric == 1.0


def test_negative_zero_is_zero(spark):
    assert by_column(spark.createDataFrame([(0.0,), (-0.0,)], "v double"))["v"].n_unique == 1


@pytest.mark.parametrize("distinct, rows, expected", [
    (50, 1000, "categorical"), (51, 1000, "text"), (51, 1020, "categorical"), (1, 1, "categorical")])
def test_categorical_limit(spark, distinct, rows, expected):
    assert by_column(strings(spark, [f"v{i % distinct}" for i in range(rows)]))["s"].semantic_type == expected


@pytest.mark.parametrize("other, expected", [(2, "boolean"), (3, "categorical")])
def test_boolean_share(spark, other, expected):
    values = ["maybe"] * other + [" True\t", "f", "YES", "0"] * 24 + ["n"] * (4 - other)
    p = by_column(strings(spark, values))["s"]
    assert p.semantic_type == expected
    assert (p.datetime_parse_rate is None) == (expected == "boolean")


@pytest.mark.parametrize("junk, expected", [(10, "datetime"), (11, "categorical")])
def test_date_share(spark, junk, expected):
    p = by_column(strings(spark, ["junk"] * junk + ["2024-02-29"] * (100 - junk)))["s"]
    assert p.semantic_type == expected and p.datetime_parse_rate == pytest.approx(1 - junk / 100)
    if expected == "datetime":
        assert p.min_value == p.max_value == "2024-02-29 00:00:00+00:00"


@pytest.mark.parametrize("values", [
    ["2024-01-31"], ["2024-01-31 10:11:12"], ["31/01/2024"], ["01/31/2024"], ["2024-01-31T10:11:12"],
    ["2024-01-31T10:11:12Z"], ["31-01-2024"], ["01-31-2024"], ["2024-1-5"]])
def test_listed_formats(spark, values):
    assert by_column(strings(spark, values))["s"].semantic_type == "datetime"


def test_day_first_wins_when_both_read_enough(spark):
    # 9 of 10 values read day first, all read month first: the first listed format wins.
    values = ["01/02/2024"] * 9 + ["01/25/2024"]
    p = by_column(strings(spark, values))["s"]
    assert p.datetime_parse_rate == 0.9 and p.min_value.startswith("2024-02-01") and p.all_dates


@pytest.mark.parametrize("values, first", [
    (["2024/01/31", "2023/12/01"], "2023-12-01 00:00:00"), (["31.01.2024", "01.02.2024"], "2024-01-31 00:00:00"),
    (["01/02/24 10:00", "02/13/24 11:30"], "2024-01-02 10:00:00"), (["Jan 5, 2024", "September 30, 2024"], "2024-01-05 00:00:00"),
    (["Mon, 05 Feb 2024 10:11:12 GMT"], "2024-02-05 10:11:12"), (["20240131"], "2024-01-31 00:00:00"), (["5 may 1999"], "1999-05-05 00:00:00"),
    (["2024-01-31 10:11:12.25"], "2024-01-31 10:11:12.250000"), (["2024-01-31T23:30:00-05:30"], "2024-02-01 05:00:00"),
    (["01/02/2024 12:05 AM", "01/02/2024 12:05 pm"], "2024-01-02 00:05:00"), (["3-Mar-2024 7:00"], "2024-03-03 07:00:00"), (["07.08.69"], "1969-07-08 00:00:00")])
def test_dates_by_shape(spark, values, first):
    p = by_column(strings(spark, values))["s"]
    assert (p.semantic_type, p.datetime_parse_rate, p.min_value, p.all_dates) == ("datetime", 1.0, first + "+00:00", True)


@pytest.mark.parametrize("values", [
    ["2024/13/31"], ["31.02.2024"], ["Janet 5, 2024"], ["2024-01-31 25:00"], ["2024-01/31"], ["99999999"], ["1.2.3"], ["Y-N-N"], ["B N, Y"], ["March"],
    ["13/01/2024 13:05 PM"], ["1234567"], ["10:30"], ["12345678901"], ["May be 5, 2024"]])
def test_text_that_only_looks_like_dates(spark, values):
    assert by_column(strings(spark, values))["s"].datetime_parse_rate == 0


def test_one_shape_has_to_read_the_column(spark):
    """Day or month order is settled over the whole column, and shapes are not mixed."""
    p = by_column(strings(spark, ["01.02.2024"] * 19 + ["25.02.2024"]))["s"]
    assert p.datetime_parse_rate == 1.0 and p.min_value.startswith("2024-02-01")
    p = by_column(strings(spark, ["2024/02/01"] * 6 + ["Feb 1, 2024"] * 4))["s"]
    assert p.datetime_parse_rate == 0.6 and not p.all_dates and p.semantic_type != "datetime"


@pytest.mark.parametrize("value", ["Tuesday, 20201231 12:01:02+02:00", "31.02.2024", "13/13/2024 10:00", "2024/01/02 25:00", "2024/01/02 10:61"])
def test_shapes_that_hold_no_date_are_not_read(spark, value):  # the first one failed with an overflow
    assert by_column(strings(spark, [value]))["s"].datetime_parse_rate == 0


def test_boolean_words_in_any_white_space(spark):
    words = ["\t\x0b Yes\r\n", "no\x0c", "TRUE ", " f", "0", "1\n", "y" + " " * 70]
    assert by_column(strings(spark, words))["s"].semantic_type == "boolean"
    assert by_column(strings(spark, ["yes\u00a0", "y es", "10", "", " ", "true\x00", "no."]))["s"].semantic_type == "categorical"


def test_reading_dates_is_compiled_code(spark):
    """The JVM compiles no method of more than 8,000 bytes; trimming white space took a quarter of the time, interpreted functions more."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else no code is made before the query runs
    try:
        values = spark.range(9).selectExpr("0 AS ordinal", "concat(id, '.2.2024') AS value", "id AS cnt")
        plan = frequency_counts(values, True)._jdf.queryExecution()
        stages = plan.debug().codegenToSeq()
        assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) <= 8_000
        assert "trim" not in plan.executedPlan().toString() and "filter(" not in plan.executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_bare_years_and_impossible_dates_are_text(spark):
    assert by_column(strings(spark, ["2024", "2023"]))["s"].datetime_parse_rate == 0
    assert by_column(strings(spark, ["2024-02-30"]))["s"].datetime_parse_rate == 0


def test_all_missing(spark):
    p = by_column(spark.createDataFrame([(None, None)] * 3, "s string, d double"))
    assert p["s"].semantic_type == "categorical" and p["s"].is_constant and p["s"].all_dates
    assert p["d"].semantic_type == "float" and p["d"].std is None and p["d"].integer_share is None


def test_declared_types(spark):
    row = (True, Decimal("1.50"), [1], {"a": 1}, (1,), dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 600000), b"x", 3.5)
    df = spark.createDataFrame(
        [row, row], "b boolean, d decimal(10,2), a array<int>, m map<string,int>, st struct<x:int>, day date, ts timestamp, bin binary, f float")
    p = by_column(df)
    kinds = {c: r.semantic_type for c, r in p.items()}
    assert kinds == {"b": "boolean", "d": "numeric", "a": "unknown", "m": "unknown", "st": "unknown", "day": "datetime",
                     "ts": "datetime", "bin": "unknown", "f": "float"}
    assert all(r.n_unique == 1 for r in p.values())
    assert p["d"].min_value == "1.50" and p["day"].min_value == "2024-01-02 00:00:00"
    assert p["ts"].max_value == "2024-01-02 03:04:05.600000"


def test_map_entry_order_does_not_matter(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert by_column(df)["m"].n_unique == 1


def test_long_text_is_counted_exactly(spark):
    values = ["x" * 64, "x" * 65, "x" * 64 + "y", "x" * 65, "x" * 5000 + "a", "x" * 5000 + "b"]
    assert by_column(strings(spark, values))["s"].n_unique == 5


def test_odd_names_and_example_order(spark):
    df = spark.createDataFrame([(2, None, 7), (1, "b", 8), (0, "a", 9)], "`k` int, `a.b` string, `we``ird` int")
    p = by_column(df, order_by="k")
    assert p["a.b"].example == "a" and p["we`ird"].example == "9"


def test_many_columns_are_chunked(spark):
    df = spark.range(20).selectExpr(*[f"id % {i + 1} AS c{i}" for i in range(95)])
    p = by_column(df)
    assert [p[f"c{i}"].n_unique for i in range(95)] == [min(i + 1, 20) for i in range(95)]


def test_hot_value(spark):
    df = spark.range(30000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS v")
    p = by_column(df.repartition(5))["v"]
    assert p.n_unique == 20001 and p.dominance == pytest.approx(1 / 3)


def test_approximate_agrees_on_every_rule(spark):
    df = spark.range(20000).selectExpr(
        "id", "id % 2 AS two", "id % 51 AS many", "concat('t', id) AS name", "CAST(id % 9000 AS STRING) AS half",
        "CASE WHEN id % 2 = 0 THEN 'y' ELSE 'n' END AS flag", "date_format(timestamp_seconds(id * 86400 % 900000000), 'yyyy-MM-dd') AS day",
        "id % 3000 / 7 AS ratio")
    exact, rough = by_column(df), by_column(df, exact=False)
    for c, e in exact.items():
        r = rough[c]
        assert (e.semantic_type, e.is_unique, e.is_constant) == (r.semantic_type, r.is_unique, r.is_constant), c
        assert abs(e.n_unique - r.n_unique) <= 0.06 * e.n_unique
    assert rough["ratio"].dominance is None or rough["half"].dominance is None


def test_notes_and_table_profile(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 3, None)], "id int, k int, s string")
    kinds = {(r["column"], r.kind) for r in notes(profile(df)).collect()}
    assert kinds == {("id", "identifier"), ("s", "missing"), ("s", "constant")}
    t = table_profile(profile(df)).first()
    assert (t.n_rows, t.n_cols, t.primary_key_candidates) == (3, 3, ["k"]) and len(t.notes) == 3
    assert t.columns["s"].n_missing == 2
    assert [r["column"] for r in key_candidates(profile(df)).collect()] == ["k"]
    assert "66.7%" in t.notes[1]
    document = json.loads(profile_json(profile(df)).first().profile)
    assert document["columns"]["s"]["min_value"] is None


def test_digest(spark):
    df = spark.createDataFrame([(1, "x", 2)], f"a int, {'n' * 61} string, c int")
    lines = [r.line for r in profile_digest(profile(df), 2).orderBy("ordinal").collect()]
    assert lines[0] == "- a | type=integer | n_unique=1 | missing_ratio=0.00 | is_unique=True | is_constant=True"
    assert lines[1].startswith("- " + "n" * 60 + "… |") and lines[2] == "... (+1 more)"


def test_sorted_and_preview(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (10, None)], "n int, s string")
    assert [r["column"] for r in sorted_profile(profile(df), "missing_ratio").collect()] == ["s", "n"]
    text = column_preview(df, "s").first()
    assert (text.mode, text.missing_percent, text.task) == ("a", 50.0, "classification")
    number = column_preview(df, "n").first()
    assert (number.min, number.max, number.task, number.mode) == (1.0, 10.0, "regression", None)
    assert column_preview(spark.createDataFrame([(None,)], "s string"), "s").first().mode == "none"


def test_no_columns(spark):
    with pytest.raises(ValueError):
        profile(spark.range(1).select())


def test_boolean_words_of_any_length(spark):
    df = spark.createDataFrame([("yes" + " " * 70, "x" * 80), ("no" + " " * 70, "!" * 80), ("no", "z" * 80)], "flag string, other string")
    kinds = {r["column"]: r.semantic_type for r in profile(df).collect()}
    assert kinds["flag"] == "boolean" and kinds["other"] != "boolean"
