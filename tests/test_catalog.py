import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import compare

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()
# One query per operator and kind of table; check.py compares all of them.
FAST = ["profile_orders", "profile_embeddings", "profile_orders_gaps", "profile_orders_text_dates", "profile_orders_flags",
        "profile_approximate_lineitem", "heuristic_scores_lineitem", "target_ranking_orders", "target_ranking_orders_gaps",
        "dominance_entropy_part", "missing_profile", "table_notes", "profile_digest_capped", "value_counts_events",
        "column_modes", "column_preview", "integer_share", "numeric_coercion", "monotonicity_events", "row_numbers",
        "row_numbers_within", "permutation_check", "split_random", "split_stratified", "class_weights",
        "impute_values", "impute_apply", "scale_values", "onehot_apply", "onehot_wide", "regression_metrics", "classification_metrics",
        "linear_fit", "csv_scan", "suggestion_verdicts", "decision_chain", "ranking_decision", "ranking_fallback"]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], SQL[name], SF).startswith("ok")


def test_entry(spark):
    df = entry_points.entry(spark)
    assert {r.table_name: r["column"] for r in df.collect()}["events"] == "value"
