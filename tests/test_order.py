import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.operators.order import monotonicity, numbered


def brute(values):
    kept = [v for v in values if v is not None]
    if len(kept) < 3:
        return 0.0
    steps = [b - a for a, b in zip(kept, kept[1:])]
    return max(sum(s >= 0 for s in steps), sum(s <= 0 for s in steps)) / len(steps)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_monotonicity_against_brute_force(spark, partitions):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 50)), None if rng.random() < 0.3 else float(rng.normal()), 2**60 + i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, a int, b double, big bigint").repartition(partitions, F.col("a"))
    got = {r.ordinal: r for r in monotonicity(df, "k").collect()}
    for j in (1, 2, 3):
        values = [r[j] for r in rows]
        assert got[j].monotonicity == pytest.approx(brute(values)), j
        assert got[j].n_values == sum(v is not None for v in values)


@pytest.mark.parametrize("values, expected", [([], 0), ([1.0, 2.0], 0), ([1.0, 2.0, 2.0], 1), ([1.0, 3.0, 2.0], 0.5)])
def test_short_columns(spark, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "k int, v double")
    got = {r.ordinal: r.monotonicity for r in monotonicity(df, "k").collect()}
    assert got.get(1, 0.0) == expected


def test_scan_order_of_one_file(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id AS v", "-id AS w", "(id * 7919) % 1000 AS x")
    got = {r.ordinal: r.monotonicity for r in monotonicity(df).collect()}
    assert got[0] == got[1] == 1.0 and got[2] == pytest.approx(brute([(i * 7919) % 1000 for i in range(1000)]))


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_numbering(spark, partitions):
    df = spark.range(5000).selectExpr("id", "(id * 37) % 5000 AS k").repartition(partitions)
    rows = numbered(df, ["k"]).collect()
    assert all(r.row_index == r.k for r in rows) and len(rows) == 5000


def test_numbering_of_hot_keys_and_groups(spark):
    df = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'hot' ELSE CAST(id AS STRING) END AS g", "1 AS same").repartition(6)
    assert sorted(r.row_index for r in numbered(df, ["same"]).collect()) == list(range(6000))
    hot = [r.row_index for r in numbered(df, ["same"], within="g").where("g = 'hot'").collect()]
    assert sorted(hot) == list(range(4000))
    unordered = numbered(df)
    assert unordered.agg(F.countDistinct("row_index"), F.max("row_index")).first()[:] == (6000, 5999)


def test_numbering_with_missing_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "k int, g string")
    assert {(r.k, r.row_index) for r in numbered(df, ["k"], within="g").collect()} == {(1, 0), (2, 1), (3, 0)}
