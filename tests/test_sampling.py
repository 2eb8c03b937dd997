import hashlib

import pytest
from pyspark.sql import functions as F

from tabscope import class_weights, random_split, sample_exact, stratified_split
from tabscope.operators.sampling import permuted, permuted_column
from tabscope.operators import sampling


def position(key, seed=42):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_sample_is_the_lowest_hashes(spark, partitions):
    df = spark.range(5000).repartition(partitions)
    wanted = sorted(range(5000), key=position)[:321]
    assert sorted(r.id for r in sample_exact(df, 321, ["id"]).collect()) == sorted(wanted)


def test_sample_sizes(spark):
    df = spark.range(500)
    assert sample_exact(df, 1000, ["id"]).count() == 500
    assert sample_exact(df, 0, ["id"]).count() == 0
    assert sample_exact(df, 77).distinct().count() == 77
    assert sample_exact(df, 77).columns == ["id"]


def test_sample_of_one_hot_key(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id < 2000 THEN -1 ELSE id END AS k")
    for n in (10, 999, 2500):
        got = sample_exact(df, n, ["k"])
        assert got.count() == n and got.distinct().count() == n


def test_random_split(spark):
    df = spark.range(1003)
    flags = {r.id: r.is_test for r in random_split(df, 0.2, ["id"]).collect()}
    assert len(flags) == 1003 and sum(flags.values()) == 201
    again = {r.id: r.is_test for r in random_split(df.repartition(9), 0.2, ["id"]).collect()}
    assert flags == again
    other = {r.id: r.is_test for r in random_split(df, 0.2, ["id"], seed=1).collect()}
    assert flags != other
    unkeyed = random_split(df, 0.3)
    assert unkeyed.columns == ["id", "is_test"] and unkeyed.where("is_test").count() == 301


def test_stratified_split(spark):
    df = spark.range(1000).selectExpr(
        "id", "CASE WHEN id = 0 THEN 'single' WHEN id < 6 THEN 'five' WHEN id < 340 THEN NULL ELSE 'rest' END AS label")
    out = stratified_split(df, "label", 0.2, ["id"]).groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t"))
    assert {r.label: (r.n, r.t) for r in out.collect()} == {"single": (1, 0), "five": (5, 1), None: (334, 67), "rest": (660, 132)}


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] + [(None,)], "l string")
    assert {r.label: r.weight for r in class_weights(df, "l").collect()} == {"a": pytest.approx(4 / 6), "b": 2.0}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997])
def test_permutation_is_one_to_one(spark, n):
    images = [r.p for r in spark.range(n).selectExpr(f"{permuted('id', n, 42, 0)} AS p").collect()]
    assert sorted(images) == list(range(n))


def test_permutation_mixes(spark):
    df = spark.range(20000).selectExpr("id", f"{permuted('id', 20000, 42, 0)} AS p", f"{permuted('id', 20000, 42, 1)} AS q")
    row = df.agg(F.corr("id", "p").alias("a"), F.corr("p", "q").alias("b"), F.count_if(F.expr("id = p")).alias("fixed")).first()
    assert abs(row.a) < 0.03 and abs(row.b) < 0.03 and row.fixed < 12


def test_many_groups_split_a_hot_one(spark, monkeypatch):
    """Edges that are too many to broadcast: the hot group's edge is broadcast, the others are shuffled, the result is the same."""
    df = spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 50 END AS _group", "id AS _hash")
    want = sorted(map(tuple, sampling.stratified_split(df, "_group", 0.25, ["id"]).collect()))
    monkeypatch.setattr(sampling, "BROADCAST_GROUPS", 2)
    monkeypatch.setattr(sampling, "HEAVY_SHARE", 10)
    assert sorted(map(tuple, sampling.stratified_split(df, "_group", 0.25, ["id"]).collect())) == want


@pytest.mark.parametrize("n", [1, 2, 3, 100, 40_000])
def test_permuted_batches_are_the_same_permutation(spark, n):
    rows = spark.range(n).withColumn("id", F.expr("CAST(id AS BIGINT)"))
    for seed, repeat in ((42, 0), (-7, 4)):
        both = rows.select(F.expr(f"{permuted('id', n, seed, repeat)} AS p"), permuted_column(F.col("id"), rows, n, seed, repeat).alias("q"))
        assert both.where("NOT p <=> q").isEmpty()
