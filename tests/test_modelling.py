import hashlib
import statistics
import threading

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabscope import run, train
from tabscope.operators import dictionary, metrics, models, prep, sampling
from tabscope.operators import importance as importances
from tabscope.operators.importance import explained, importance, permutation_drops, top_features
from tabscope.session import dealt, together

SMALL = models.ModelSizes(regression_trees=5, classification_trees=5, tree_depth=4, boosting_rounds=4, boosting_depth=3)


@pytest.mark.parametrize("window", [1_000_000, 50])
def test_medians(spark, window):
    rng = np.random.default_rng(3)
    rows = [(float(rng.normal()), int(rng.integers(0, 9)), None if i % 3 else i, 5.0 if i % 3 else float("nan"), None)
            for i in range(5001)]
    df = spark.createDataFrame(rows, "a double, b int, c int, d double, e double").repartition(4)
    got = prep.medians(df, ["a", "b", "c", "d", "e"], window)
    assert "e" not in got and got["d"] == 5.0
    for j, c in enumerate("abc"):
        assert got[c] == pytest.approx(statistics.median(r[j] for r in rows if r[j] is not None)), c


def test_medians_of_even_and_single(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, None), (10.0, None), (4.0, None)], "a double, b int")
    assert prep.medians(df, ["a", "b"]) == {"a": 3.0, "b": 3.0}
    # A gap in the middle of a long column must not be lost by narrowing.
    two = spark.range(4000).selectExpr("CASE WHEN id < 2000 THEN 0D ELSE 100D END AS v")
    assert prep.medians(two, ["v"], 10) == {"v": 50.0}


def test_modes_and_imputation(spark):
    df = spark.createDataFrame([("b", 9, None), ("a", 10, None), (None, None, None), ("it's", 9, None), ("a", 10, None), ("b", None, None)],
                               "s string, n int, e string")
    assert prep.modes(df, ["s", "n", "e"]) == {"s": "a", "n": "9"}
    filled = prep.imputed(df, {"n": 9.5}, {"s": "it's \\ x"})
    assert {tuple(r) for r in filled.collect()} == {(9.0, "b"), (10.0, "a"), (9.5, "it's \\ x"), (9.0, "it's"), (9.5, "b")}


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, c double")
    assert [tuple(r) for r in prep.scaled(df, ["a", "c"]).collect()] == [(1.0, 7.0), (3.0, 7.0)]


def test_preparation(spark):
    train_rows = spark.createDataFrame(
        [(1.0, True, "x", None, "u1"), (None, False, None, None, "u2"), (5.0, True, "x", None, "u3"), (3.0, None, "y", None, "u4")],
        "n double, b boolean, k string, void double, wide string")
    fitted = prep.fit_preparation(train_rows, ["n", "b", "void"], ["k", "wide"])
    assert (fitted.numeric, fitted.categorical) == (["n", "b"], ["k", "wide"])
    assert fitted.skipped == {"void": "no values"}
    unseen = spark.createDataFrame([(None, None, "new", None, "u1"), (3.0, True, "y", None, "u1")], train_rows.schema)
    rows = [r.f for r in fitted.transform(unseen).select(vector_to_array(prep.FEATURES).alias("f")).collect()]
    assert rows[0][2:4] == [0.0, 0.0] and rows[1][2:4] == [0.0, 1.0]
    assert rows[0][4:] == rows[1][4:] == [1.0, 0.0, 0.0, 0.0]  # each value has a slot of its own
    assert rows[0][0] == rows[1][0]  # the median is 3


@pytest.mark.parametrize("broadcast_values", [100_000, 2])
def test_dictionary_alike_at_every_size(spark, monkeypatch, broadcast_values):
    """Two of six values are hot; some are long, one is a digest's twin, one is unseen, repeated rows and gaps are kept."""
    monkeypatch.setattr(dictionary, "BROADCAST_VALUES", broadcast_values)
    monkeypatch.setattr(dictionary, "HOT_SHARE", 4)
    texts = ["hot"] * 40 + ["warm"] * 30 + ["é", "z" * 65, "z" * 64, "it's"] * 2
    train_rows = spark.createDataFrame([(i, t, "only") for i, t in enumerate(texts)], "id int, t string, one string").repartition(5)
    rows = spark.createDataFrame([(i, t, "only") for i, t in enumerate([*texts, "new", None])], "id int, t string, one string")
    fitted = prep.fit_preparation(train_rows, [], ["t", "one"])
    assert fitted.entries.sizes == {0: 6, 1: 1} and fitted.entries.n_rows == len(texts)
    entries = sorted({hashlib.sha256(t.encode()).hexdigest() if len(t) > 64 else t for t in texts}, key=str.encode)
    got = {r.id: list(r.f) for r in fitted.transform(rows).select("id", vector_to_array(prep.FEATURES).alias("f")).collect()}
    assert len(got) == len(texts) + 2
    for i, t in enumerate([*texts, "new", "hot"]):  # the gap is filled with the mode
        held = hashlib.sha256(t.encode()).hexdigest() if len(t) > 64 else t
        assert got[i] == [*[float(e == held) for e in entries], 1.0]


def test_feature_columns(spark):
    df = spark.createDataFrame([(1, True, "a", None)], "t int, b boolean, s string, d date")
    assert prep.feature_columns(df, "t") == (["b"], ["s", "d"])
    nan = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "t double")
    assert prep.with_target(nan, "t").count() == 1


@pytest.mark.parametrize("pairs, r2", [([(1.0, 1.0), (2.0, 2.0)], 1.0), ([(1.0, 1.5), (2.0, 1.5)], 0.0),
                                       ([(1.0, 2.0), (2.0, 1.0)], -3.0), ([(1.0, 1.0), (1.0, 1.0)], 1.0), ([(1.0, 2.0), (1.0, 1.0)], 0.0)])
def test_regression_scores(spark, pairs, r2):
    row = metrics.regression_scores(spark.createDataFrame(pairs, "label double, prediction double")).first()
    assert row.r2 == pytest.approx(r2)
    assert row.mae == pytest.approx(np.mean([abs(a - b) for a, b in pairs]))


def test_classification_scores(spark):
    # c is never predicted, d is predicted but absent from the labels.
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")]
    row = metrics.classification_scores(spark.createDataFrame(pairs, "label string, prediction string")).first()
    assert row.accuracy == 0.5 and row.balanced_accuracy == pytest.approx((0.5 + 1 + 0) / 3)
    assert row.f1_macro == pytest.approx((2 / 3 + 2 / 3 + 0 + 0) / 4)
    single = metrics.classification_scores(spark.createDataFrame([("a", "a")], "label string, prediction string")).first()
    assert (single.accuracy, single.balanced_accuracy, single.f1_macro) == (1.0, 1.0, 1.0)


def test_best_model_takes_first_on_ties(spark):
    scores = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "model_ordinal int, r2 double")
    assert metrics.best_model(scores, "r2").first().model_ordinal == 1


@pytest.fixture(scope="module")
def line(spark):
    return spark.range(600).selectExpr("id", "'k' || (id % 4) AS k", "(id * 31 % 97) / 10D AS x1", "id * 17 % 53 AS x2",
                                       "3 * ((id * 31 % 97) / 10D) AS y", "CASE WHEN id % 3 = 0 THEN 'p' WHEN id * 31 % 97 > 50 THEN 'q' ELSE 'r' END AS c")


def test_regression_bakeoff_finds_the_line(spark, line):
    df = line.drop("c")
    outcome = models.bake_off(df, "y", models.REGRESSION, ["x1", "x2"], ["k"], key=["id"], sizes=SMALL)
    assert outcome.best.name == "LinearRegression" and outcome.best.scores["r2"] > 0.999
    assert outcome.metrics.count() == 3


def test_multiclass_training_and_test_importance(spark, line):
    out = train(line.drop("y"), "c", models.CLASSIFICATION, key=["id"], repeats=2, importance_on="test", sizes=SMALL)
    assert out.outcome.best.scores["balanced_accuracy"] > 0.4
    assert {r.feature for r in out.importance.collect()} == {"id", "k", "x1", "x2"}


def test_infinite_values_and_odd_modes(spark):
    df = spark.createDataFrame([(float("inf"), "__THIS__"), (float("inf"), "__THIS__"), (1.0, None)], "n double, k string")
    fitted = prep.fit_preparation(df, ["n"], ["k"])
    assert fitted.transform(df).select(prep.FEATURES).count() == 3
    assert [r.k for r in prep.imputed(df, {"n": float("inf")}, {"k": "__THIS__"}).collect()] == ["__THIS__"] * 3


def test_boosting_on_equal_features_takes_all_rows(spark):
    df = spark.range(13000).selectExpr("1 AS x", "CAST(id % 2 AS INT) AS c")
    models.bake_off(df, "c", models.CLASSIFICATION, ["x"], [], sizes=SMALL)


def test_binary_boosting(spark):
    df = spark.range(13000).selectExpr("id AS x", "id % 2 AS noise", "CAST(id > 6000 AS INT) AS c")
    outcome = models.bake_off(df, "c", models.CLASSIFICATION, ["x", "noise"], [], sizes=SMALL)
    assert max(f.scores["accuracy"] for f in outcome.candidates) > 0.99


def linear_predictor(spark, data):
    fitted = prep.fit_preparation(data, ["x1", "x2"], ["k"])
    estimator = dict(models.candidates(models.REGRESSION, 0))["LinearRegression"]
    return models.Refit(models.REGRESSION, fitted, estimator.fit(fitted.transform(data).select(models.LABEL, prep.FEATURES))).predict


def test_importance_of_a_line(spark, line):
    data, _ = models.labelled(line, "y", models.REGRESSION)
    predict = linear_predictor(spark, data)
    tables = []
    for partitions in (1, 4, 16):
        drops = permutation_drops(data.repartition(partitions), ["k", "x1", "x2"], models.REGRESSION, predict, 3, key=["id"])
        tables.append({r.feature: (round(r["mean"], 9), round(r["std"], 9)) for r in importance(drops).collect()})
    assert tables[0] == tables[1] == tables[2]
    assert tables[0]["x1"][0] == pytest.approx(2.0, abs=0.2) and abs(tables[0]["k"][0]) < 1e-6 and abs(tables[0]["x2"][0]) < 1e-6
    top = top_features(importance(drops), 2).collect()
    assert [(r.position, r.feature) for r in top][0] == (1, "x1") and len(top) == 2


def test_importance_against_brute_force(spark, line):
    """Rebuild the shuffled columns on the driver from the same permutation."""
    from tabscope.operators.sampling import permuted
    data, _ = models.labelled(line.limit(200), "y", models.REGRESSION)

    def predict(df):
        return df.withColumn("prediction", F.expr("2.5 * x1 + 0.1 * x2 + CASE WHEN k = 'k1' THEN 1 ELSE 0 END"))

    drops = {(r.feature, r.repeat): r.drop for r in permutation_drops(data, ["k", "x1", "x2"], models.REGRESSION, predict, 2, key=["id"]).collect()}
    rows = data.orderBy("id").collect()
    y = np.array([r[models.LABEL] for r in rows])

    def score(k, x1, x2):
        p = 2.5 * np.array(x1) + 0.1 * np.array(x2) + np.array([v == "k1" for v in k])
        return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    columns = {c: [r[c] for r in rows] for c in ("k", "x1", "x2")}
    base = score(**columns)
    for repeat in (0, 1):
        image = [r.p for r in spark.range(len(rows)).orderBy("id").selectExpr(f"{permuted('id', len(rows), 42, repeat)} AS p").collect()]
        for c in columns:
            shuffled = {**columns, c: [columns[c][i] for i in image]}
            assert drops[(c, repeat)] == pytest.approx(base - score(**shuffled)), (c, repeat)


def test_whole_job(spark, line, tmp_path):
    out = str(tmp_path / "out")
    said = spark.createDataFrame([('{"target": "y", "confidence": 0.9}',)], "response string")
    result = run(spark, df=line, suggestions=said, key=["id"], repeats=2, sample_n=400, output=out, dataset="line", sizes=SMALL)
    assert (result.target, result.source, result.task) == ("y", "suggestion", "regression")
    assert result.profile.first().n_rows == 400
    assert {r.model for r in result.metrics.collect()} == {"LinearRegression", "RandomForestRegressor", "GBTRegressor"}
    first = spark.read.parquet(result.outputs["profile"])
    assert first.select("dataset", "target").distinct().collect()[0][:] == ("line", "y") and first.count() == 6
    again = run(spark, df=line, strategy="manual", target="x2", task_rule="dtype", key=["id"], repeats=2, output=out, dataset="line", sizes=SMALL)
    assert again.source == "user_choice" and again.task == "regression"
    assert spark.read.parquet(again.outputs["importance"]).select("target").distinct().count() == 2


def test_job_arguments(spark, line):
    with pytest.raises(ValueError):
        run(spark)
    with pytest.raises(ValueError):
        run(spark, df=line, strategy="guess")
    with pytest.raises(ValueError, match="does not exist"):
        run(spark, df=line, strategy="manual", target="gone")
    with pytest.raises(ValueError, match="no suitable"):
        run(spark, df=spark.range(3).selectExpr("1 AS one"), strategy="heuristics")


def test_a_feature_called_label_is_no_target(spark):
    df = spark.range(300).selectExpr("id", "pmod(hash(id, 1), 100) AS label", "pmod(hash(id, 2), 100) AS features", "pmod(hash(id, 3), 100) * 1.0D AS y")
    outcome = models.bake_off(df, "y", models.REGRESSION, ["label", "features"], [], sizes=SMALL)
    assert max(f.scores["r2"] for f in outcome.candidates) < 0.5


def test_no_column_name_is_reserved(spark):
    """Features with the names of all columns that the library makes for itself, and of those that models add."""
    names = ["is_test", "_n0", "_s0", "_k0", "_i0", "_h0", "_class", "_label", "_edge", "_need", "_row", "_group", "_hash", "prediction", "label",
             "features", "row_index", "_key0", "_chosen", "probability", "rawPrediction", "partner", "repeat", "f", "x0"]
    draw = np.random.default_rng(4)
    rows = [(i, *[("ab"[i % 2] if n in ("_k0", "_class") else float(draw.normal())) for n in names], "yes" if i % 2 else "no") for i in range(120)]
    df = spark.createDataFrame(rows, ["id", *names, "goal"])
    done = train(df, "goal", models.CLASSIFICATION, key=["id"], repeats=2, sizes=SMALL)
    assert {r.feature for r in done.importance.collect()} == {"id", *names}
    best = done.importance.orderBy(F.desc("mean")).first().feature
    assert best in ("_k0", "_class") and done.outcome.best.scores["accuracy"] > 0.9
    done = train(df.drop("goal"), "label", models.REGRESSION, key=["row_index"], repeats=1, sizes=SMALL)
    assert {r.feature for r in done.importance.collect()} == {"id", *names} - {"label"}


def test_too_many_classes_are_refused(spark):
    df = spark.range(models.MAX_CLASSES + 5).selectExpr("id", "CAST(id AS STRING) AS c")
    with pytest.raises(ValueError, match="classes"):
        models.labelled(df, "c", models.CLASSIFICATION)


def test_slots_are_read_from_vectors_as_stored(spark):
    """A column of 30,000 values: dense copies of these vectors would take 7 GB."""
    seen = spark.range(30_000).selectExpr("id", "lpad(CAST(id AS STRING), 6, '0') AS value")
    fitted = prep.fit_preparation(seen, [], ["value"])
    rows = prep.stored(fitted.transform(seen.unionByName(spark.createDataFrame([(-1, "new")], seen.schema))))
    got = rows.selectExpr("id", "width", "get(indices, first_one) AS slot")
    assert got.where("width != 30000 OR NOT coalesce(slot, -1) <=> id").isEmpty() and got.count() == 30_001
    plain = prep.fit_preparation(seen.limit(1), [], ["value"])
    assert prep.stored(plain.transform(seen.limit(1))).selectExpr("coalesce(get(indices, first_one), first_one) AS s", "width").first()[:] == (0, 1)


def test_small_tables_are_dealt_over_few_tasks(spark):
    """A fit is hundreds of jobs: 200 partitions of a few rows each only start tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        data, _ = models.labelled(spark.range(1000).selectExpr("id AS x", "id * 2D AS y"), "y", models.REGRESSION)
        vectors = models.vectors_of(prep.fit_preparation(data, ["x"], []), data, 1000)
        assert vectors.rdd.getNumPartitions() == 12 and vectors.count() == 1000
        many = models.spread(spark.range(10), 10**9)
        assert many.rdd.getNumPartitions() == 200 and models.spread(spark.range(10), 1_000_001).rdd.getNumPartitions() == 21
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("key", [["id"], None])
def test_importance_of_a_linear_model_needs_no_variants(spark, line, key):
    """The same drops as from predicting every variant, one row per pair of rows."""
    data, _ = models.labelled(line, "y", models.REGRESSION)
    fitted = prep.fit_preparation(data.where("k <> 'k1'"), ["x1", "x2"], ["k"])  # k1 is unseen
    estimator = dict(models.candidates(models.REGRESSION, 0))["LinearRegression"]
    final = models.Refit(models.REGRESSION, fitted, estimator.fit(fitted.transform(data).select(models.LABEL, prep.FEATURES)))
    features, data = ["x2", "k", "x1"], data.coalesce(1)
    fast = explained(data, features, final, 3, key=key)
    slots = [fitted.slots[c] for c in features]
    slow = permutation_drops(fitted.encode(data).select(models.LABEL, "id", *slots), slots, models.REGRESSION, final.predict_encoded, 3, key=key)
    assert "Generate explode" not in fast._jdf.queryExecution().toString()
    got, want = ({(r.feature_ordinal, r.repeat): r for r in t.collect()} for t in (fast, slow))
    assert set(got) == set(want) and len(got) == 9
    for at, r in got.items():
        assert (r.score, r["drop"]) == pytest.approx((want[at].score, want[at]["drop"]), abs=1e-9) and r.feature == features[at[0]]


def test_candidates_of_few_rows_are_fitted_side_by_side(spark, line, monkeypatch):
    """Each fit of a few rows waits for jobs to start: none begins only when another has ended. Results stay in order."""
    met, fit_one = threading.Barrier(3, timeout=60), models.fit_one

    def fitted(*args):
        met.wait()
        return fit_one(*args)

    monkeypatch.setattr(models, "fit_one", fitted)
    outcome = models.bake_off(line.drop("c"), "y", models.REGRESSION, ["x1", "x2"], ["k"], key=["id"], sizes=SMALL)
    assert [(f.ordinal, f.name) for f in outcome.candidates] == [(0, "LinearRegression"), (1, "RandomForestRegressor"), (2, "GBTRegressor")]
    assert outcome.best.name == "LinearRegression"


@pytest.mark.parametrize("n_rows,n_classes,tasks,at_once", [
    (16_000, 50, 1, 12), (96_000, 50, 2, 6), (96_000, 3, 2, 3), (5_000_000, 50, 12, 4), (16_000, 2, 12, None), (16_000, 0, 12, None)])
def test_many_classes_of_few_rows_are_boosted_in_few_tasks_each(spark, n_rows, n_classes, tasks, at_once):
    """Classes are boosted side by side, each over as many tasks as its rows fill, so that jobs do not wait for tasks to start."""
    kind = models.CLASSIFICATION if n_classes else models.REGRESSION
    boosted = models.candidates(kind, n_rows, n_classes)[-1][1]
    seen = []
    boosted.fit = lambda vectors: seen.append((vectors.rdd.getNumPartitions(), vectors.count()))
    vectors = spark.range(0, 120, 1, 12).selectExpr(f"id % 3D AS {models.LABEL}", "id")
    models.fit_one(kind, boosted, vectors, n_rows)
    assert seen == [(tasks, 120)]
    assert at_once is None or boosted.getParallelism() == at_once


def test_steps_together(spark):
    assert together(spark, [lambda i=i: spark.range(i).count() for i in (3, 1, 2)], 3) == [3, 1, 2]
    with pytest.raises(ZeroDivisionError):
        together(spark, [lambda: 1, lambda: 1 // 0], 2)


@pytest.mark.parametrize("key, partitions", [(["id"], 3), (None, 24)])
def test_importance_of_a_linear_model_by_blocks(spark, line, monkeypatch, key, partitions):
    """Many blocks, packs and exchanges, with a key and for rows that lie evenly: the drops of every variant predicted, no row left out."""
    monkeypatch.setattr(importances, "BLOCK_CELLS", 120)
    monkeypatch.setattr(importances, "PAIRS_AT_ONCE", 1)
    data, _ = models.labelled(line.orderBy("id").coalesce(1), "y", models.REGRESSION)
    fitted = prep.fit_preparation(data.where("k <> 'k1'"), ["x1", "x2"], ["k"])  # k1 is unseen
    estimator = dict(models.candidates(models.REGRESSION, 0))["LinearRegression"]
    final = models.Refit(models.REGRESSION, fitted, estimator.fit(fitted.transform(data).select(models.LABEL, prep.FEATURES)))
    features = ["k", "x2", "x1"]
    rows = models.labelled(line.repartitionByRange(partitions, "id").sortWithinPartitions("id"), "y", models.REGRESSION)[0]
    fast = {(r.feature, r.repeat): r for r in explained(rows, features, final, 3, key=key).collect()}
    slots = [fitted.slots[c] for c in features]
    slow = permutation_drops(fitted.encode(data).select(models.LABEL, "id", *slots), slots, models.REGRESSION, final.predict_encoded, 3, key=["id"])
    want = {(features[r.feature_ordinal], r.repeat): r for r in slow.collect()}
    assert set(fast) == set(want) and len(fast) == 9
    for at, r in fast.items():
        assert (r.score, r["drop"]) == pytest.approx((want[at].score, want[at]["drop"]), abs=1e-9)


def test_importance_of_a_linear_model_frees_its_disk(spark):
    """Pairs of rows, 300,000 here, leave 18 MB of shuffle files if they are exchanged together and kept."""
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()))

    wide = spark.range(0, 60_000, 1, 24).selectExpr("id", *[f"pmod(hash(id, {i}), 100000) / 7D AS x{i}" for i in range(8)], "pmod(hash(id), 9) * 1D AS y")
    data, _ = models.labelled(wide, "y", models.REGRESSION)
    features = [f"x{i}" for i in range(8)]
    fitted = prep.fit_preparation(data, features, [])
    estimator = dict(models.candidates(models.REGRESSION, 0))["LinearRegression"]
    final = models.Refit(models.REGRESSION, fitted, estimator.fit(fitted.transform(data).select(models.LABEL, prep.FEATURES)))
    before = held()
    assert explained(data, features, final).count() == 40
    assert held() - before < 1_000_000
    assert [len(b) for b in importances._batches(5, 10**8)] == [1] * 5 and [*map(list, importances._batches(5, 8_000_000))] == [[0, 1], [2, 3], [4]]


def test_rows_that_lie_evenly_are_not_dealt_anew(spark):
    assert dealt(spark.range(0, 2400, 1, 24)) == (2400, True) and dealt(spark.range(100).coalesce(1)) == (100, False)
    uneven = spark.range(0, 1000, 1, 12).union(spark.range(0, 1000, 1, 1))
    assert dealt(uneven) == (2000, False) and dealt(spark.range(0)) == (0, False)
    data, _ = models.labelled(spark.range(0, 2400, 1, 24).selectExpr("id AS x", "id * 2D AS y"), "y", models.REGRESSION)
    vectors = models.vectors_of(prep.fit_preparation(data, ["x"], []), data, *dealt(data))
    assert vectors.rdd.getNumPartitions() == 24 and "Exchange" not in vectors._jdf.queryExecution().toString()


@pytest.mark.parametrize("n", [1, 2, 999, 1000])
def test_rounds_backwards_are_the_inverse(spark, n):
    rounds, numbers = sampling.permutation_rounds(spark, n, 42, 1), np.arange(n, dtype=np.int64)
    image = sampling.images(n)(numbers.copy(), rounds)
    assert sorted(image.tolist()) == list(range(n))
    assert sampling.images(n)(image, rounds[::-1]).tolist() == list(range(n))
    want = spark.range(n).orderBy("id").selectExpr(f"{sampling.permuted('id', n, 42, 1)} AS p").collect()
    assert image.tolist() == [r.p for r in want]


def test_importance_of_many_rows_in_one_partition(spark, line, monkeypatch):
    """They are dealt as given, before they are encoded: another permutation, of the same rows."""
    monkeypatch.setattr(importances, "ROWS_PER_TASK", 1)
    data, _ = models.labelled(line.coalesce(1), "y", models.REGRESSION)
    fitted = prep.fit_preparation(data, ["x1", "x2"], ["k"])
    estimator = dict(models.candidates(models.REGRESSION, 0))["LinearRegression"]
    final = models.Refit(models.REGRESSION, fitted, estimator.fit(fitted.transform(data).select(models.LABEL, prep.FEATURES)))
    got = {r.feature: r["mean"] for r in importance(explained(data, ["k", "x1", "x2"], final)).collect()}
    assert got["x1"] == pytest.approx(2.0, abs=0.1) and abs(got["k"]) < 1e-6 and abs(got["x2"]) < 1e-6
