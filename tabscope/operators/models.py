"""Candidate models, bake-off and refit."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.values import as_double, reference, rendered
from tabscope.operators.metrics import classification_scores, regression_scores
from tabscope.operators.prep import FEATURES, Preparation, fit_preparation
from tabscope.operators.sampling import class_weights, random_split, stratified_split, unused
from tabscope.session import LEAST_TASKS, ROWS_PER_TASK, shared_folder, spread, together

# Long names, so that features called label, features and the like stay features; a column that has one is refused.
LABEL = "__model_label"
WEIGHT = "__model_weight"
#: Classes of a target that a model is fitted on; more are refused.
MAX_CLASSES = 1_000
#: Classes that are boosted at a time, more where their rows fill few tasks.
CLASSES_AT_ONCE = 4
REGRESSION, CLASSIFICATION = "regression", "classification"


@dataclass(frozen=True)
class ModelSizes:
    """Size knobs of the candidates."""

    regression_trees: int = 200
    classification_trees: int = 300
    tree_depth: int = 8
    tree_bins: int = 64
    boosting_rounds: int = 100
    boosting_rate: float = 0.1
    boosting_depth: int = 5
    boosting_bins: int = 255
    logistic_iterations: int = 200


@dataclass
class Fitted:
    """A fitted candidate with its metrics on the test rows."""

    name: str
    ordinal: int
    model: Model
    scores: dict[str, float]


@dataclass
class BakeOff:
    task: str
    target: str
    preparation: Preparation
    candidates: list[Fitted]
    best: Fitted
    labels: StringIndexerModel | None = None
    metrics: DataFrame | None = field(default=None, repr=False)
    test: DataFrame | None = field(default=None, repr=False)


def candidates(task: str, n_train: int, n_classes: int = 0, seed: int = 42, sizes: ModelSizes = ModelSizes()) -> list[tuple[str, Estimator]]:
    """Named estimators in the order in which ties are broken; each is fitted on all rows it is given."""
    common = {"featuresCol": FEATURES, "labelCol": LABEL}
    if task == REGRESSION:
        return [
            ("LinearRegression", LinearRegression(regParam=0.0, **common)),
            ("RandomForestRegressor", RandomForestRegressor(
                numTrees=sizes.regression_trees, featureSubsetStrategy="all", maxDepth=sizes.tree_depth,
                maxBins=sizes.tree_bins, maxMemoryInMB=1024, seed=seed, **common)),
            ("GBTRegressor", GBTRegressor(
                maxIter=sizes.boosting_rounds, stepSize=sizes.boosting_rate, maxDepth=sizes.boosting_depth,
                maxBins=sizes.boosting_bins, seed=seed, **common)),
        ]
    boosted: Estimator = GBTClassifier(
        maxIter=sizes.boosting_rounds, stepSize=sizes.boosting_rate, maxDepth=sizes.boosting_depth,
        maxBins=sizes.boosting_bins, seed=seed, **common)
    if n_classes > 2:
        at_once = max(CLASSES_AT_ONCE, LEAST_TASKS // tasks_of_class(n_train))
        boosted = OneVsRest(classifier=boosted, parallelism=min(n_classes, at_once), **common)
    return [
        ("LogisticRegression", LogisticRegression(
            maxIter=sizes.logistic_iterations, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False,
            **common)),
        ("RandomForestClassifier", RandomForestClassifier(
            numTrees=sizes.classification_trees, maxDepth=sizes.tree_depth, maxBins=sizes.tree_bins, weightCol=WEIGHT,
            maxMemoryInMB=1024, seed=seed, **common)),
        ("GBTClassifier", boosted),
    ]


def tasks_of_class(n_rows: int) -> int:
    """Tasks of a fit that runs beside those of other classes: as many as its rows fill."""
    return max(1, -(-n_rows // ROWS_PER_TASK))


def labelled(df: DataFrame, target: str, task: str) -> tuple[DataFrame, StringIndexerModel | None]:
    """Add the numeric ``label``: the value itself, or the index of the class in text order."""
    data_type = df.schema[target].dataType
    if task == REGRESSION:
        return df.withColumn(LABEL, F.expr(as_double(reference(target), data_type))), None
    name = unused(df.columns, "_class")
    named = df.withColumn(name, F.expr(rendered(reference(target), data_type)))
    found = named.select(name).distinct().limit(MAX_CLASSES + 1).count()
    if found > MAX_CLASSES:  # the models keep a row of weights or votes per class
        raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
    indexer = StringIndexer(inputCol=name, outputCol=LABEL, stringOrderType="alphabetAsc").fit(named)
    return indexer.transform(named).drop(name), indexer


def weighted(df: DataFrame) -> DataFrame:
    """Add balanced class weights."""
    weights = class_weights(df, LABEL).select(F.col("label").alias("_label"), F.col("weight").alias(WEIGHT))
    return df.join(F.broadcast(weights), F.col(LABEL) == F.col("_label")).drop("_label")  # one row per class


def vectors_of(preparation: Preparation, rows: DataFrame, n_rows: int, even: bool = False) -> DataFrame:
    """(label, features) of that many rows, dealt evenly for the iterative fits; as they lie if they are even already."""
    vectors = preparation.transform(rows).select(LABEL, FEATURES)
    return vectors if even else spread(vectors, n_rows)


def fit_one(task: str, estimator: Estimator, vectors: DataFrame, n_rows: int | None = None) -> Model:
    """Fit on those vectors; ``n_rows``, their number, tells over how many tasks each of several classes is fitted, else over all."""
    shared_folder(vectors.sparkSession)  # boosting cuts its own lineage there
    if n_rows is not None and isinstance(estimator, OneVsRest):
        vectors = vectors.coalesce(tasks_of_class(n_rows))
    return estimator.fit(weighted(vectors) if task == CLASSIFICATION else vectors)


def scored(task: str, predictions: DataFrame) -> dict[str, float]:
    scores = (regression_scores if task == REGRESSION else classification_scores)(predictions, LABEL)
    return scores.first().asDict()  # one row


def headline(task: str) -> str:
    return "r2" if task == REGRESSION else "balanced_accuracy"


def bake_off(df: DataFrame, target: str, task: str, numeric: list[str], categorical: list[str], seed: int = 42,
             test_size: float = 0.2, key: list[str] | None = None, sizes: ModelSizes = ModelSizes()) -> BakeOff:
    """Fit every candidate on one split, score it on the test rows, keep the best (first on ties).

    ``df`` has no missing target. The preparation is fitted once, on the training rows, and its
    vectors are cached for the iterative fits; the cache is only for speed, the split is a
    function of the key.
    """
    if taken := {LABEL, WEIGHT, FEATURES} & set(df.columns):
        raise ValueError(f"the model's own names are columns: {sorted(taken)}")
    data, indexer = labelled(df, target, task)
    flag = unused(data.columns, "is_test")
    if task == REGRESSION:
        split = random_split(data, test_size, key, seed, flag)
    else:
        split = stratified_split(data, LABEL, test_size, key, seed, flag)
    split = split.persist()
    train, test = split.where(f"NOT {flag}").drop(flag), split.where(flag).drop(flag)
    preparation = fit_preparation(train, numeric, categorical)
    n_train = train.count()
    train_vectors = vectors_of(preparation, train, n_train).persist()
    test_vectors = vectors_of(preparation, test, test.count()).persist()
    n_classes = len(indexer.labels) if indexer else 0

    def fitted_one(ordinal: int, name: str, estimator: Estimator) -> Fitted:
        model = fit_one(task, estimator, train_vectors, n_train)
        return Fitted(name, ordinal, model, scored(task, model.transform(test_vectors)))

    named = candidates(task, n_train, n_classes, seed, sizes)
    # Where rows fill no more than the least tasks, fits wait for jobs to start, not for cores. Larger ones need the memory.
    fitted = together(df.sparkSession, [partial(fitted_one, i, *c) for i, c in enumerate(named)],
                      len(named) if n_train <= ROWS_PER_TASK * LEAST_TASKS else 1)
    for cached in (train_vectors, test_vectors, split):
        cached.unpersist()
    best = max(fitted, key=lambda f: (_score(f, task), -f.ordinal))
    return BakeOff(task, target, preparation, fitted, best, indexer, metrics_table(df, fitted, task), test)


def _score(fitted: Fitted, task: str) -> float:
    value = fitted.scores[headline(task)]
    return float("-inf") if value is None else value


def metrics_table(df: DataFrame, fitted: list[Fitted], task: str) -> DataFrame:
    """One row per candidate."""
    names = ["r2", "mae", "rmse"] if task == REGRESSION else ["balanced_accuracy", "accuracy", "f1_macro"]
    rows = [(f.ordinal, f.name, *[f.scores[n] for n in names]) for f in fitted]
    schema = "model_ordinal int, model string, " + ", ".join(f"{n} double" for n in names)
    return df.sparkSession.createDataFrame(rows, schema)


@dataclass
class Refit:
    """The winner fitted again, with its preparation, on all rows."""

    task: str
    preparation: Preparation
    model: Model

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.preparation.transform(df))

    def predict_encoded(self, encoded: DataFrame) -> DataFrame:
        return self.model.transform(self.preparation.assemble(encoded))


def refit(df: DataFrame, outcome: BakeOff, seed: int = 42, sizes: ModelSizes = ModelSizes()) -> Refit:
    """Fit the winning candidate on all of ``df``, which carries ``label``."""
    preparation = fit_preparation(df, outcome.preparation.numeric, outcome.preparation.categorical)
    n_rows = df.count()
    vectors = vectors_of(preparation, df, n_rows).persist()
    n_classes = len(outcome.labels.labels) if outcome.labels else 0
    estimators = dict(candidates(outcome.task, n_rows, n_classes, seed, sizes))
    model = fit_one(outcome.task, estimators[outcome.best.name], vectors, n_rows)
    vectors.unpersist()
    return Refit(outcome.task, preparation, model)
