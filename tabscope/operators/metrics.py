"""Model metrics as single aggregations of a prediction relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.values import reference

# A constant label has no variance to explain: 1 for perfect predictions, else 0.
R2 = ("CASE WHEN total > 0 THEN 1 - residual / total WHEN residual = 0 THEN 1D ELSE 0D END")


def regression_scores(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """R2, mean absolute error and root mean squared error, per group if ``by`` is given."""
    y, p = reference(label), reference(prediction)
    sums = df.groupBy(*(by or [])).agg(
        F.expr("count(1) AS n"),
        F.expr(f"sum(({y} - {p}) * ({y} - {p})) AS residual"),
        F.expr(f"var_pop({y}) * count(1) AS total"),
        F.expr(f"avg(abs({y} - {p})) AS mae"))
    return sums.selectExpr(*(by or []), "n", f"{R2} AS r2", "mae", "sqrt(residual / n) AS rmse")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n): at most one row per pair of classes."""
    return df.groupBy(F.col(reference(label)).alias("label"), F.col(reference(prediction)).alias("prediction")).agg(
        F.expr("count(1) AS n"))


def class_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, support, predicted, hits, recall, f1) for every class that is a label or a prediction."""
    cells = confusion(df, label, prediction)
    sides = cells.select(F.expr(
        "inline(array("
        "named_struct('class', label, 'support', n, 'predicted', 0L, 'hits', CASE WHEN label = prediction THEN n ELSE 0L END), "
        "named_struct('class', prediction, 'support', 0L, 'predicted', n, 'hits', 0L)))"))
    totals = sides.groupBy("class").agg(
        F.expr("sum(support) AS support"), F.expr("sum(predicted) AS predicted"), F.expr("sum(hits) AS hits"))
    return totals.selectExpr(
        "class", "support", "predicted", "hits",
        "CASE WHEN support > 0 THEN hits / support END AS recall",
        "2D * hits / (support + predicted) AS f1")


def classification_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Balanced accuracy (mean recall of classes that occur), accuracy, unweighted mean F1."""
    return class_scores(df, label, prediction).agg(
        F.expr("sum(support) AS n"),
        F.expr("avg(recall) AS balanced_accuracy"),
        F.expr("sum(hits) / sum(support) AS accuracy"),
        F.expr("avg(f1) AS f1_macro"))


def best_model(scores: DataFrame, score: str, ordinal: str = "model_ordinal") -> DataFrame:
    """Row with the highest score, the first model on ties."""
    return scores.orderBy(F.col(score).desc_nulls_last(), ordinal).limit(1)
