"""Train and explain one target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tabscope.operators.importance import explained, importance
from tabscope.operators.models import BakeOff, ModelSizes, Refit, bake_off, labelled, refit
from tabscope.operators.prep import feature_columns, with_target


@dataclass
class Training:
    outcome: BakeOff
    final: Refit
    metrics: DataFrame
    importance: DataFrame
    numeric: list[str]
    categorical: list[str]
    skipped: dict[str, str]


def train(df: DataFrame, target: str, task: str, seed: int = 42, test_size: float = 0.2, repeats: int = 5,
          key: list[str] | None = None, importance_on: str = "all",
          sizes: ModelSizes = ModelSizes()) -> Training:
    """Bake-off on a split, refit of the winner on all rows, permutation importance of the raw columns.

    ``importance_on="test"`` instead explains the model of the bake-off on its test rows.
    """
    rows = with_target(df, target)
    numeric, categorical = feature_columns(rows, target)
    outcome = bake_off(rows, target, task, numeric, categorical, seed, test_size, key, sizes)
    if importance_on == "test":
        final = Refit(task, outcome.preparation, outcome.best.model)
        rows_seen = outcome.test
    else:
        rows_seen = labelled(rows, target, task)[0]
        final = refit(rows_seen, outcome, seed, sizes)
    features = [c for c in df.columns if c in final.preparation.slots]
    drops = explained(rows_seen, features, final, repeats, seed, key)
    return Training(outcome, final, outcome.metrics, importance(drops), numeric, categorical, final.preparation.skipped)
