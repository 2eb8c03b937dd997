"""End-to-end job: read, sample, profile, decide, train, explain, write."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.decide import checked_choices, choose_target
from tabscope.operators.heuristics import heuristic_scores
from tabscope.operators.models import ModelSizes
from tabscope.operators.profile import notes, profile, profile_table
from tabscope.operators.ranking import ranked, ranking_pick, ranking_scores
from tabscope.operators.sampling import sample_exact
from tabscope.operators.suggestions import parsed_suggestions
from tabscope.plans.training import Training, train
from tabscope.session import materialised
from tabscope.sources.tables import load, write_results

STRATEGIES = {
    "auto_ai": "take a suggested column if one is acceptable, else the heuristic pick",
    "heuristics": "pick by column names, types and quality",
    "manual": "take the named column, or the best of the statistical ranking when none is named",
}


@dataclass
class JobResult:
    target: str
    task: str
    source: str
    profile: DataFrame
    scores: DataFrame
    ranking: DataFrame
    training: Training
    outputs: dict[str, str] = field(default_factory=dict)

    @property
    def metrics(self) -> DataFrame:
        return self.training.metrics

    @property
    def importance(self) -> DataFrame:
        return self.training.importance


def available_strategies() -> dict[str, str]:
    return dict(STRATEGIES)


def run(spark: SparkSession, path: str | None = None, df: DataFrame | None = None, strategy: str = "auto_ai",
        target: str | None = None, suggestions: DataFrame | None = None, sample_n: int = 0, seed: int = 42,
        test_size: float = 0.2, repeats: int = 5, task_rule: str = "statistical", key: list[str] | None = None,
        order_by: list[str] | None = None, sizes: ModelSizes = ModelSizes(),
        output: str | None = None, dataset: str | None = None) -> JobResult:
    """Choose a target of a table, model it and explain it.

    ``suggestions`` is a table of text responses in a column ``response``. ``key`` names columns
    that identify a row; samples, splits and importances are then the same for any partitioning.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    if task_rule not in ("statistical", "dtype"):
        raise ValueError("task_rule is 'statistical' or 'dtype'")
    table = load(spark, path, df)
    if sample_n > 0:
        table = sample_exact(table, sample_n, key, seed)
    # One row per column: kept, so that scores, ranking and decision do not scan the table again.
    prof = materialised(profile(table))
    scores = heuristic_scores(prof)
    ranking = materialised(ranking_scores(table, order_by or key, prof))
    chosen, source = _decided(strategy, target, suggestions, prof, scores, ranking)
    if not chosen:
        raise ValueError("no suitable target column")
    facts = ranking.where(F.col("column") == chosen).first()
    task = facts.task_statistical if task_rule == "statistical" else facts.task_by_type
    training = train(table, chosen, task, seed, test_size, repeats, key, sizes=sizes)
    result = JobResult(chosen, task, source, prof, scores, ranked(ranking), training)
    if output:
        name = dataset or (path.rstrip("/").rsplit("/", 1)[-1] if path else "table")
        decision = spark.range(1).select(F.lit(source).alias("source"), F.lit(task).alias("task"))
        result.outputs = write_results(
            {"profile": profile_table(prof), "notes": notes(prof), "scores": scores, "ranking": ranking,
             "decision": decision, "metrics": training.metrics, "importance": training.importance},
            output, name, chosen)
    return result


def _decided(strategy: str, target: str | None, suggestions: DataFrame | None, prof: DataFrame, scores: DataFrame,
             ranking: DataFrame) -> tuple[str | None, str]:
    if strategy == "manual":
        if target is None:
            return ranking_pick(ranking).first()["column"], "ranking"
        choice = checked_choices(prof, prof.sparkSession.range(1).select(F.lit(target).alias("choice"))).first()
        if not choice.accepted:
            raise ValueError(choice.reason)
        return target, "user_choice"
    parsed = parsed_suggestions(suggestions) if suggestions is not None else None
    alone = strategy == "heuristics" or parsed is None
    decision = choose_target(prof, scores, None, None if alone else parsed, only_heuristics=alone).first()
    return decision.target, decision.source
