"""Profile tables, choose a prediction target and explain what drives it, as Spark jobs."""

from tabscope.operators.decide import checked_choices, choose_by_ranking, choose_target
from tabscope.operators.heuristics import heuristic_pick, heuristic_scores, top_candidates
from tabscope.operators.profile import (
    column_preview,
    column_type,
    key_candidates,
    notes,
    profile,
    profile_digest,
    profile_json,
    profile_table,
    sorted_profile,
    table_profile,
    with_many_missing,
)
from tabscope.operators.ranking import ranking_pick, ranking_scores, target_ranking, task_types
from tabscope.operators.sampling import class_weights, random_split, sample_exact, stratified_split
from tabscope.operators.suggestions import checked_suggestions, parsed_suggestions
from tabscope.plans.job import JobResult, available_strategies, run
from tabscope.plans.training import Training, train
from tabscope.sources.csv import read_csv
from tabscope.sources.tables import load, write_results

__all__ = [
    "JobResult", "Training", "available_strategies", "checked_choices", "checked_suggestions", "choose_by_ranking",
    "choose_target", "class_weights", "column_preview", "column_type", "heuristic_pick", "heuristic_scores",
    "key_candidates", "load", "notes", "parsed_suggestions", "profile", "profile_digest", "profile_json",
    "profile_table", "random_split", "ranking_pick", "ranking_scores", "read_csv", "run", "sample_exact",
    "sorted_profile", "stratified_split", "table_profile", "target_ranking", "task_types", "top_candidates", "train",
    "with_many_missing", "write_results",
]
