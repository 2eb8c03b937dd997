"""Registered queries. Each takes (spark, directory of the tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.catalog.oracles import FLAT, RANKED
from tabscope.catalog.tables import RELATIONS, SCHEMAS
from tabscope.functions.values import coerced_number, integer_share
from tabscope.operators import (
    decide,
    frequencies,
    heuristics,
    importance,
    metrics,
    models,
    order,
    prep,
    ranking,
    sampling,
    suggestions,
)
from tabscope.operators import profile as pf
from tabscope.plans.job import run
from tabscope.plans.training import train
from tabscope.session import dealt, materialised, scratch_path
from tabscope.sources.csv import read_csv

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return RELATIONS[name].read(spark, sf_dir)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _per_table(spark: SparkSession, sf_dir: str, names: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return _union([make(_read(spark, sf_dir, t)).withColumn("table_name", F.lit(t)) for t in names])


def _profile(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = RELATIONS[name]
    prof = pf.profile(relation.read(spark, sf_dir), order_by=relation.key)
    # Doubles are compared as numbers, not as text.
    keyed = "example" if relation.key else "CAST(NULL AS STRING)"
    return prof.selectExpr(
        "ordinal", "column", "semantic_type", "n_rows", "n_unique", "round(unique_ratio, 6) AS unique_ratio", "is_unique",
        "n_missing", "round(missing_ratio, 6) AS missing_ratio", "is_constant", "round(min_numeric, 6) AS min_numeric",
        "round(max_numeric, 6) AS max_numeric",
        "CASE WHEN semantic_type != 'float' THEN min_value END AS min_text",
        "CASE WHEN semantic_type != 'float' THEN max_value END AS max_text",
        f"CASE WHEN semantic_type NOT IN ('float', 'unknown') THEN {keyed} END AS example",
        "round(datetime_parse_rate, 6) AS datetime_parse_rate")


def _profile_approximate(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.profile(_read(spark, sf_dir, name), exact=False).selectExpr(
        "column", "semantic_type", "is_unique", "is_constant", "n_missing", "round(min_numeric, 6) AS min_numeric")


def _scores(df: DataFrame) -> DataFrame:
    return heuristics.heuristic_scores(pf.profile(df))


def _heuristic_scores(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    # The window runs over one row per column of the table.
    return _scores(_read(spark, sf_dir, name)).selectExpr(
        "CAST(row_number() OVER (ORDER BY round(total, 6) DESC, ordinal) AS INT) AS position", "column",
        "round(name_score, 6) AS name_score", "round(type_score, 6) AS type_score", "round(quality_score, 6) AS quality_score",
        "round(total, 6) AS total", "n_unique", "round(missing_ratio, 6) AS missing_ratio", "semantic_type", "is_unique",
        "is_constant")


def heuristic_pick(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    return _per_table(spark, sf_dir, names or FLAT, lambda df: heuristics.heuristic_pick(_scores(df)).selectExpr(
        "column", "round(total, 6) AS total"))


def _top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_table(spark, sf_dir, ["lineitem", "orders", "events", "part"],
                      lambda df: heuristics.top_candidates(_scores(df), 5).selectExpr("column", "round(total, 6) AS total"))


def _target_ranking(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = RELATIONS[name]
    return ranking.target_ranking(relation.read(spark, sf_dir), relation.key).selectExpr(
        "CAST(row_number() OVER (ORDER BY reject, round(candidate_score, 6) DESC NULLS LAST, ordinal) AS INT) AS position",
        "column", "kind", "missing_ratio", "n_unique", "monotonicity", "dominance", "entropy_norm",
        "round(regression_score, 6) AS regression_score", "round(classification_score, 6) AS classification_score",
        "round(candidate_score, 6) AS candidate_score", "reject_id_like", "reject_temporal", "reject", "task_statistical")


def _task_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_table(spark, sf_dir, ["orders", "part", "labels", "events", "lineitem", "customer"],
                      lambda df: ranking.task_types(df).drop("ordinal"))


def _name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(df: DataFrame) -> DataFrame:
        return heuristics.name_scores(pf.profile(df)).selectExpr(
            "column", "name_score", "id_marker OR n_unique >= 0.9D * n_rows AS id_like")

    return _per_table(spark, sf_dir, FLAT, one)


def _key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_table(spark, sf_dir, list(SCHEMAS), lambda df: pf.key_candidates(pf.profile(df)))


def _missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.with_many_missing(pf.profile(_read(spark, sf_dir, "orders_gaps"))).selectExpr(
        "column", "n_missing", "round(missing_ratio, 6) AS missing_ratio")


def _table_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.notes(pf.profile(_read(spark, sf_dir, "orders_gaps")))


def _profile_digest(name: str, limit: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.profile_digest(pf.profile(_read(spark, sf_dir, name)), limit)


def _profile_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.sorted_profile(pf.profile(_read(spark, sf_dir, "lineitem")), "n_unique").selectExpr(
        "CAST(row_number() OVER (ORDER BY n_unique DESC, ordinal) AS INT) AS position", "column", "n_unique")


def _profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.profile_json(pf.profile(_read(spark, sf_dir, "part")))


def _value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies.value_counts(_read(spark, sf_dir, "events"), ["event_type", "user_id"])


def _dominance_entropy(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, name)
    names = F.array(*[F.lit(c) for c in df.columns])
    return frequencies.frequency_stats(df).select(
        names[F.col("ordinal")].alias("column"), "n_unique", F.round("dominance", 6).alias("dominance"),
        F.round("entropy", 6).alias("entropy"))


def _column_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies.most_frequent(_read(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])


def _column_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "orders")
    return _union([pf.column_preview(df, c) for c in ("o_orderpriority", "o_totalprice")]).drop("declared_type")


def _integer_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_quantity", "l_discount", "l_extendedprice"]
    wide = _read(spark, sf_dir, "lineitem").agg(*[F.expr(f"round({integer_share(c)}, 6) AS {c}") for c in columns])
    return wide.unpivot([], columns, "column", "integer_share")


def _numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _read(spark, sf_dir, "lineitem").selectExpr(
        "l_linenumber",
        "CASE WHEN l_orderkey % 10 = 0 THEN 'x' WHEN l_orderkey % 10 = 1 THEN concat(l_partkey, 'd') ELSE CAST(l_partkey AS STRING) END AS t")
    return text.selectExpr("l_linenumber", f"{coerced_number('t')} AS n").groupBy("l_linenumber").agg(
        F.expr("count(n) AS numbers"), F.expr("count_if(n IS NULL) AS others"), F.expr("round(sum(n), 4) AS total"))


def _monotonicity(name: str, columns: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, name)
    names = F.array(*[F.lit(c) for c in df.columns])
    return order.monotonicity(df, RELATIONS[name].key, columns).select(
        names[F.col("ordinal")].alias("column"), "n_values", "rising", "falling", F.round("monotonicity", 6).alias("monotonicity"))


def _row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.numbered(_read(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"]).select("o_orderkey", "row_index")


def _row_numbers_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.numbered(_read(spark, sf_dir, "orders"), ["o_orderkey"], within="o_orderstatus").select("o_orderkey", "row_index")


def _permutation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order.numbered(_read(spark, sf_dir, "lineitem").select("l_orderkey"))
    n = rows.count()
    images = {f"image{r}": sampling.permuted_column(F.col("row_index"), rows, n, 42, r) for r in range(3)}
    told = ", ".join(f"named_struct('repeat', {r}, 'image', image{r})" for r in range(3))
    return rows.withColumns(images).selectExpr(f"inline(array({told}))").groupBy("repeat").agg(
        F.expr("count(1) AS n"), F.expr("count(DISTINCT image) AS n_distinct"), F.expr("min(image) AS lowest"),
        F.expr("max(image) AS highest"))


def _sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_exact(_read(spark, sf_dir, "orders"), 1000, ["o_orderkey"]).select("o_orderkey", "o_custkey")


def _split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_split(_read(spark, sf_dir, "orders"), 0.2, ["o_orderkey"]).select("o_orderkey", "is_test")


def _split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(_read(spark, sf_dir, "orders"), "o_orderpriority", 0.2, ["o_orderkey"]).select(
        "o_orderkey", "o_orderpriority", "is_test")


def _class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.class_weights(_read(spark, sf_dir, "orders"), "o_orderstatus").selectExpr(
        "label", "n", "round(weight, 6) AS weight")


_GAP_NUMBERS, _GAP_TEXTS = ["o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]


def _impute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "orders_gaps")
    numbers, texts = prep.medians(df, _GAP_NUMBERS), prep.modes(df, _GAP_TEXTS)
    rows = [(c, round(v, 6), None) for c, v in numbers.items()] + [(c, None, v) for c, v in texts.items()]
    return spark.createDataFrame(rows, "column string, number double, text string")


def _impute_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "orders_gaps")
    numbers, texts = prep.medians(df, _GAP_NUMBERS), prep.modes(df, _GAP_TEXTS)
    filled = prep.imputed(df, {"o_orderkey": 0.0, **numbers}, texts)
    return filled.selectExpr("CAST(o_orderkey AS BIGINT) AS o_orderkey", "round(o_custkey, 6) AS o_custkey",
                             "round(o_totalprice, 6) AS o_totalprice", "o_orderstatus", "o_orderpriority")


def _scale_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.scaled(_read(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]).selectExpr(
        "l_orderkey", "l_linenumber", "round(l_quantity, 6) AS quantity", "round(l_tax, 6) AS tax")


def _onehot_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "part")
    encoded = prep.fit_preparation(df, [], ["p_type"]).transform(df)
    return encoded.select("p_partkey", F.posexplode(vector_to_array(prep.FEATURES)).alias("slot", "value"))


def _onehot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of columns of thousands of values, as the feature vectors hold them."""
    lines = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS row_key", "l_linenumber AS line", "l_shipdate AS value")
    orders = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS row_key", "0 AS line", "CAST(o_custkey AS STRING) AS value")

    def slots(df: DataFrame, name: str) -> DataFrame:
        x = prep.stored(prep.fit_preparation(df, [], ["value"]).transform(df))
        return x.selectExpr(f"'{name}' AS relation", "CAST(row_key AS BIGINT) AS row_key", "CAST(line AS BIGINT) AS line",
                            "CAST(coalesce(get(indices, first_one), first_one, -1) AS BIGINT) AS slot", "CAST(width AS BIGINT) AS width")

    return _union([slots(lines, "lineitem"), slots(orders, "orders")])


def _regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = _read(spark, sf_dir, "lineitem").selectExpr("l_extendedprice AS label", "1500 * l_quantity AS prediction")
    return metrics.regression_scores(guess).selectExpr("n", "round(r2, 6) AS r2", "round(mae, 4) AS mae", "round(rmse, 4) AS rmse")


def _classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = _read(spark, sf_dir, "labels").selectExpr("quality AS label", "toxic AS prediction")
    return metrics.classification_scores(guess).selectExpr(
        "n", "round(balanced_accuracy, 6) AS balanced_accuracy", "round(accuracy, 6) AS accuracy", "round(f1_macro, 6) AS f1_macro")


def _linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_extendedprice").alias(models.LABEL))
    vectors = VectorAssembler(inputCols=["l_quantity"], outputCol=prep.FEATURES).transform(rows)
    estimator: LinearRegression = dict(models.candidates(models.REGRESSION, 0))["LinearRegression"]
    fit = estimator.fit(vectors)
    return spark.createDataFrame([(round(float(fit.coefficients[0]), 4), round(float(fit.intercept), 2))],
                                 "slope double, intercept double")


def _csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write orders with gaps, missing-value words, quotes and line breaks as CSV; read it back typed."""
    gaps = _read(spark, sf_dir, "orders_gaps").drop("same", "id")
    days = _read(spark, sf_dir, "orders").selectExpr("o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS day")
    out = gaps.join(days, "o_orderkey").selectExpr(
        "o_orderkey", "coalesce(CAST(o_custkey AS STRING), 'NA') AS o_custkey",
        "coalesce(CAST(o_totalprice AS STRING), 'n/a') AS o_totalprice", "coalesce(o_orderstatus, 'NULL') AS o_orderstatus",
        "o_orderpriority", "coalesce(nothing, 'None') AS nothing",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS even", "day",
        "concat('line one\\n', 'and \"two\", ', o_orderkey) AS remark")
    path = scratch_path(spark, "csv")
    out.write.csv(path, header=True, escape='"')
    return read_csv(spark, path)


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text response per event, in the shapes in which suggestions arrive."""
    named = _read(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE event_id % 7 WHEN 0 THEN 'user_id' WHEN 1 THEN 'ts' WHEN 2 THEN 'event_type' WHEN 3 THEN 'nope' "
        "WHEN 4 THEN 'props' WHEN 5 THEN 'event_id' ELSE 'user_id' END AS name",
        "format_string('0.%02d', user_id % 100) AS conf")
    full = """concat('{"target": "', name, '", "confidence": ', conf"""
    return named.selectExpr("event_id", f"""CASE event_id % 8
        WHEN 0 THEN {full}, ', "reason": "clear"}}')
        WHEN 1 THEN concat('```json\\n', {full}, '}}'), '\\n```')
        WHEN 2 THEN concat('```', '{{"target": "', name, '"}}', '```')
        WHEN 3 THEN concat('I suggest ', {full}, '}}'), ' for this table.')
        WHEN 4 THEN 'no idea'
        WHEN 5 THEN concat('{{"confidence": ', conf, '}}')
        WHEN 6 THEN concat('{{"target": "', name, '", "confidence": "high"}}')
        ELSE '[1, 2]' END AS response""")


def _suggestion_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = suggestions.parsed_suggestions(_responses(spark, sf_dir))
    checked = suggestions.checked_suggestions(parsed, pf.profile(_read(spark, sf_dir, "events")))
    return checked.groupBy("verdict", "target").agg(F.expr("count(1) AS n"), F.expr("round(avg(confidence), 6) AS confidence"))


def _decision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = materialised(pf.profile(_read(spark, sf_dir, "events")))
    scores = heuristics.heuristic_scores(prof)
    parsed = suggestions.parsed_suggestions(_responses(spark, sf_dir))
    scenarios = {
        "user": decide.choose_target(prof, scores, "event_type", parsed),
        "bad_user_then_suggestion": decide.choose_target(prof, scores, "nope", parsed),
        "bad_user_no_suggestion": decide.choose_target(prof, scores, "nope"),
        "only_heuristics": decide.choose_target(prof, scores, "event_type", parsed, only_heuristics=True),
    }
    return _union([d.select(F.lit(s).alias("scenario"), "target", "source") for s, d in scenarios.items()])


def _ranking_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = materialised(ranking.ranking_scores(_read(spark, sf_dir, "events"), "event_id"))
    scenarios = {
        "user": decide.choose_by_ranking(scores, "user_id", "ts"),
        "suggestion": decide.choose_by_ranking(scores, None, "ts"),
        "ranking": decide.choose_by_ranking(scores),
    }
    return _union([d.withColumn("scenario", F.lit(s)) for s, d in scenarios.items()])


def _ranking_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for t in ("region", "pages", "benchmark", "labels"):
        scores = ranking.ranking_scores(_read(spark, sf_dir, t), RELATIONS[t].key)
        parts.append(ranking.ranking_pick(scores).select("column", "reject", F.lit(t).alias("table_name")))
    return _union(parts)


def _labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the facts of their documents."""
    facts = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return _read(spark, sf_dir, "labels").join(facts, "doc_id")


def _bakeoff_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prep.with_target(_read(spark, sf_dir, "part"), "p_retailprice")
    numeric, categorical = prep.feature_columns(df, "p_retailprice")
    return models.bake_off(df, "p_retailprice", models.REGRESSION, numeric, categorical, key=["p_partkey"]).metrics


def _bakeoff_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prep.with_target(_labelled_documents(spark, sf_dir), "quality")
    numeric, categorical = prep.feature_columns(df, "quality")
    return models.bake_off(df, "quality", models.CLASSIFICATION, numeric, categorical, key=["doc_id"]).metrics


def _linear_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation importance of one linear model of the line price."""
    df = _read(spark, sf_dir, "lineitem")
    target = "l_extendedprice"
    data, _ = models.labelled(prep.with_target(df, target), target, models.REGRESSION)
    numeric, categorical = prep.feature_columns(df, target)
    preparation = prep.fit_preparation(data, numeric, categorical)
    estimator = dict(models.candidates(models.REGRESSION, 0))["LinearRegression"]
    # The fit reads its vectors twice, too seldom to keep them on disk.
    model = models.fit_one(models.REGRESSION, estimator, models.vectors_of(preparation, data, *dealt(data)))
    final = models.Refit(models.REGRESSION, preparation, model)
    features = [c for c in df.columns if c != target]
    return importance.explained(data, features, final)


def _permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(_linear_importance(spark, sf_dir))


def _top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.top_features(importance.importance(_linear_importance(spark, sf_dir)), 5)


def _train_and_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train(_labelled_documents(spark, sf_dir), "toxic", models.CLASSIFICATION, key=["doc_id"]).importance


def _auto_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job on parts; its results are written and read back."""
    result = run(spark, df=_read(spark, sf_dir, "part"), strategy="heuristics", key=["p_partkey"],
                 output=scratch_path(spark, "run"), dataset="part")
    written = spark.read.parquet(result.outputs["importance"])
    return importance.top_features(written, 20).withColumns({
        "target": F.lit(result.target), "task": F.lit(result.task), "source": F.lit(result.source)})


def build() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for t in [*SCHEMAS, "orders_gaps", "orders_text_dates", "orders_more_dates", "orders_flags"]:
        out[f"profile_{t}"] = partial(_profile, t)
    for t in ("lineitem", "events"):
        out[f"profile_approximate_{t}"] = partial(_profile_approximate, t)
    for t in [*FLAT, "orders_gaps"]:
        out[f"heuristic_scores_{t}"] = partial(_heuristic_scores, t)
    for t in [*RANKED, "orders_gaps", "orders_text_dates", "orders_more_dates"]:
        out[f"target_ranking_{t}"] = partial(_target_ranking, t)
    for t in ("orders", "part", "documents", "lineitem"):
        out[f"dominance_entropy_{t}"] = partial(_dominance_entropy, t)
    out |= {
        "heuristic_pick": heuristic_pick,
        "top_candidates": _top_candidates,
        "task_types": _task_types,
        "name_scores": _name_scores,
        "key_candidates": _key_candidates,
        "missing_profile": _missing_profile,
        "table_notes": _table_notes,
        "profile_digest": partial(_profile_digest, "part", 60),
        "profile_digest_capped": partial(_profile_digest, "lineitem", 4),
        "profile_sorted": _profile_sorted,
        "profile_json": _profile_json,
        "value_counts_events": _value_counts,
        "column_modes": _column_modes,
        "column_preview": _column_preview,
        "integer_share": _integer_share,
        "numeric_coercion": _numeric_coercion,
        "monotonicity_events": partial(_monotonicity, "events", ["user_id", "value"]),
        "monotonicity_orders": partial(_monotonicity, "orders", ["o_custkey", "o_totalprice"]),
        "row_numbers": _row_numbers,
        "row_numbers_within": _row_numbers_within,
        "permutation_check": _permutation_check,
        "sample_exact": _sample_exact,
        "split_random": _split_random,
        "split_stratified": _split_stratified,
        "class_weights": _class_weights,
        "impute_values": _impute_values,
        "impute_apply": _impute_apply,
        "scale_values": _scale_values,
        "onehot_apply": _onehot_apply,
        "onehot_wide": _onehot_wide,
        "regression_metrics": _regression_metrics,
        "classification_metrics": _classification_metrics,
        "linear_fit": _linear_fit,
        "csv_scan": _csv_scan,
        "suggestion_verdicts": _suggestion_verdicts,
        "decision_chain": _decision_chain,
        "ranking_decision": _ranking_decision,
        "ranking_fallback": _ranking_fallback,
        "bakeoff_regression": _bakeoff_regression,
        "bakeoff_classification": _bakeoff_classification,
        "permutation_importance": _permutation_importance,
        "top_features": _top_features,
        "train_and_explain": _train_and_explain,
        "auto_run": _auto_run,
    }
    return out
