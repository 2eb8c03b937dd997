"""Checking SQL for the registered queries, written for the test tables and apart from the Spark code."""

from __future__ import annotations

from tabscope.catalog.tables import KEYS, RELATIONS, SCHEMAS, Relation

CLASSES = {"bigint": "integer", "int": "integer", "double": "float", "timestamp": "datetime", "string": "text",
           "array": "unknown"}
FORMATS = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ",
           "%d-%m-%Y", "%m-%d-%Y"]
TOKENS = "('true','false','t','f','yes','no','y','n','0','1')"


def _time_text(expr: str) -> str:
    return (f"CASE WHEN {expr} = date_trunc('second', {expr}) THEN strftime({expr}, '%Y-%m-%d %H:%M:%S') "
            f"ELSE strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') END")


def _column_facts(r: Relation, i: int, c: str, kind: str, frequencies: bool, steps: bool) -> str:
    numeric = kind in ("bigint", "int", "double")
    null_d, null_s = "NULL::DOUBLE", "NULL::VARCHAR"
    low = high = std = share = null_d
    low_text = high_text = example = null_s
    boolean_share = rate = null_d
    all_dates = "false"
    dominance = entropy = mono = null_d
    if numeric:
        low, high = f"min({c})::DOUBLE", f"max({c})::DOUBLE"
        std = f"stddev_samp({c}::DOUBLE)"
        share = f"avg((abs({c} - round({c}::DOUBLE, 0)) < 1e-9)::INT)::DOUBLE"
        if kind != "double":
            low_text, high_text = f"min({c})::VARCHAR", f"max({c})::VARCHAR"
    if kind == "timestamp":
        low_text, high_text = _time_text(f"min({c})"), _time_text(f"max({c})")
    if kind == "string":
        boolean_share = f"avg((lower(trim({c})) IN {TOKENS})::INT)::DOUBLE"
        formats = [(f, 0) for f in FORMATS] + list(r.formats)
        rates = [f"avg((try_strptime({c}, '{f}') IS NOT NULL)::INT) FILTER ({c} IS NOT NULL)" for f, _ in formats]
        wins = " ".join(f"WHEN {x} >= 0.9 THEN {x}" for x in rates)
        rate = f"coalesce(CASE {wins} ELSE greatest({', '.join(rates)}) END, 0)::DOUBLE"
        all_dates = f"coalesce(greatest({', '.join(rates)}) = 1, true)"
        for edge, fn in (("low", "min"), ("high", "max")):
            cases = " ".join(
                f"WHEN {x} >= 0.9 THEN {_time_text(f"({fn}(try_strptime({c}, '{f}')) - to_minutes({shift}))")} || '+00:00'"
                for x, (f, shift) in zip(rates, formats))
            if edge == "low":
                low_text = f"CASE {cases} END"
            else:
                high_text = f"CASE {cases} END"
    if r.key and kind in ("bigint", "int", "string"):
        example = f"arg_min({c}, {r.key}) FILTER ({c} IS NOT NULL)::VARCHAR"
    if r.key and kind == "timestamp":
        example = f"arg_min({_time_text(c)}, {r.key}) FILTER ({c} IS NOT NULL)"
    if frequencies and kind != "array":
        counts = f"(SELECT count(*) AS n FROM {r.source} WHERE {c} IS NOT NULL GROUP BY {c})"
        shares = f"(SELECT n::DOUBLE / sum(n) OVER () AS p, count(*) OVER () AS k FROM {counts})"
        dominance = f"(SELECT max(p) FROM {shares})"
        entropy = f"(SELECT CASE WHEN max(k) > 1 THEN sum(-p * log2(p + 1e-12)) / (log2(max(k)) + 1e-12) ELSE 0 END FROM {shares})"
    if steps and numeric:
        diffs = f"(SELECT {c} - lag({c}) OVER (ORDER BY {r.key}) AS d FROM {r.source} WHERE {c} IS NOT NULL)"
        mono = (f"(SELECT CASE WHEN count(*) < 3 THEN 0 ELSE greatest(avg((d >= 0)::INT), avg((d <= 0)::INT)) END "
                f"FROM {diffs})")
    return (
        f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{CLASSES[kind]}' AS cls, {str(numeric).lower()} AS is_numeric, "
        f"count(*) AS n_rows, count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_missing, "
        f"{low} AS min_numeric, {high} AS max_numeric, {std} AS std, {share} AS integer_share, "
        f"{low_text} AS low_text, {high_text} AS high_text, {example} AS example, {boolean_share} AS boolean_share, "
        f"{rate} AS rate, {all_dates} AS all_dates, {dominance} AS dominance, {entropy} AS entropy, {mono} AS mono "
        f"FROM {r.source}"
    )


def facts(r: Relation, frequencies: bool = False, steps: bool = False) -> str:
    """CTEs ``f`` (raw facts) and ``p`` (profile) over one relation."""
    union = " UNION ALL ".join(_column_facts(r, i, c, k, frequencies, steps) for i, (c, k) in enumerate(r.columns))
    return f"""WITH f AS ({union}),
    p AS (SELECT *, n_unique::DOUBLE / n_rows AS unique_ratio, n_missing::DOUBLE / n_rows AS missing_ratio,
        n_missing = 0 AND n_unique = n_rows AS is_unique,
        n_unique = 1 OR (n_unique = 0 AND n_missing > 0) AS is_constant,
        CASE WHEN cls <> 'text' THEN cls
             WHEN coalesce(boolean_share, 0) >= 0.98 THEN 'boolean'
             WHEN rate >= 0.9 THEN 'datetime'
             WHEN n_unique <= 50 OR n_unique <= 0.05 * n_rows THEN 'categorical' ELSE 'text' END AS semantic_type
        FROM f)"""


PROFILE_SELECT = """SELECT ordinal::INT AS ordinal, "column", semantic_type, n_rows::BIGINT AS n_rows, n_unique::BIGINT AS n_unique,
    round(unique_ratio, 6) AS unique_ratio, is_unique, n_missing::BIGINT AS n_missing, round(missing_ratio, 6) AS missing_ratio,
    is_constant, round(min_numeric, 6) AS min_numeric, round(max_numeric, 6) AS max_numeric,
    CASE WHEN cls <> 'text' OR semantic_type = 'datetime' THEN low_text END AS min_text,
    CASE WHEN cls <> 'text' OR semantic_type = 'datetime' THEN high_text END AS max_text, example,
    CASE WHEN cls = 'text' AND semantic_type <> 'boolean' THEN round(rate, 6) END AS datetime_parse_rate FROM p"""


def profile_sql(name: str) -> str:
    return facts(RELATIONS[name]) + PROFILE_SELECT


NAME_SCORE = r"""(CASE WHEN regexp_matches(lower("column"), '^(is_|has_|was_|will_)') THEN 2.5 ELSE 0 END
 + CASE WHEN regexp_matches(lower("column"), '\b(churn|default|fraud|spam|success|win|lose|click|convert|closed|won|lost)\b') THEN 3.0 ELSE 0 END
 + CASE WHEN regexp_matches(lower("column"), '\b(class|label|target|y|outcome|result)\b') THEN 2.5 ELSE 0 END
 + CASE WHEN regexp_matches(lower("column"), '\b(price|amount|revenue|sales|profit|loss|score|rating|cost|value|age|count|qty|quantity)\b') THEN 2.5 ELSE 0 END
 - CASE WHEN regexp_matches(lower("column"), '\b(id|uuid|guid|pk|hash|session|token|user_id|customer_id|invoice_id)\b') THEN 4.0 ELSE 0 END
 - CASE WHEN regexp_matches(lower("column"), '\b(name|title|description|address|street|postal|zipcode|zip|email|phone)\b') THEN 1.5 ELSE 0 END
 - CASE WHEN regexp_matches(lower("column"), '\b(date|time|timestamp|ts|created|updated)\b') THEN 1.0 ELSE 0 END)::DOUBLE"""

SCORES = f""", s AS (SELECT *, {NAME_SCORE} AS name_score,
    (CASE WHEN semantic_type IN ('integer','float') THEN 2.0 WHEN semantic_type IN ('boolean','categorical') THEN 1.5
          WHEN semantic_type = 'text' THEN 0.3 ELSE -1.0 END)::DOUBLE AS type_score,
    (CASE WHEN is_constant THEN -10 WHEN is_unique THEN -4 ELSE
        CASE WHEN missing_ratio > 0.6 THEN -3 WHEN missing_ratio > 0.3 THEN -1.5 WHEN missing_ratio > 0.1 THEN -0.5 ELSE 0.5 END
        + CASE WHEN semantic_type IN ('integer','float') THEN
                 CASE WHEN n_unique >= greatest(20, floor(0.05 * n_rows)) THEN 2 WHEN n_unique >= 10 THEN 1 ELSE -0.5 END
               WHEN semantic_type IN ('boolean','categorical') THEN
                 CASE WHEN n_unique = 2 THEN 2 WHEN n_unique BETWEEN 3 AND 50 THEN 1 ELSE -0.5 END
               ELSE -0.2 END END)::DOUBLE AS quality_score FROM p),
    h AS (SELECT *, name_score + type_score + quality_score AS total,
        NOT is_constant AND n_unique >= 2 AND semantic_type NOT IN ('datetime','unknown') AS eligible FROM s)"""

SCORE_SELECT = """SELECT (row_number() OVER (ORDER BY round(total, 6) DESC, ordinal))::INT AS position, "column", round(name_score, 6) AS name_score,
    round(type_score, 6) AS type_score, round(quality_score, 6) AS quality_score, round(total, 6) AS total,
    n_unique::BIGINT AS n_unique, round(missing_ratio, 6) AS missing_ratio, semantic_type, is_unique, is_constant FROM h"""


def heuristic_scores_sql(name: str) -> str:
    return facts(RELATIONS[name]) + SCORES + SCORE_SELECT


def _per_table(make, names) -> str:
    return " UNION ALL ".join(f"(SELECT '{t}' AS table_name, * FROM ({make(t)}))" for t in names)


def pick_sql(name: str, n: int = 1, only_eligible: bool = True) -> str:
    where = "WHERE eligible" if only_eligible else ""
    return (facts(RELATIONS[name]) + SCORES + f"SELECT \"column\", round(total, 6) AS total FROM h {where} "
            f"ORDER BY round(total, 6) DESC, ordinal LIMIT {n}")


RANKS = r""", k AS (SELECT *, CASE WHEN is_numeric THEN 'numeric' WHEN cls = 'datetime' OR all_dates THEN 'temporal' ELSE 'categorical' END AS kind,
        regexp_matches(lower("column"), '(id|uuid|guid|code|pk|hash|no|number|index)') OR n_unique >= 0.9::DOUBLE * n_rows AS reject_id_like
        FROM p),
    t AS (SELECT *, kind = 'temporal' AS reject_temporal, reject_id_like OR kind = 'temporal' AS reject,
        CASE WHEN kind = 'numeric' THEN (std > 0)::INT * (1 - missing_ratio) * log2(1 + n_unique) * (1 - mono) * (1 + n_unique::DOUBLE / n_rows) END AS regression_score,
        CASE WHEN kind = 'categorical' THEN (n_unique >= 2 AND n_unique <= greatest(2, least(50, floor(0.3 * n_rows))))::INT
            * (1 - missing_ratio) * (1 - coalesce(dominance, 1)) * (0.5 + 0.5 * coalesce(entropy, 0)) END AS classification_score,
        CASE WHEN kind = 'categorical' THEN 'classification'
             WHEN kind = 'numeric' AND n_unique <= greatest(20, floor(0.05 * n_rows)) AND coalesce(integer_share, 0) >= 0.95 THEN 'classification'
             ELSE 'regression' END AS task_statistical,
        CASE WHEN is_numeric THEN 'regression' ELSE 'classification' END AS task_by_type FROM k),
    g AS (SELECT *, coalesce(regression_score, classification_score) AS candidate_score FROM t)"""


def ranking_sql(name: str) -> str:
    return facts(RELATIONS[name], True, True) + RANKS + """SELECT
    (row_number() OVER (ORDER BY reject, round(candidate_score, 6) DESC NULLS LAST, ordinal))::INT AS position, "column", kind,
    round(missing_ratio, 4) AS missing_ratio, n_unique::BIGINT AS n_unique,
    CASE WHEN kind = 'numeric' THEN round(mono, 4) END AS monotonicity,
    CASE WHEN kind = 'categorical' THEN round(coalesce(dominance, 1), 4) END AS dominance,
    CASE WHEN kind = 'categorical' THEN round(coalesce(entropy, 0), 4) END AS entropy_norm,
    round(regression_score, 6) AS regression_score, round(classification_score, 6) AS classification_score,
    round(candidate_score, 6) AS candidate_score, reject_id_like, reject_temporal, reject, task_statistical FROM g"""


def task_sql(name: str) -> str:
    return facts(RELATIONS[name]) + RANKS + 'SELECT "column", kind, task_statistical, task_by_type FROM t'


def _notes_sql(name: str) -> str:
    return facts(RELATIONS[name]) + """SELECT ordinal::INT AS ordinal, "column", 'missing' AS kind,
      printf('Column ''%s'' has a high share of missing values: %.1f%%.', "column", 100 * missing_ratio) AS note FROM p WHERE missing_ratio >= 0.3
    UNION ALL SELECT ordinal::INT, "column", 'constant', printf('Column ''%s'' is constant.', "column") FROM p WHERE is_constant
    UNION ALL SELECT ordinal::INT, "column", 'identifier', printf('Column ''%s'' looks like an identifier but is not unique.', "column")
      FROM p WHERE lower("column") IN ('id','uuid','pk','primary_key') AND NOT is_unique"""


def _digest_sql(name: str, limit: int) -> str:
    return facts(RELATIONS[name]) + f"""SELECT ordinal::INT AS ordinal, printf('- %s | type=%s | n_unique=%d | missing_ratio=%.2f | is_unique=%s | is_constant=%s',
      "column", semantic_type, n_unique, missing_ratio, CASE WHEN is_unique THEN 'True' ELSE 'False' END,
      CASE WHEN is_constant THEN 'True' ELSE 'False' END) AS line FROM p WHERE ordinal < {limit}
    UNION ALL SELECT {limit}::INT, printf('... (+%d more)', count(*)) FROM p WHERE ordinal >= {limit} HAVING count(*) > 0"""


def hash_sql(key: str) -> str:
    return f"('0x' || substr(md5('42|' || {key}), 1, 8))::BIGINT"


FLAT = [t for t in SCHEMAS if t != "embeddings"]
RANKED = [t for t in KEYS if t != "embeddings"]

RESPONSE_SQL = """CASE event_id % 8
    WHEN 0 THEN '{"target": "' || name || '", "confidence": ' || conf || ', "reason": "clear"}'
    WHEN 1 THEN '```json' || chr(10) || '{"target": "' || name || '", "confidence": ' || conf || '}' || chr(10) || '```'
    WHEN 2 THEN '```' || '{"target": "' || name || '"}' || '```'
    WHEN 3 THEN 'I suggest {"target": "' || name || '", "confidence": ' || conf || '} for this table.'
    WHEN 4 THEN 'no idea'
    WHEN 5 THEN '{"confidence": ' || conf || '}'
    WHEN 6 THEN '{"target": "' || name || '", "confidence": "high"}'
    ELSE '[1, 2]' END"""
NAME_SQL = """CASE event_id % 7 WHEN 0 THEN 'user_id' WHEN 1 THEN 'ts' WHEN 2 THEN 'event_type' WHEN 3 THEN 'nope'
    WHEN 4 THEN 'props' WHEN 5 THEN 'event_id' ELSE 'user_id' END"""

_SUGGESTED = f"""WITH base AS (SELECT event_id, {NAME_SQL} AS name, printf('0.%02d', user_id % 100) AS conf FROM events),
    r AS (SELECT *, trim({RESPONSE_SQL}) AS response FROM base),
    b AS (SELECT *, CASE WHEN response LIKE '```%' THEN trim(replace(replace(response, '```json', ''), '```', ''), ' ' || chr(10)) ELSE response END AS bare FROM r),
    j AS (SELECT *, CASE WHEN json_valid(bare) THEN bare WHEN json_valid(regexp_extract(bare, '\\{{[^{{}}]*\\}}')) THEN regexp_extract(bare, '\\{{[^{{}}]*\\}}') END AS doc FROM b),
    x AS (SELECT *, CASE WHEN doc IS NULL THEN 'no_json' WHEN json_type(doc) <> 'OBJECT' THEN 'no_object'
        WHEN json_type(doc, '$.confidence') = 'VARCHAR' THEN 'bad_confidence'
        WHEN json_extract_string(doc, '$.target') IS NULL THEN 'no_target' ELSE 'ok' END AS status,
        json_extract_string(doc, '$.target') AS target, coalesce(json_extract(doc, '$.confidence')::DOUBLE, 0) AS confidence
        FROM (SELECT *, NULL FROM j WHERE doc IS NULL OR json_type(doc) <> 'OBJECT' OR json_type(doc, '$.confidence') IS DISTINCT FROM 'VARCHAR')
        UNION ALL SELECT *, NULL, 'bad_confidence', NULL, 0 FROM j WHERE json_type(doc, '$.confidence') = 'VARCHAR')"""


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    for t in [*SCHEMAS, "orders_gaps", "orders_text_dates", "orders_more_dates", "orders_flags"]:
        sql[f"profile_{t}"] = profile_sql(t)
    for t in [*FLAT, "orders_gaps"]:
        sql[f"heuristic_scores_{t}"] = heuristic_scores_sql(t)
    for t in [*RANKED, "orders_gaps", "orders_text_dates", "orders_more_dates"]:
        sql[f"target_ranking_{t}"] = ranking_sql(t)
    for t in ("lineitem", "events"):
        sql[f"profile_approximate_{t}"] = facts(RELATIONS[t]) + (
            'SELECT "column", semantic_type, is_unique, is_constant, n_missing::BIGINT AS n_missing, '
            "round(min_numeric, 6) AS min_numeric FROM p")
    sql["heuristic_pick"] = _per_table(pick_sql, FLAT)
    sql["top_candidates"] = _per_table(lambda t: pick_sql(t, 5, False), ["lineitem", "orders", "events", "part"])
    sql["task_types"] = _per_table(task_sql, ["orders", "part", "labels", "events", "lineitem", "customer"])
    sql["name_scores"] = _per_table(
        lambda t: facts(RELATIONS[t]) + SCORES + ", q AS (SELECT * FROM h) SELECT \"column\", name_score, "
        "regexp_matches(lower(\"column\"), '(id|uuid|guid|code|pk|hash|no|number|index)') OR n_unique >= 0.9::DOUBLE * n_rows AS id_like FROM q",
        FLAT)
    sql["key_candidates"] = _per_table(
        lambda t: facts(RELATIONS[t]) + 'SELECT ordinal::INT AS ordinal, "column" FROM p WHERE is_unique AND missing_ratio = 0', list(SCHEMAS))
    sql["missing_profile"] = facts(RELATIONS["orders_gaps"]) + (
        'SELECT "column", n_missing::BIGINT AS n_missing, round(missing_ratio, 6) AS missing_ratio FROM p WHERE missing_ratio > 0.1')
    sql["table_notes"] = _notes_sql("orders_gaps")
    sql["profile_digest"] = _digest_sql("part", 60)
    sql["profile_digest_capped"] = _digest_sql("lineitem", 4)
    sql["profile_sorted"] = facts(RELATIONS["lineitem"]) + (
        'SELECT (row_number() OVER (ORDER BY n_unique DESC, ordinal))::INT AS position, "column", n_unique::BIGINT AS n_unique FROM p')
    sql["value_counts_events"] = """SELECT 'event_type' AS "column", event_type AS value, count(*)::BIGINT AS cnt FROM events GROUP BY ALL
        UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*)::BIGINT FROM events GROUP BY ALL"""
    for t in ("orders", "part", "documents", "lineitem"):
        sql[f"dominance_entropy_{t}"] = facts(RELATIONS[t], True) + (
            'SELECT "column", n_unique::BIGINT AS n_unique, round(dominance, 6) AS dominance, round(entropy, 6) AS entropy FROM p')
    sql["column_modes"] = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", arg_min(v, struct_pack(c := -n, v := v))::VARCHAR AS value, max(n)::BIGINT AS cnt "
        f"FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1)" for c in ("o_orderpriority", "o_orderstatus", "o_custkey"))
    sql["column_preview"] = """SELECT 'o_orderpriority' AS "column", count(DISTINCT o_orderpriority)::BIGINT AS n_unique, 0::BIGINT AS n_missing,
          0::DOUBLE AS missing_percent, NULL::DOUBLE AS min, NULL::DOUBLE AS max, 'classification' AS task,
          (SELECT arg_min(v, struct_pack(c := -n, v := v)) FROM (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1)) AS mode FROM orders
        UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice)::BIGINT, 0::BIGINT, 0::DOUBLE, round(min(o_totalprice), 2),
          round(max(o_totalprice), 2), 'regression', NULL FROM orders"""
    sql["integer_share"] = """SELECT 'l_quantity' AS "column", round(avg((abs(l_quantity - round(l_quantity, 0)) < 1e-9)::INT), 6) AS integer_share FROM lineitem
        UNION ALL SELECT 'l_discount', round(avg((abs(l_discount - round(l_discount, 0)) < 1e-9)::INT), 6) FROM lineitem
        UNION ALL SELECT 'l_extendedprice', round(avg((abs(l_extendedprice - round(l_extendedprice, 0)) < 1e-9)::INT), 6) FROM lineitem"""
    sql["numeric_coercion"] = """SELECT l_linenumber::INT AS l_linenumber, count(n)::BIGINT AS numbers, (count(*) - count(n))::BIGINT AS others, round(sum(n), 4) AS total
        FROM (SELECT l_linenumber, TRY_CAST(CASE WHEN l_orderkey % 10 = 0 THEN 'x' WHEN l_orderkey % 10 = 1 THEN l_partkey::VARCHAR || 'd'
          ELSE l_partkey::VARCHAR END AS DOUBLE) AS n FROM lineitem) GROUP BY 1"""
    for t, key, columns in (("events", "event_id", ["user_id", "value"]), ("orders", "o_orderkey", ["o_custkey", "o_totalprice"])):
        sql[f"monotonicity_{t}"] = " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS n_values, count_if(d >= 0)::BIGINT AS rising, count_if(d <= 0)::BIGINT AS falling, "
            f"round(greatest(count_if(d >= 0), count_if(d <= 0)) / count(d)::DOUBLE, 6) AS monotonicity "
            f"FROM (SELECT {c} - lag({c}) OVER (ORDER BY {key}) AS d FROM {t})" for c in columns)
    sql["row_numbers"] = """SELECT o_orderkey, (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1)::BIGINT AS row_index FROM orders"""
    sql["row_numbers_within"] = """SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1)::BIGINT AS row_index FROM orders"""
    sql["permutation_check"] = """SELECT r.repeat::INT AS repeat, count(*)::BIGINT AS n, count(*)::BIGINT AS n_distinct, 0::BIGINT AS lowest, (count(*) - 1)::BIGINT AS highest
        FROM lineitem, (SELECT unnest([0, 1, 2]) AS repeat) r GROUP BY 1"""
    sql["sample_exact"] = f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT 1000"
    sql["split_random"] = (f"SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql('o_orderkey')}, o_orderkey) <= "
                           "ceil(0.2::DOUBLE * (SELECT count(*) FROM orders)) AS is_test FROM orders")
    sql["split_stratified"] = (f"SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hash_sql('o_orderkey')}, o_orderkey) <= "
                               "round(0.2::DOUBLE * count(*) OVER (PARTITION BY o_orderpriority)) AS is_test FROM orders")
    sql["class_weights"] = """SELECT o_orderstatus AS label, count(*)::BIGINT AS n,
        round((SELECT count(*) FROM orders)::DOUBLE / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * count(*)), 6) AS weight FROM orders GROUP BY 1"""
    gaps = RELATIONS["orders_gaps"].source
    mode = "(SELECT arg_min(v, struct_pack(c := -n, v := v)) FROM (SELECT {0} AS v, count(*) AS n FROM " + gaps + " WHERE {0} IS NOT NULL GROUP BY 1))"
    sql["impute_values"] = f"""SELECT 'o_custkey' AS "column", median(o_custkey)::DOUBLE AS number, NULL::VARCHAR AS text FROM {gaps}
        UNION ALL SELECT 'o_totalprice', round(median(o_totalprice), 6), NULL FROM {gaps}
        UNION ALL SELECT 'o_orderstatus', NULL, {mode.format('o_orderstatus')} UNION ALL SELECT 'o_orderpriority', NULL, {mode.format('o_orderpriority')}"""
    sql["impute_apply"] = f"""SELECT o_orderkey, round(coalesce(o_custkey, (SELECT median(o_custkey) FROM {gaps}))::DOUBLE, 6) AS o_custkey,
        round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM {gaps})), 6) AS o_totalprice,
        coalesce(o_orderstatus, {mode.format('o_orderstatus')}) AS o_orderstatus,
        coalesce(o_orderpriority, {mode.format('o_orderpriority')}) AS o_orderpriority FROM {gaps}"""
    sql["scale_values"] = """SELECT l_orderkey, l_linenumber, round(l_quantity / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS quantity,
        round(l_tax / (SELECT stddev_pop(l_tax) FROM lineitem), 6) AS tax FROM lineitem"""
    sql["onehot_apply"] = """SELECT p_partkey, d.slot::INT AS slot, (p_type = d.v)::INT::DOUBLE AS value FROM part,
        (SELECT v, row_number() OVER (ORDER BY v) - 1 AS slot FROM (SELECT DISTINCT p_type AS v FROM part)) d"""
    sql["onehot_wide"] = """WITH r AS (SELECT 'lineitem' AS relation, l_orderkey::BIGINT AS row_key, l_linenumber::BIGINT AS line, l_shipdate::VARCHAR AS v FROM lineitem
        UNION ALL SELECT 'orders', o_orderkey::BIGINT, 0::BIGINT, o_custkey::VARCHAR FROM orders),
        d AS (SELECT relation, v, row_number() OVER (PARTITION BY relation ORDER BY v) - 1 AS slot, count(*) OVER (PARTITION BY relation) AS width
          FROM (SELECT DISTINCT relation, v FROM r))
        SELECT relation, row_key, line, slot::BIGINT AS slot, width::BIGINT AS width FROM r JOIN d USING (relation, v)"""
    sql["regression_metrics"] = """SELECT n::BIGINT AS n, round(1 - sse / sst, 6) AS r2, round(mae, 4) AS mae, round(sqrt(sse / n), 4) AS rmse FROM (
        SELECT count(*) AS n, sum((l_extendedprice - 1500 * l_quantity) ** 2) AS sse, var_pop(l_extendedprice) * count(*) AS sst,
        avg(abs(l_extendedprice - 1500 * l_quantity)) AS mae FROM lineitem)"""
    sql["classification_metrics"] = """WITH c AS (SELECT DISTINCT quality AS k FROM labels UNION SELECT DISTINCT toxic FROM labels),
        s AS (SELECT k, (SELECT count(*) FROM labels WHERE quality = k) AS support, (SELECT count(*) FROM labels WHERE toxic = k) AS predicted,
          (SELECT count(*) FROM labels WHERE toxic = k AND quality = k) AS hits FROM c)
        SELECT sum(support)::BIGINT AS n, round(avg(CASE WHEN support > 0 THEN hits::DOUBLE / support END), 6) AS balanced_accuracy,
          round(sum(hits)::DOUBLE / sum(support), 6) AS accuracy, round(avg(2.0 * hits / (support + predicted)), 6) AS f1_macro FROM s"""
    sql["linear_fit"] = """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem"""
    sql["csv_scan"] = f"""SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_totalprice, o_orderstatus, o_orderpriority,
        NULL::DOUBLE AS nothing, (o_orderkey % 2 = 0) AS even, strftime(o_orderdate, '%Y-%m-%d') AS day,
        'line one' || chr(10) || 'and "two", ' || o_orderkey AS remark
        FROM (SELECT o.o_orderdate, g.* FROM {gaps} g JOIN orders o USING (o_orderkey))"""
    profiled = facts(RELATIONS["events"]).replace("WITH f AS", ", f AS")
    sql["suggestion_verdicts"] = _SUGGESTED + profiled + """ SELECT verdict, target, count(*)::BIGINT AS n, round(avg(confidence), 6) AS confidence FROM (
        SELECT CASE WHEN status <> 'ok' THEN status WHEN p."column" IS NULL THEN 'unknown_column' WHEN is_constant THEN 'constant'
          WHEN n_unique < 2 THEN 'too_few_values' WHEN semantic_type IN ('datetime','unknown') THEN 'wrong_type' ELSE 'accepted' END AS verdict,
          CASE WHEN status = 'ok' THEN target END AS target, CASE WHEN status = 'ok' THEN confidence END AS confidence
        FROM x LEFT JOIN p ON x.target = p."column") GROUP BY 1, 2"""
    sql["decision_chain"] = _SUGGESTED + profiled + SCORES + """,
        best AS (SELECT target FROM x JOIN p ON x.target = p."column" WHERE status = 'ok' AND NOT is_constant AND n_unique >= 2
            AND semantic_type NOT IN ('datetime','unknown') ORDER BY confidence DESC, ordinal LIMIT 1),
        heur AS (SELECT "column" AS target FROM h WHERE eligible ORDER BY total DESC, ordinal LIMIT 1)
        SELECT 'user' AS scenario, 'event_type' AS target, 'user_choice' AS source
        UNION ALL SELECT 'bad_user_then_suggestion', target, 'suggestion' FROM best
        UNION ALL SELECT 'bad_user_no_suggestion', target, 'heuristics' FROM heur
        UNION ALL SELECT 'only_heuristics', target, 'heuristics' FROM heur"""
    sql["ranking_decision"] = facts(RELATIONS["events"], True, True) + RANKS + """
        SELECT 'user' AS scenario, "column" AS target, 'user_choice' AS source, task_statistical AS task FROM g WHERE "column" = 'user_id'
        UNION ALL SELECT 'suggestion', "column", 'suggestion', task_statistical FROM g WHERE "column" = 'ts'
        UNION ALL (SELECT 'ranking', "column", 'ranking', task_statistical FROM g ORDER BY reject, candidate_score DESC NULLS LAST, ordinal LIMIT 1)"""
    sql["ranking_fallback"] = _per_table(
        lambda t: facts(RELATIONS[t], True, True) + RANKS + 'SELECT "column", reject FROM g ORDER BY reject, round(candidate_score, 6) DESC NULLS LAST, ordinal LIMIT 1',
        ["region", "pages", "benchmark", "labels"])
    return sql
