"""Quality rules as a learned decision list. DataFrame functions only.

Each text is described by a few statistics. From labelled ones, sequential covering learns an ordered list of rules that reject:

* *grow*: start from no condition and add the threshold condition that gains most (first-order information gain over
  label 0) on two thirds of the rows that no earlier rule covers, up to ``MOST_CONDITIONS``;
* *prune*: on the other third, drop trailing conditions while that does not lower (n0 - n1) / (n0 + n1);
* keep the rule if it is right in at least ``precision`` of the cases it covers there and covers ``LEAST_COVERED``;
  take what it covers out and go on; stop at the first rule that fails.

Conditions compare a statistic with a point half-way between two of its quantiles, so all candidates of a step come from one aggregation over
(statistic, bin): the driver sees at most ``len(FEATURES) * (BINS + 1)`` counts, however many rows there are. The list is emitted
as one CASE expression over the statistics, first matching rule first.

The statistics are worked out inside the row: windows of words are hashed, and only rows in which hashes repeat put
them in order. Nothing is exploded, and no text is shuffled.

Defined cases: a null or empty text has no words and fails the base rules. Labels that are null, or neither 0 nor 1,
are left out; of several labels for a document the smallest counts. Without labels the list is empty and rejects nothing.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import written

BLANK = r"r'[\x20\x09-\x0D]+'"
WINDOW = 8  # words in which a repetition is looked for

#: Statistics that conditions may use, as SQL over the columns of :func:`statistics`.
FEATURES = {
    "symbols_per_word": "n_symbols / n_words",
    "chars_per_word": "word_chars / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct_words / n_words",
    "upper_share": "n_upper / word_chars",
    "mark_share": "n_marks / word_chars",
    "words_per_line": "n_words / n_lines",
}
BINS = 32
MOST_RULES = 12
MOST_CONDITIONS = 4
LEAST_COVERED = 5


def _windows(width: int) -> str:
    """SQL over the array w: the hash of each run of ``width`` words."""
    return f"transform(sequence(1, size(w) - {width - 1}), i -> xxhash64(slice(w, i, {width})))"


def statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct_words, n_upper, n_marks)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.expr(f"filter(split(t, {BLANK}), x -> x <> '')"))
    rows = rows.withColumn("l", F.expr("filter(split(t, '\\n'), x -> x rlike r'[^\\x20\\x09-\\x0D]')"))
    rows = rows.withColumn("g", F.expr(f"CASE WHEN size(w) > {WINDOW} THEN {_windows(WINDOW)} ELSE array() END"))
    # Windows that occur again, by position; each covers the words up to the next one, eight at most.
    rows = rows.withColumn("s", F.expr("CASE WHEN size(array_distinct(g)) < size(g) THEN array_sort(transform(g, (h, i) -> struct(h AS h, i AS i))) END"))
    rows = rows.withColumn("p", F.expr(
        "sort_array(transform(filter(transform(s, (x, k) -> struct(x.i AS i, (k > 0 AND s[greatest(k - 1, 0)].h = x.h) "
        "OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = x.h) AS d)), x -> x.d), x -> x.i))"))
    covered = (f"coalesce(aggregate(transform(p, (x, k) -> CASE WHEN k = size(p) - 1 THEN {WINDOW} "
               f"ELSE least({WINDOW}, p[least(k + 1, size(p) - 1)] - x) END), 0L, (a, x) -> a + x), 0L)")
    return rows.selectExpr(
        "doc_id", "CAST(size(w) AS BIGINT) AS n_words", "CAST(length(array_join(w, '')) AS BIGINT) AS word_chars",
        "CAST(regexp_count(t, '[#*$%&|<>]') AS BIGINT) AS n_symbols", "CAST(size(l) AS BIGINT) AS n_lines",
        "CAST(size(l) - size(array_distinct(l)) AS BIGINT) AS n_dup_lines", f"{covered} AS n_repeat_words",
        "CAST(size(array_distinct(w)) AS BIGINT) AS n_distinct_words",
        r"CAST(regexp_count(t, r'\p{Lu}') AS BIGINT) AS n_upper", "CAST(regexp_count(t, '[.!?,;:]') AS BIGINT) AS n_marks")


BASE_FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    @property
    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _sql(rule: Rule) -> str:
    return " AND ".join(c.sql for c in rule)


def as_case(rules: list[Rule]) -> str:
    """The decision list as one SQL expression: whether the text is kept."""
    whens = " ".join(f"WHEN {_sql(rule)} THEN false" for rule in rules)
    return f"CASE {whens} ELSE true END" if rules else "true"


def _edges(rows: DataFrame) -> dict[str, list[float]]:
    """Thresholds of each statistic: half-way between neighbouring quantiles over the labelled rows."""
    at = [i / BINS for i in range(BINS + 1)]
    found = rows.agg(*(F.percentile_approx(F.col(f), at, 2000).alias(f) for f in FEATURES)).head()
    values = {f: sorted({float(x) for x in found[f] or [] if x is not None}) for f in FEATURES}
    return {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}


def _counts(rows: DataFrame, edges: dict[str, list[float]]) -> dict[tuple[str, int], tuple[int, int]]:
    """Rows of label 0 and 1 per statistic and bin; bin k holds values over k thresholds."""
    bins = [f"struct('{f}' AS f, b_{f} AS k)" for f in FEATURES if edges[f]]
    pairs = rows.selectExpr("y", f"explode(array({', '.join(bins)})) AS p")
    counts = pairs.groupBy("p.f", "p.k").agg(F.expr("count_if(y = 0)").alias("n0"), F.expr("count_if(y = 1)").alias("n1"))
    return {(r.f, r.k): (r.n0, r.n1) for r in counts.collect()}  # len(FEATURES) * (BINS + 1) rows at most


def _grow(rows: DataFrame, edges: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS:
        counts = _counts(rows.where(_sql(rule)) if rule else rows, edges)
        any_feature = next((f for f in FEATURES if edges[f]), None)
        n0, n1 = (sum(v[i] for (f, _), v in counts.items() if f == any_feature) for i in (0, 1))
        if not n0 or not n1:
            break
        best, gain = None, 1e-9
        for f in FEATURES:
            below0 = below1 = 0
            for k, threshold in enumerate(edges[f]):
                c0, c1 = counts.get((f, k), (0, 0))
                below0, below1 = below0 + c0, below1 + c1
                for above, p0, p1 in ((False, below0, below1), (True, n0 - below0, n1 - below1)):
                    if p0 >= LEAST_COVERED:
                        now = p0 * (math.log2(p0 / (p0 + p1)) - math.log2(n0 / (n0 + n1)))
                        if now > gain:
                            best, gain = Condition(f, above, threshold), now
        if best is None:
            break
        rule = (*rule, best)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The best prefix of the rule on these rows, and the rows of label 0 and 1 that it covers."""
    parts = [rule[:i] for i in range(1, len(rule) + 1)]
    found = rows.agg(*(F.expr(f"count_if(y = {y} AND {_sql(p)})").alias(f"c{i}_{y}") for i, p in enumerate(parts) for y in (0, 1))).head()
    scored = []
    for i, part in enumerate(parts):
        n0, n1 = found[f"c{i}_0"], found[f"c{i}_1"]
        scored.append(((n0 - n1) / (n0 + n1) if n0 + n1 else -1.0, -len(part), part, n0, n1))
    best = max(scored, key=lambda s: s[:2])
    return best[2:]


def learn(stats: DataFrame, labels: DataFrame, label: str, precision: float = 0.9, doc_id: str = "doc_id") -> list[Rule]:
    """The rules in order, from all labelled rows of ``stats`` that the base rules leave."""
    y = labels.where(f"`{label}` IN (0, 1) AND `{doc_id}` IS NOT NULL").groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("y"))
    rows = stats.where(f"NOT {BASE_FAILED}").join(y, "doc_id")
    names = {f: F.expr(sql) for f, sql in FEATURES.items()}
    rows = written(rows.select("*", *(c.alias(f) for f, c in names.items())).withColumn("prune", F.expr("pmod(xxhash64(doc_id), 3) = 0")))
    edges = _edges(rows)
    if not any(edges.values()):
        return []  # no labelled rows, or all alike: nothing to tell apart
    for f in FEATURES:
        values = ", ".join(f"{x!r}D" for x in edges[f])
        rows = rows.withColumn(f"b_{f}", F.expr(f"CAST(size(filter(array({values}), x -> x < {f})) AS INT)" if edges[f] else "0"))
    rows = written(rows)
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        grown = _grow(rows.where("NOT prune"), edges)
        if not grown:
            break
        rule, n0, n1 = _prune(rows.where("prune"), grown)
        if n0 < LEAST_COVERED or n0 < precision * (n0 + n1):
            break
        rules.append(rule)
        rows = rows.where(f"NOT ({_sql(rule)})")
    return rules


def judged(docs: DataFrame, labels: DataFrame, label: str = "quality", precision: float = 0.9, text: str = "text",
           doc_id: str = "doc_id") -> tuple[DataFrame, list[Rule]]:
    """The statistics of every row with base_failed, kept and the number of the rule that rejected it; the rules."""
    stats = written(statistics(docs, text, doc_id))
    rules = learn(stats, labels, label, precision)
    number = " ".join(f"WHEN {_sql(r)} THEN {i + 1}" for i, r in enumerate(rules))
    return stats.selectExpr(
        "*", f"{BASE_FAILED} AS base_failed", f"CASE WHEN {BASE_FAILED} THEN false ELSE {as_case(rules)} END AS kept",
        f"CASE WHEN {BASE_FAILED} THEN 0 {number} END AS rule"), rules
