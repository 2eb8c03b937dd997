"""Personal data by patterns and by information-theoretic sanitisation. DataFrame functions only.

Patterns find e-mail and IP addresses, card and phone numbers. Every distinct value found is a *protected entity*; terms that
stand beside it reveal it to the degree that they occur with it. Over the whole corpus, with documents as the unit,

    PMI(term; entity) = log(p(term, entity) / (p(term) p(entity))),    information of the entity = -log p(entity),

a term whose PMI reaches ``disclosure`` times the entity's information discloses it, that is if
p(entity | term) >= p(entity) ** (1 - disclosure). Term and entity have to meet in ``least_together`` different texts, so that
a chance meeting, or copies of one text, say nothing. A disclosing term is a span ``term`` wherever it stands, also in texts
without the entity, where it alone discloses it:
:func:`sanitised` generalises terms with digits to ``[number]`` and removes the others; entities become ``[kind]``.

Positions come from the pieces between the matches, whose lengths are added up within the row in two levels, so that many
matches in one long text stay cheap. What moves: the texts that have an entity of ``least_together`` texts or more, once, to
fold copies; pairs of an entity and a term, folded before the shuffle; counts of the terms that are left; the disclosing
terms of a row. All texts are kept in the checkpoint until then. The terms of an entity never meet in one task, whatever share of the rows has it.

Defined cases: a null text counts as empty and has no spans. Matches that fail their test are dropped without a second try.
Rows are told apart by position, not by doc_id, so rows that repeat one, or have none, are judged each by its text. Without
entities no term is a span. An empty table gives an empty result. Other columns are not read or, in :func:`sanitised`,
carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import sized, written

# The patterns are possessive and start only where a run of their characters starts (or the last match ended): they match
# what the plain ones do, in time linear in the text, and use no stack.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to be searched.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}

_DIGITS = "regexp_replace(x, '[^0-9]', '')"
_LUHN = (f"aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) -> CASE WHEN i % 2 = 0 THEN CAST(d AS INT) "
         "ELSE CAST(d AS INT) * 2 - CASE WHEN CAST(d AS INT) > 4 THEN 9 ELSE 0 END END), 0, (a, d) -> a + d) % 10 = 0")
#: SQL over a match x.
TESTS = {
    "email": "true",
    "ip": "forall(transform(split(x, '[.]'), n -> trim(LEADING '0' FROM n)), n -> length(n) <= 3 AND CAST(concat('0', left(n, 3)) AS INT) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
KINDS = (*PATTERNS, "term")

_CHUNK = 256


def _sums(numbers: str) -> str:
    """SQL: running sums of an array of numbers, chunk by chunk."""
    def running(array: str, start: str) -> str:
        return (f"aggregate({array}, struct({start} AS s, CAST(array() AS ARRAY<BIGINT>) AS o), "
                "(a, x) -> struct(a.s + x AS s, concat(a.o, array(a.s + x)) AS o), a -> a.o)")

    chunks = f"transform(sequence(0, greatest((size({numbers}) - 1) div {_CHUNK}, 0)), c -> slice({numbers}, CAST(c * {_CHUNK} + 1 AS INT), {_CHUNK}))"
    totals = running(f"transform({chunks}, c -> aggregate(c, 0L, (a, x) -> a + x))", "0L")
    return (f"CASE WHEN size({numbers}) = 0 THEN CAST(array() AS ARRAY<BIGINT>) WHEN size({numbers}) <= {_CHUNK} THEN {running(numbers, '0L')} "
            f"ELSE flatten(zip_with({chunks}, {totals}, (c, t) -> {running('c', 't - aggregate(c, 0L, (a, x) -> a + x)')})) END")


def _pieces(text: str, pattern: str, matches: str) -> str:
    """SQL: lengths of the piece before each match and of the match, in turn."""
    between = f"slice(split({text}, r'{pattern}', -1), 1, size({matches}))"
    return f"flatten(zip_with({between}, {matches}, (p, x) -> array(CAST(length(p) AS BIGINT), CAST(length(x) AS BIGINT))))"


def _with_spans(rows: DataFrame, kind: str) -> DataFrame:
    """Add ``kind``: the tested matches of a pattern in the text ``t``."""
    searched = f"contains(t, '{NEEDED[kind]}')" if NEEDED[kind] else "true"
    rows = rows.withColumn("_m", F.expr(f"CASE WHEN {searched} THEN regexp_extract_all(t, r'{PATTERNS[kind]}', 0) ELSE array() END"))
    rows = rows.withColumn("_ok", F.expr(f"transform(_m, x -> {TESTS[kind]})"))
    rows = rows.withColumn("_n", F.expr(f"CASE WHEN array_contains(_ok, true) THEN {_pieces('t', PATTERNS[kind], '_m')} ELSE array() END"))
    rows = rows.withColumn("_s", F.expr(_sums("_n")))
    spans = f"transform(_m, (x, i) -> struct('{kind}' AS kind, x AS value, _s[2 * i] AS start, _s[2 * i + 1] AS end, _ok[i] AS ok))"
    found = f"CASE WHEN size(_n) > 0 THEN transform(filter({spans}, z -> z.ok), z -> {_SPAN}) ELSE array() END"
    return rows.withColumn(kind, F.expr(found)).drop("_m", "_ok", "_n", "_s")


_SPAN = "struct(z.kind AS kind, z.value AS value, z.start AS start, z.end AS end)"


def base_spans(rows: DataFrame) -> DataFrame:
    """Add ``spans``, array<struct(kind, value, start, end)>, from the text ``t``; positions in code points, end exclusive."""
    for kind in PATTERNS:
        rows = _with_spans(rows, kind)
    return rows.withColumn("spans", F.concat(*PATTERNS)).drop(*PATTERNS)


_WORD = r"[^\x20\x09-\x0D]+"
_CUT = r"regexp_replace(lower(x), r'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '')"


def _terms(text: str) -> str:
    """SQL: distinct words of a text without its entities, lower-cased and without the marks around them."""
    for pattern in PATTERNS.values():
        text = f"regexp_replace({text}, r'{pattern}', ' ')"
    return f"array_distinct(filter(transform(regexp_extract_all({text}, r'{_WORD}', 0), x -> {_CUT}), x -> x <> ''))"


def _disclosing(docs: DataFrame, based: DataFrame, text: str, disclosure: float, least_together: int) -> DataFrame:
    """(entity, term): the terms that disclose an entity."""
    held = based.where("size(spans) > 0").selectExpr(
        "t", "xxhash64(t) AS h", "explode(array_distinct(transform(spans, z -> concat(z.kind, ':', z.value)))) AS entity")
    counts = held.groupBy("entity", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("texts"))
    entities = sized(written(counts.where(F.col("texts") >= least_together).select("entity", "n_entity")))
    texts = held.join(entities, "entity").groupBy("entity", "n_entity", "h").agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("n"))
    pairs = texts.select("entity", "n_entity", "n", F.explode(F.expr(_terms("t"))).alias("term"))
    pairs = pairs.groupBy("entity", "n_entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("texts"))
    pairs = written(pairs.where(F.col("texts") >= least_together))
    if pairs.isEmpty():
        return pairs.select("entity", "term")
    terms = sized(written(pairs.select("term").distinct()))
    words = docs.select(F.explode(F.expr(_terms(f"coalesce({text}, '')"))).alias("term")).join(terms, "term", "left_semi")
    counted = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n = based.count()
    told = f"n_both / n_term >= power(n_entity / {n}D, {1 - disclosure!r}D)"
    return written(pairs.join(counted, "term").where(told).select("entity", "term"))


def _term_spans(based: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(row, terms): per row with disclosing terms, with or without an entity, their spans."""
    terms = written(disclosing.select("term").distinct())
    words = based.where(F.lit(not terms.isEmpty())).select("row", F.explode(F.expr(_terms("t"))).alias("term"))
    # A row's terms are words of its text, so the set is bounded by that.
    told = words.join(sized(terms), "term", "left_semi").groupBy("row").agg(F.collect_set("term").alias("told"))
    rows = based.join(sized(written(told)), "row").withColumn("_m", F.expr(f"regexp_extract_all(t, r'{_WORD}', 0)"))
    rows = rows.withColumn("_n", F.expr(_pieces("t", _WORD, "_m"))).withColumn("_s", F.expr(_sums("_n")))
    found = ("filter(transform(_m, (x, i) -> struct('term' AS kind, x AS value, _s[2 * i] AS start, _s[2 * i + 1] AS end)), "
             f"z -> array_contains(told, {_CUT.replace('(x)', '(z.value)')}) AND NOT exists(spans, b -> b.start < z.end AND z.start < b.end))")
    return rows.select("row", F.expr(found).alias("terms"))


def _ordered(spans: str) -> str:
    """SQL: spans by start, then by kind as listed."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    keyed = f"array_sort(transform({spans}, z -> struct(z.start AS s, array_position(array({kinds}), z.kind) AS k, {_SPAN} AS z)))"
    return f"transform({keyed}, y -> y.z)"


def judged(docs: DataFrame, disclosure: float = 0.9, least_together: int = 3, text: str = "text", carried: str = "doc_id",
           whole: bool = False) -> DataFrame:
    """(carried, base, spans) per row: the spans of the patterns, and these with the method's, both in order.

    ``carried`` is any SQL over the row. With ``whole`` the text comes too, as ``t``.
    """
    rows = docs.select(F.expr(carried).alias("carried"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    based = base_spans(rows)
    based = written(based)
    terms = _term_spans(based, _disclosing(docs, based, text, disclosure, least_together))
    out = based.join(sized(written(terms)), "row", "left")
    return out.selectExpr("carried", *["t"] * whole, f"{_ordered('spans')} AS base",
                          f"{_ordered('concat(spans, coalesce(terms, array()))')} AS spans")


def joined(spans: str) -> str:
    """SQL: spans as kind:start:end, comma-joined."""
    return f"array_join(transform({spans}, z -> concat_ws(':', z.kind, z.start, z.end)), ',')"


def sanitised(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with the text sanitised; of overlapping spans the first one holds."""
    put = "CASE WHEN z.kind <> 'term' THEN concat('[', z.kind, ']') WHEN z.value rlike '[0-9]' THEN '[number]' ELSE '' END"
    parts = (f"aggregate(spans, struct(0L AS at, CAST(array() AS ARRAY<STRING>) AS o), (a, z) -> CASE WHEN z.start < a.at THEN a ELSE "
             f"struct(z.end AS at, concat(a.o, array(substring(t, CAST(a.at + 1 AS INT), CAST(z.start - a.at AS INT)), {put})) AS o) END, "
             "a -> array_join(concat(a.o, array(substring(t, CAST(a.at + 1 AS INT)))), ''))")
    found = judged(docs, text=text, carried="struct(*)", whole=True, **options)
    clean = F.expr(f"CASE WHEN carried.`{text}` IS NOT NULL THEN {parts} END")
    return found.select(F.col("carried").withField(f"`{text}`", clean).alias("carried")).select("carried.*")
