"""Conversation structure repair by weighted CYK parsing over spans of rows.

A repaired conversation spells ``(s?(ua)+)?`` in the initials of its roles: an optional system row, then pairs of user
and assistant. The repair grammar is in Chomsky normal form. Its nonterminals are pairs of border states, "from ``p`` to
``q``", its binary rules are ``(p, q) -> (p, r) (r, q)``, and a row is a terminal of every pair that an edit of it spans:
Keep (0), Rerole to user or assistant (3), Delete (4, the only edit of blank rows and duplicates); an undeleted truncated
row adds 3. Inserted rows (3 each, with an empty text) come in by the closure of the terminals: every cell of one row is
closed under insertions on both sides. A cell holds the cheapest (cost, audit), the audit being the initials of the edits;
equal costs take the audit that is least in ASCII. Cells are combined bottom-up by span length: spans of 1, 2, 4 ... rows.
Since every nonterminal is a pair of states, each way to split a span gives the same cells, so one split per span is
enough and work is linear in the rows. Equally cheap audits of one span never begin one another (each row has one letter,
further letters cost), so the least of the parts make the least whole.

Layout: rows are range-partitioned by conversation, turn and a digest, so that a conversation of any length is spread over
many tasks. Each task reads its rows as a stream and parses spans of at most ``SPAN`` rows (or ``SLICE_BYTES`` of text). A
conversation that lies in one span inside a task is finished there. The spans of the others, at the tasks' borders or long,
are combined ``FAN`` at a time in rounds of shuffles that carry cells but no texts; the borders chosen then go back to the
spans, which are rendered in place. Only the digest of a conversation's text is taken in one pass, by its definition:
spans stream through it in order. Earlier equal rows are found by one aggregation of digests beside, in which repeated
rows fold before the shuffle; duplicates then travel through the sort as marks just before their rows.

Defined cases: nulls in role or text are one space; rows without conversation are one conversation of their own, whose
``conv_id`` is null. Rows go by turn, nulls first; rows of one turn go by the MD5 digest of role and text, repeated rows
one after the other. Blank is a text without a character other than space and \\x09-\\x0D. A row's first fault counts, of
blank, duplicate (role and text earlier in the conversation) and truncated (the last character that is not blank is none
of ``.!?``). Very long texts stay whole. An empty table gives an empty result. Further columns are not read; their names
cannot clash, since rows are renamed on entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.llm.common import by_value, join_groups, written

#: Rows of a span at most, spans that one task combines at a time, and bytes of text of a span, about, at most.
SPAN, FAN, SPAN_BYTES = 1_024, 16, 4 << 20

#: States at a border: nothing yet, after system, after user, after assistant; a conversation ends in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
_READ = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_EXPECTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
PAIRS = [(p, q) for p in range(4) for q in range(4) if p == q or q in (USER, ASSISTANT) or (p, q) == (START, SYSTEM)]
_AT = {pair: i for i, pair in enumerate(PAIRS)}
_RULES = [(_AT[p, q], _AT[p, r], _AT[r, q]) for p, r in PAIRS for s, q in PAIRS if r == s]
_KEEP, _REROLE, _DELETE, _INSERT, _TRUNCATED, _NEVER = 0, 3, 4, 3, 3, 1 << 60

#: Faults of a row: none, blank, duplicate, truncated.
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
_BLANKS = " \t\n\x0b\x0c\r"

Cell = tuple[int, str, str]  # cost, audit, states at the borders of spans inside


def _inserted() -> dict[tuple[int, int], int]:
    """Rows to insert to come from one state to another."""
    steps = {}
    for p in range(4):
        q, n = p, 0
        while (p, q) not in steps:
            steps[p, q] = n
            q, n = _READ[q, _EXPECTED[q][0]], n + 1
    return steps


def _leaf(initial: str, fault: int) -> list[Cell]:
    """Cells of one row: its edits, closed under insertions before and after."""
    more = _TRUNCATED if fault == CUT_OFF else 0
    edits = [(p, p, _DELETE, "D") for p in range(4)]
    if fault in (FINE, CUT_OFF):
        edits += [(p, _READ[p, initial], _KEEP + more, "K") for p in range(4) if (p, initial) in _READ]
        edits += [(p, _READ[p, _EXPECTED[p][0]], _REROLE + more, "R") for p in range(4)]
    closure = _inserted()
    cells: list[Cell | None] = [None] * len(PAIRS)
    for (p, before), n in closure.items():
        for (after, q), m in closure.items():
            for left, right, cost, letter in edits:
                if (left, right) == (before, after):
                    cell = (cost + _INSERT * (n + m), "I" * n + letter + "I" * m, "")
                    old = cells[_AT[p, q]]
                    cells[_AT[p, q]] = cell if old is None else min(old, cell)
    return [cell or (_NEVER, "", "") for cell in cells]  # no edit of another row leads behind a system row


def joined_cells(left: list[Cell], right: list[Cell], border: bool = False) -> list[Cell]:
    """Cells of two adjacent spans together; ``border`` notes the state where they meet."""
    best: list[Cell | None] = [None] * len(PAIRS)
    for whole, first, second in _RULES:
        (a, x, s), (b, y, t) = left[first], right[second]
        cost, old = a + b, best[whole]
        if cost >= _NEVER:
            best[whole] = old or (_NEVER, "", "")
            continue
        if old is None or cost < old[0] or cost == old[0] and x + y < old[1]:
            best[whole] = (cost, x + y, s + (str(PAIRS[first][1]) if border else "") + t)
    return best  # type: ignore[return-value]


def _bottom_up(cells: list[list[Cell]], border: bool = False) -> list[Cell]:
    while len(cells) > 1:
        pairs = [joined_cells(a, b, border) for a, b in zip(cells[::2], cells[1::2])]
        cells = pairs + cells[len(cells) - len(cells) % 2:]
    return cells[0]


def _best(cells: list[Cell]) -> tuple[Cell, int]:
    """The cheapest whole conversation and the state it ends in."""
    return min((cells[_AT[START, q]], q) for q in (START, ASSISTANT))


def rendered(rows: list[dict], audit: str, state: int) -> list[tuple[str, str]]:
    """(role, text) of each repaired row of a span whose left border has the state."""
    lines, at = [], iter(rows)
    for letter in audit:
        if letter == "I":
            lines.append((_EXPECTED[state], ""))
        else:
            row = next(at)
            if letter == "D":
                continue
            lines.append((row["role"] if letter == "K" else _EXPECTED[state], row["text"]))
        state = _READ[state, lines[-1][0][:1]]
    return lines


class _Span:
    """Rows of one conversation that follow each other in a task."""

    def __init__(self, conv, seq: int):
        self.conv, self.seq, self.bytes = conv, seq, 0
        self.rows: list[dict] = []
        self.codes: list[tuple[str, int]] = []
        self.faults = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal neighbours
        self.turns: list[int] | None = None  # least, largest, distinct

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if self.codes and self.codes[-1][0] + initial not in ("su", "ua", "au"):
            self.faults[3] += 1
        if fault:
            self.faults[fault - 1] += 1
        if turn is not None:
            if self.turns is None:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns = [self.turns[0], turn, self.turns[2] + 1]
        self.codes.append((initial, fault))
        self.rows.append({"role": role, "text": text})
        self.bytes += len(role) + len(text)


def _digest(lines: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join([f"{role}:{text}" for role, text in lines]).encode()).hexdigest()


_FACTS = "faults array<long>, first string, last string, turns array<long>, costs array<long>, audits array<string>, paths array<string>"
_NO_ROWS: list[Cell] = [(0 if p == q else _NEVER, "", "") for p, q in PAIRS]


def _spans(conv_type: T.DataType, keep_lines: bool, most: int, fan_bytes: int):
    """Task that turns ordered rows into parsed spans; finished ones have a digest."""
    others = T.StructType.fromDDL(f"part int, seq int, {_FACTS}, digest string, rows array<struct<role: string, text: string>>")
    schema = T.StructType([T.StructField("conv", conv_type), *others.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part, known, leaves = to_arrow_schema(schema), TaskContext.get().partitionId(), {}, {}
        out: list[dict] = []

        def cells_of(codes: list[tuple[str, int]]) -> list[Cell]:
            if not codes:
                return _NO_ROWS
            if len(codes) > 16:
                return _bottom_up([cells_of([c]) for c in codes])
            key = tuple(codes)
            if (cells := known.get(key)) is None:
                if len(known) > 50_000:
                    known.clear()
                cells = known[key] = _bottom_up([leaves.get(c) or leaves.setdefault(c, _leaf(*c)) for c in codes])
            return cells

        def close(span: _Span, whole: bool) -> None:
            cells, digest, rows = cells_of(span.codes), None, span.rows
            if whole:
                best, _ = _best(cells)
                cells, lines = [best], rendered(rows, best[1], START)
                digest, rows = _digest(lines), [{"role": r, "text": t} for r, t in lines] if keep_lines else None
            out.append({"conv": span.conv, "part": part, "seq": span.seq, "faults": span.faults,
                        "first": span.codes[0][0] if span.codes else None, "last": span.codes[-1][0] if span.codes else None,
                        "turns": span.turns, "costs": [c[0] for c in cells], "audits": [c[1] for c in cells],
                        "paths": [c[2] for c in cells], "digest": digest, "rows": rows})

        span, first, marked, held = None, True, False, 0
        for batch in batches:
            for conv, turn, mark, fault, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if span is None or conv != span.conv:
                    if span is not None:
                        close(span, not first and span.seq == 0)  # the task's first conversation may have begun before
                        first = False
                    span, marked = _Span(conv, 0), False
                if mark:
                    marked = True
                elif fault is not None:  # else the row only names its conversation
                    if len(span.rows) >= most or span.bytes >= fan_bytes:
                        close(span, False)
                        held += span.bytes
                        span = _Span(conv, span.seq + 1)
                    span.add(turn, role, text, DUPLICATE if marked and fault != BLANK else fault)
                    marked = False
                if len(out) >= 1_000 or held >= fan_bytes:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out.clear()
                    held = 0
        if span is not None:
            close(span, False)
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return run, schema


def _meet(left: dict, right: dict) -> tuple[list[int], list[int] | None]:
    """Faults and turns of two adjacent spans together."""
    faults = [a + b for a, b in zip(left["faults"], right["faults"])]
    if left["last"] is not None and right["first"] is not None and left["last"] + right["first"] not in ("su", "ua", "au"):
        faults[3] += 1
    a, b = left["turns"], right["turns"]
    turns = [a[0], b[1], a[2] + b[2] - (a[1] == b[0])] if a and b else a or b
    return faults, turns


def _combine(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    whole = rows[0]
    for row in rows[1:]:
        faults, turns = _meet(whole, row)
        whole = whole | {"faults": faults, "turns": turns, "last": whole["last"] if row["last"] is None else row["last"],
                         "first": row["first"] if whole["first"] is None else whole["first"]}
    cells = _bottom_up([list(zip(r["costs"], r["audits"], r["paths"])) for r in rows], True)
    whole |= {"k": whole["k"] // FAN, "costs": [c[0] for c in cells], "audits": [c[1] for c in cells], "paths": [c[2] for c in cells]}
    return pa.Table.from_pylist([whole], table.schema)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest cell of whole conversations, and the states at all borders of its spans."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            best, end = _best(list(zip(row["costs"], row["audits"], row["paths"])))
            row |= {"costs": [best[0]], "audits": [best[1]], "paths": [f"{START}{best[2]}{end}"]}
        yield pa.RecordBatch.from_pylist(rows, batch.schema)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, at = batch.select(["conv", "k"]), [batch.column(n).to_pylist() for n in ("audits", "states", "rows")]
        lines = [[{"role": r, "text": t} for r, t in rendered(rows, audits[_AT[int(states[0]), int(states[1])]], int(states[0]))]
                 for audits, states, rows in zip(*at)]
        yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(lines, batch.schema.field("rows").type)], ["conv", "k", "rows"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired rows, which come span by span in order."""
    kind, conv, state, lines = None, None, None, 0
    for batch in batches:
        kind = batch.schema.field("conv").type
        for i, (value, rows) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
            if state is None or value != conv:
                if state is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], ["conv", "digest"])
                conv, state, lines = value, hashlib.sha256(), 0
            for line in rows.as_py():
                state.update(("\n" if lines else "").encode() + f"{line['role']}:{line['text']}".encode())
                lines += 1
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], ["conv", "digest"])


def _marks(rows: DataFrame) -> DataFrame:
    """A mark for every row whose role and text its conversation has in an earlier row."""
    keys = rows.where(f"fault IS NOT NULL AND fault <> {BLANK}").selectExpr(
        "conv", "turn", "d", "id", "unhex(md5(concat(coalesce(concat('=', CAST(conv AS STRING)), ''), ';', hex(d)))) AS k",
        "struct(turn IS NOT NULL AS numbered, turn, id) AS at")
    groups = written(keys.groupBy("k").agg(F.min("at").alias("earliest"), F.count("*").alias("n")).where("n > 1"))
    return join_groups(keys, groups, "k", "n", rows.count()).where("at.id <> earliest.id").selectExpr(
        "conv", "turn", "d", "id", "true AS mark", "CAST(NULL AS INT) AS fault", "CAST(NULL AS STRING) AS role", "CAST(NULL AS STRING) AS text")


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             absent: str | None = None, keep_lines: bool = True, span: int = SPAN, span_bytes: int = SPAN_BYTES) -> tuple[DataFrame, DataFrame]:
    """Repair every conversation: (one row per conversation, its repaired rows in spans).

    The first has conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. The second has
    conv_id, place (order of spans) and lines (role and text of each row of the span); with ``keep_lines=False`` only spans of
    long conversations. ``absent`` names a boolean column of rows that only name their conversation and are no part of it.
    """
    given = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
                        F.coalesce(text, F.lit(" ")).alias("text"), (F.col(absent) if absent else F.lit(False)).alias("absent"))
    end = "right(trim(TRAILING ' \\t\\n\\x0b\\x0c\\r' FROM text), 1)".replace("\\x0b", "\x0b").replace("\\x0c", "\x0c")
    given = given.withColumn("end", F.expr(end)).selectExpr(
        "conv", "turn", "unhex(md5(concat(CAST(char_length(role) AS STRING), ':', role, text))) AS d", "monotonically_increasing_id() AS id",
        "false AS mark", f"CASE WHEN absent THEN NULL WHEN end = '' THEN {BLANK} WHEN end NOT IN ('.', '!', '?') THEN {CUT_OFF} ELSE {FINE} END AS fault",
        "IF(absent, NULL, role) AS role", "IF(absent, NULL, text) AS text")
    given = written(given)
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "d", "id"]
    dealt = given.unionByName(_marks(given)).repartitionByRange(*order).sortWithinPartitions(*order, F.desc("mark"))
    run, schema = _spans(given.schema["conv"].dataType, keep_lines, span, span_bytes)
    spans = written(dealt.select("conv", "turn", "mark", "fault", "role", "text").mapInArrow(run, schema))
    facts = ["conv", "faults", "first", "last", "turns", "costs", "audits", "paths"]
    done, open_ = spans.where("digest IS NOT NULL"), spans.where("digest IS NULL")

    # Spans of conversations that lie in several: their numbers, from the counts per task.
    parts = open_.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(
            F.col("conv").alias("c"), F.col("part").alias("p"), "before")
    numbered = written(open_.join(before, F.expr("conv <=> c AND part = p")).withColumn("k", F.expr("seq + before")).drop("c", "p", "before"))
    level, last = numbered.select("k", *facts), numbered.agg(F.max("k")).head()[0]
    while last:
        level = written(level.groupBy("conv", F.expr(f"k div {FAN}").alias("_g")).applyInArrow(_combine, level.schema))
        last //= FAN
    chosen = written(level.mapInArrow(_chosen, level.schema))
    borders = chosen.selectExpr("conv AS c", "explode(transform(sequence(0, length(paths[0]) - 2), i -> struct(i AS i, substr(paths[0], i + 1, 2) AS states))) AS z")
    late = numbered.join(borders, F.expr("conv <=> c AND k = z.i")).selectExpr("conv", "k", "audits", "z.states AS states", "rows")
    kind = T.StructType([schema["conv"], T.StructField("k", T.LongType()), schema["rows"]])
    late = written(late.mapInArrow(_render, kind))
    hashed = late.repartition("conv").sortWithinPartitions("conv", "k").mapInArrow(_digests, T.StructType([schema["conv"], schema["digest"]]))
    hashed = hashed.withColumnRenamed("conv", "c")
    whole = done.select(*facts, "digest").unionByName(chosen.select(*facts).join(hashed, F.expr("conv <=> c")).select(*facts, "digest"))
    summary = whole.selectExpr(
        "conv AS conv_id", "CASE WHEN turns IS NULL THEN 0 ELSE turns[1] - turns[0] + 1 - turns[2] END AS gaps",
        *(f"faults[{i}] AS {name}" for i, name in enumerate(("blank", "duplicate", "truncated", "illegal"))),
        "costs[0] AS cost", "audits[0] AS audit", "digest AS repaired_sha256")
    lines = late.selectExpr("conv AS conv_id", "k AS place", "rows AS lines")
    if keep_lines:
        lines = lines.unionByName(done.selectExpr("conv AS conv_id", "CAST(0 AS BIGINT) AS place", "rows AS lines"))
    return summary, lines


def damaged(rows: DataFrame) -> DataFrame:
    """The test damage of ``conversations`` rows, by a checksum of conversation and turn; dropped rows become ``absent``."""
    told = rows.selectExpr("conv_id", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text",
                           "crc32(concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' '))) % 20 AS kind")
    return told.selectExpr(
        "conv_id", "turn", "IF(kind = 4, 'user', role) AS role", "CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text",
        "kind = 0 AS absent", "explode(sequence(1, IF(kind = 3, 2, 1))) AS copy")


by_value(__name__)
