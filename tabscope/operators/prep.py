"""Feature preparation: imputation values, scaling, encoding, assembly."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.values import (
    as_double,
    is_missing,
    is_numeric_like,
    reference,
    rendered,
)
from tabscope.operators.dictionary import Dictionary, dictionary, entry_of
from tabscope.operators.frequencies import most_frequent, unpivoted

FEATURES = "__model_features"
# Values of one column that may be put in order in one task when its median is taken.
MEDIAN_WINDOW = 1_000_000
SKETCH_ACCURACY = 10_000


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is present."""
    return df.where(f"NOT {is_missing(reference(target), df.schema[target].dataType)}")


def feature_columns(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    """(numeric, other) features by declared type; booleans are numeric, dates and text are not."""
    features = [f for f in df.schema.fields if f.name != target]
    numeric = [f.name for f in features if is_numeric_like(f.dataType)]
    return numeric, [f.name for f in features if f.name not in numeric]


@dataclass
class _Bracket:
    """Values known to enclose the middle of a column, and how many lie below and inside."""

    low: float
    high: float
    below: int
    inside: int
    total: int

    @property
    def ranks(self) -> tuple[int, int]:
        return (self.total + 1) // 2, self.total // 2 + 1


def medians(df: DataFrame, columns: Sequence[str], window: int = MEDIAN_WINDOW) -> dict[str, float]:
    """Exact medians of numeric columns; columns without values are left out.

    Long columns are narrowed first: a sketch gives two values around the middle, one counting
    pass says how many rows lie below and between them, and so on until few are left. Only those
    are put in order. Copies of one value are folded by the aggregation and never count twice.
    """
    if not columns:
        return {}
    cells = {c: as_double(reference(c), df.schema[c].dataType) for c in columns}
    counted = df.agg(*[F.expr(f"count({cells[c]}) AS n{i}") for i, c in enumerate(columns)]).first()
    brackets = {c: _Bracket(-math.inf, math.inf, 0, n, n) for c, n in zip(columns, counted) if n}
    while wide := [c for c, b in brackets.items() if b.inside > window and b.low < b.high]:
        shrunk = _narrowed(df, {c: cells[c] for c in wide}, brackets)
        if all(shrunk[c].inside >= brackets[c].inside for c in wide):
            break
        brackets.update(shrunk)
    return _middles(df, {c: cells[c] for c in brackets}, brackets)


def _number(value: float) -> str:
    """SQL double; infinities and NaN have no plain literal."""
    return f"{float(value)!r}D" if math.isfinite(value) else f"CAST('{float(value)!r}' AS DOUBLE)"


def _inside(cell: str, b: _Bracket) -> str:
    parts = [p for p, edge in ((f"{cell} >= {_number(b.low)}", b.low), (f"{cell} <= {_number(b.high)}", b.high)) if math.isfinite(edge)]
    return " AND ".join(parts) or "true"


def _narrowed(df: DataFrame, cells: dict[str, str], brackets: dict[str, _Bracket]) -> dict[str, _Bracket]:
    slack = 2 / SKETCH_ACCURACY
    sketches, names = [], list(cells)
    for i, c in enumerate(names):
        b = brackets[c]
        first, second = ((r - b.below) / b.inside for r in b.ranks)
        asked = f"array({max(0.0, first - slack)!r}D, {min(1.0, second + slack)!r}D)"
        sketches.append(f"approx_percentile(CASE WHEN {_inside(cells[c], b)} THEN {cells[c]} END, {asked}, {SKETCH_ACCURACY}) AS q{i}")
    edges = dict(zip(names, df.agg(*map(F.expr, sketches)).first()))
    counts = []
    for i, c in enumerate(names):
        low, high = edges[c]
        counts += [f"count_if({cells[c]} < {_number(low)}) AS b{i}", f"count_if({cells[c]} BETWEEN {_number(low)} AND {_number(high)}) AS i{i}"]
    row = df.agg(*map(F.expr, counts)).first()
    out = {}
    for i, c in enumerate(names):
        old, (low, high) = brackets[c], edges[c]
        new = _Bracket(low, high, row[f"b{i}"], row[f"i{i}"], old.total)
        first, second = new.ranks
        out[c] = new if new.below < first and second <= new.below + new.inside else old
    return out


def _middles(df: DataFrame, cells: dict[str, str], brackets: dict[str, _Bracket]) -> dict[str, float]:
    names = list(cells)
    data = df.selectExpr(*[f"CASE WHEN {_inside(cells[c], brackets[c])} THEN {cells[c]} END AS v" for c in names])
    counts = unpivoted(data, {i: f"c{i}" for i in range(len(names))}).groupBy("ordinal", "value").agg(F.expr("count(1) AS n"))
    upto = counts.selectExpr("ordinal", "value", "n", "sum(n) OVER (PARTITION BY ordinal ORDER BY value) AS upto")
    ranks = F.array(*[F.array(*[F.lit(r - brackets[c].below) for r in brackets[c].ranks]) for c in names])
    asked = upto.withColumn("ranks", ranks[F.col("ordinal")])
    hits = asked.where("upto - n < ranks[1] AND upto >= ranks[0]")
    # One or two values per column are left.
    rows = hits.groupBy("ordinal").agg(F.expr("(min(value) + max(value)) / 2 AS median")).collect()
    return {names[r.ordinal]: r.median for r in rows}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value of each column as text, the smallest on ties; columns without values are left out."""
    if not columns:
        return {}
    # One row per column.
    return {r["column"]: r["value"] for r in most_frequent(df, columns).collect()}


def imputed(df: DataFrame, numeric_fill: dict[str, float], text_fill: dict[str, str]) -> DataFrame:
    """Replace missing values, keeping names; numbers become double and everything else text."""
    return df.selectExpr(*_imputation(df, numeric_fill, text_fill, lambda c: reference(c)))


def _text_fills(df: DataFrame, text_fill: dict[str, str]) -> list[tuple[str, str]]:
    """(column, SQL of its text without gaps)."""
    def literal(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return [(c, f"coalesce({rendered(reference(c), df.schema[c].dataType)}, {literal(v)})") for c, v in text_fill.items()]


def _imputation(df: DataFrame, numeric_fill: dict[str, float], text_fill: dict[str, str], name) -> list[str]:
    numbers = [f"coalesce({as_double(reference(c), df.schema[c].dataType)}, {_number(v)}) AS {name(c)}"
               for c, v in numeric_fill.items()]
    return numbers + [f"{text} AS {name(c)}" for c, text in _text_fills(df, text_fill)]


def spreads(df: DataFrame, columns: Sequence[str], population: bool = True) -> dict[str, float]:
    """Standard deviation of each column; 1 where it is constant or has no values."""
    if not columns:
        return {}
    spread = "stddev_pop" if population else "stddev_samp"
    row = df.agg(*[F.expr(f"coalesce(nullif({spread}({as_double(reference(c), df.schema[c].dataType)}), 0D), 1D) AS s{i}")
                   for i, c in enumerate(columns)]).first()  # one row, one number per column
    return dict(zip(columns, row))


def scaled(df: DataFrame, columns: Sequence[str], population: bool = True) -> DataFrame:
    """Divide by the standard deviation without centring; a constant column is divided by 1."""
    by = spreads(df, columns, population)
    return df.withColumns({c: F.expr(f"{as_double(reference(c), df.schema[c].dataType)} / {_number(by[c])}") for c in columns})


def free_prefix(columns: Sequence[str]) -> str:
    """Underscores that no column begins with, so that names made with them cannot clash."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


@dataclass
class Preparation:
    """A fitted feature preparation in two steps, and what became of each column.

    ``encode`` turns every raw column into one slot column (a number or a one-hot vector), each
    from its own raw value alone; ``assemble`` joins the slots into the feature vector.
    """

    filled: list[str]
    scaled: list[str]
    texts: dict[str, str]
    entries: Dictionary | None
    onehot: OneHotEncoderModel | None
    assembler: VectorAssembler
    numeric: list[str]
    categorical: list[str]
    slots: dict[str, str]
    #: Of each numeric column: the name of its values before scaling, and what they are divided by.
    unscaled: dict[str, tuple[str, float]]
    skipped: dict[str, str] = field(default_factory=dict)

    def encode(self, df: DataFrame) -> DataFrame:
        rows = df.selectExpr("*", *self.filled).selectExpr("*", *self.scaled)
        if self.onehot is None:
            return rows
        values = [*self.texts.values(), *(self.slots[c] for c in self.numeric)]
        for i, (text, index) in enumerate(zip(self.texts.values(), self.onehot.getInputCols())):
            rows = self.entries.look_up(rows, i, text, index, values)
        return self.onehot.transform(rows)

    def assemble(self, encoded: DataFrame) -> DataFrame:
        return self.assembler.transform(encoded)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.assemble(self.encode(df))


def fit_preparation(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Preparation:
    """Median and mode imputation, scaling, one-hot encoding, one sparse vector: numbers first.

    Columns without values are left out and listed in ``skipped``. Every value of a categorical column has a slot of its
    own, in text order (texts over 64 characters: in the order of their digests), whatever their number: they are
    numbered and looked up on the executors. Values unseen in training are encoded as all zeros.
    """
    number_fill, text_fill = medians(train, numeric), modes(train, categorical)
    skipped = {c: "no values" for c in [*numeric, *categorical] if c not in number_fill and c not in text_fill}
    numeric, kept = [c for c in numeric if c in number_fill], [c for c in categorical if c in text_fill]
    if not numeric and not kept:
        raise ValueError("no usable feature column")
    own = free_prefix(train.columns)  # of the names of all columns made here
    numbers = {c: f"{own}n{i}" for i, c in enumerate(numeric)}
    texts = {c: f"{own}k{i}" for i, c in enumerate(kept)}
    filled = _imputation(train, {c: number_fill[c] for c in numeric}, {}, numbers.__getitem__)
    filled += [f"{entry_of(text)} AS {texts[c]}" for c, text in _text_fills(train, {c: text_fill[c] for c in kept})]
    # Spread of the imputed values, as the model sees them.
    by = spreads(train.selectExpr("*", *filled), list(numbers.values()))
    scaled = [f"{slot} / {_number(by[slot])} AS {own}s{i}" for i, slot in enumerate(numbers.values())]
    slots = {c: f"{own}s{i}" for i, c in enumerate(numeric)} | {c: f"{own}h{i}" for i, c in enumerate(kept)}
    entries = onehot = None
    if kept:
        entries = dictionary(train.selectExpr(*filled), list(texts.values()))
        indexed = [f"{own}i{i}" for i in range(len(kept))]
        # The slot behind the last entry stands for unseen values; it is the one that the encoder drops.
        last = train.sparkSession.range(0, 1, 1, 1).selectExpr(*[f"CAST({entries.sizes[i]} AS DOUBLE) AS {c}" for i, c in enumerate(indexed)])
        onehot = OneHotEncoder(inputCols=indexed, outputCols=[slots[c] for c in kept], dropLast=True).fit(last)
    assembler = VectorAssembler(inputCols=list(slots.values()), outputCol=FEATURES)
    unscaled = {c: (slot, by[slot]) for c, slot in numbers.items()}
    return Preparation(filled, scaled, texts, entries, onehot, assembler, numeric, kept, slots, unscaled, skipped)


def stored(vectors: DataFrame) -> DataFrame:
    """Add (width, indices, first_one) of the feature vector as it is stored, so that no row takes memory per slot.

    ``indices`` is NULL for a vector stored densely; ``first_one`` is the 0-based place of the first 1 among the stored values, or NULL.
    """
    parts = vectors.withColumn("x", F.unwrap_udt(F.col(FEATURES)))
    return parts.selectExpr("*", "coalesce(x.size, size(x.values)) AS width", "x.indices AS indices",
                            "CAST(nullif(array_position(x.values, 1D), 0) - 1 AS INT) AS first_one").drop("x")
