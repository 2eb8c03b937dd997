"""Permutation importance: how much the score drops when one raw column is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.values import reference
from tabscope.operators.metrics import R2, regression_scores
from tabscope.operators.models import LABEL, REGRESSION, Refit
from tabscope.operators.order import in_order, numbered
from tabscope.operators.sampling import images, permutation_rounds, permuted_column
from tabscope.session import LEAST_TASKS, ROWS_PER_TASK, dealt, dropped, materialised, scratch_path, shuffles_freed, spread

#: Cells of a block of row numbers, and of the rows that a task packs at a time.
BLOCK_CELLS = 8_000_000
#: Pairs of rows that are exchanged at a time; those of one repeat at least.
PAIRS_AT_ONCE = 20_000_000


def permutation_drops(df: DataFrame, features: Sequence[str], task: str, predict: Callable[[DataFrame], DataFrame],
                      repeats: int = 5, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """(feature_ordinal, feature, repeat, score, drop); ``df`` carries ``label`` and the features.

    Rows are numbered once. Each repeat maps a row to a partner by a permutation of the numbers,
    all repeats share one equi-join on it (every number meets exactly ``repeats`` rows, so there
    is no skew), and the variants with one column taken from the partner are produced and scored
    row by row in the same stage. The result is the same for any partitioning when ``key`` is unique.
    """
    names = {c: f"x{i}" for i, c in enumerate(features)}
    keys = {f"_key{i}": F.col(reference(c)) for i, c in enumerate(key or [])}
    data = df.select(LABEL, *[F.col(reference(c)).alias(x) for c, x in names.items()], *[c.alias(k) for k, c in keys.items()])
    n = data.count()
    rows = numbered(data, order_by=list(keys)) if key else numbered(spread(data, n))
    own = F.struct(*names.values())
    left = _with_partners(rows.select(LABEL, own.alias("own"), "row_index"), n, repeats, seed).drop("row_index")
    right = rows.select(F.col("row_index").alias("partner"), own.alias("other"))
    variants = left.join(right, "partner").withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    shuffled = variants.select(LABEL, "f", "repeat", *[
        F.expr(f"CASE WHEN f = {i} THEN other.{x} ELSE own.{x} END").alias(c) for i, (c, x) in enumerate(names.items())])
    scores = _score(predict(shuffled), task, ["f", "repeat"])
    baseline = _score(predict(rows.select(LABEL, *[F.col(x).alias(c) for c, x in names.items()])), task, []).first().score  # one number
    labels = F.array(*[F.lit(c) for c in features])
    return scores.select(
        F.col("f").alias("feature_ordinal"), labels[F.col("f")].alias("feature"), "repeat", "score",
        (F.lit(baseline) - F.col("score")).alias("drop"))


def _with_partners(rows: DataFrame, n: int, repeats: int, seed: int) -> DataFrame:
    """Each numbered row ``repeats`` times, with the number of its partner in that repeat."""
    images = {f"partner{r}": permuted_column(F.col("row_index"), rows, n, seed, r) for r in range(repeats)}
    partners = ", ".join(f"named_struct('repeat', {r}, 'partner', partner{r})" for r in range(repeats))
    return rows.withColumns(images).select(*rows.columns, F.expr(f"inline(array({partners}))"))


def explained(df: DataFrame, features: Sequence[str], final: Refit, repeats: int = 5, seed: int = 42,
              key: Sequence[str] | None = None) -> DataFrame:
    """Permutation drops of raw columns under a fitted model.

    A raw value is encoded by itself, so shuffling a raw column and shuffling its encoded slot
    are the same. Rows are therefore encoded once, before the join, and only assembled and
    predicted per variant. A linear model needs no variants: see :func:`additive_drops`.
    """
    if isinstance(final.model, LinearRegressionModel):
        return additive_drops(df, features, final, repeats, seed, key)
    slots = [final.preparation.slots[c] for c in features]
    encoded = final.preparation.encode(df).select(LABEL, *map(reference, key or []), *slots)
    drops = permutation_drops(encoded, slots, final.task, final.predict_encoded, repeats, seed, key)
    labels = F.array(*[F.lit(c) for c in features])
    return drops.withColumn("feature", labels[F.col("feature_ordinal")])


def additive_drops(df: DataFrame, features: Sequence[str], final: Refit, repeats: int = 5, seed: int = 42,
                   key: Sequence[str] | None = None) -> DataFrame:
    """Permutation drops of raw columns under a linear model.

    Its prediction is a sum of one share per raw column. With one column taken from the partner the residual is what the other
    columns leave of the label, less the partner's share. So a row takes one cell per column, a number or the place of its
    category, whatever the width of the encoding. Rows are written once and numbered; then each task packs the cells of its
    rows by the block of row numbers in which they are needed, and one task per block meets all pairs of its rows. What is
    exchanged for one repeat (for several of few rows) is freed before the next, so disk does not grow with ``repeats``.
    """
    spark = df.sparkSession
    path, n, divisors = _written_cells(df, features, final, key)
    try:
        rows = _numbered_files(spark, path)
        weights = _weights(final)
        shares, gaps, prediction = _shares([weights[c] for c in features], divisors, float(final.model.intercept))
        cells = [f"x{i}" for i in range(len(features))]
        plain = rows.select("label", *cells).mapInArrow(_predictions(shares, prediction), "label double, prediction double")
        # One row: the spread of the label and the score without any change.
        base = regression_scores(plain).join(rows.agg(F.expr("var_pop(label) * count(1) AS total"))).first()
        blocks = max(LEAST_TASKS, -(-n * (len(features) + 1) // BLOCK_CELLS))
        size, sums = max(1, -(-n // blocks)), []
        for some in _batches(repeats, n):
            rounds = {r: permutation_rounds(spark, n, seed, r)[::-1] for r in some}
            pieces = rows.select("row_index", "label", *cells).mapInArrow(
                _pieces(n, size, rounds, BLOCK_CELLS // (len(features) + 1)), "block long, repeat int, body binary")
            found = pieces.groupBy("block").applyInArrow(_block_residuals(size, len(features), shares, gaps), "repeat int, residuals array<double>")
            added = ", ".join(f"sum(residuals[{f}])" for f in range(len(features)))
            with shuffles_freed(spark):  # one row per repeat, one number per column
                sums += found.groupBy("repeat").agg(F.expr(f"array({added}) AS residuals")).collect()
    finally:
        dropped(spark, path)
    labels = F.array(*[F.lit(c) for c in features])
    scores = spark.createDataFrame([(r.repeat, r.residuals) for r in sums], "repeat int, residuals array<double>").selectExpr(
        "repeat", "posexplode(residuals) AS (feature_ordinal, residual)").withColumn("total", F.lit(base.total))
    scores = scores.withColumn("score", F.expr(R2))
    return scores.select("feature_ordinal", labels[F.col("feature_ordinal")].alias("feature"), "repeat", "score",
                         (F.lit(base.r2) - F.col("score")).alias("drop"))


def _batches(repeats: int, n: int) -> list[range]:
    """Runs of repeats whose pairs are exchanged together."""
    step = max(1, PAIRS_AT_ONCE // max(n, 1))
    return [range(at, min(repeats, at + step)) for at in range(0, repeats, step)]


def _written_cells(df: DataFrame, features: Sequence[str], final: Refit, key: Sequence[str] | None) -> tuple[str, int, list[float]]:
    """Folder of parquet files with (label, x0, x1, ..) in order of the key, else as the rows lie, their number, and divisors.

    A number is divided when it is read, since scaled ones hardly compress. Without a key, rows that lie in few partitions are
    dealt anew, few of them as they are encoded and more as they are given.
    """
    preparation, spark = final.preparation, df.sparkSession
    n, even = dealt(df)
    if not even and not key and n > ROWS_PER_TASK * LEAST_TASKS:
        df, even = spread(df.select(LABEL, *map(reference, features)), n), True
    encoded = preparation.encode(df)
    if key or even:
        keys = {f"_key{i}": F.col(reference(c)) for i, c in enumerate(key or [])}
        places = dict(zip(preparation.categorical, preparation.onehot.getInputCols())) if preparation.onehot else {}
        cells = {c: F.col(name) for c, (name, _) in preparation.unscaled.items()} | {c: F.col(name).cast("int") for c, name in places.items()}
        rows = encoded.select(LABEL, *[cells[c].alias(f"x{i}") for i, c in enumerate(features)], *[c.alias(k) for k, c in keys.items()])
        rows = in_order(rows, list(keys)) if key else rows
        divisors = [preparation.unscaled[c][1] if c in preparation.unscaled else 1.0 for c in features]
    else:
        rows = spread(encoded.select(LABEL, *[F.col(preparation.slots[c]).alias(f"x{i}") for i, c in enumerate(features)]), n)
        # A one-hot vector is told by the place of its 1, or the number of entries where it has none.
        sizes = {c: preparation.entries.sizes[i] for i, c in enumerate(preparation.categorical)}
        rows = rows.select(LABEL, *[F.coalesce(F.get(F.unwrap_udt(f"x{i}")["indices"], F.lit(0)), F.lit(sizes[c])).alias(f"x{i}")
                                    if c in sizes else F.col(f"x{i}") for i, c in enumerate(features)])
        divisors = [1.0] * len(features)
    path = scratch_path(spark, "cells")
    rows.select(F.col(LABEL).cast("double").alias("label"), *[f"x{i}" for i in range(len(features))]).write.option("compression", "zstd").parquet(path)
    return path, n, divisors


def _numbered_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of parquet files with their number from 0: those of a file follow those of the files before it."""
    table = spark.read.parquet(path).withColumns({"_file": F.col("_metadata.file_name"), "_at": F.col("_metadata.row_index")})
    # One row per file.
    before = materialised(table.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "_file AS _name", "coalesce(sum(n) OVER (ORDER BY length(_file), _file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before"))
    joined = table.join(F.broadcast(before), F.col("_file") == F.col("_name"))
    return joined.withColumn("row_index", F.expr("_at + _before")).drop("_file", "_at", "_name", "_before")


def _shares(weights: list[np.ndarray], divisors: list[float], intercept: float):
    """Shares of the prediction, and what all other shares leave of the label, a row of numbers per column.

    Like the functions below it names nothing of this package, so executors need only numpy and pyarrow.
    """
    def shares(cells: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(weights), len(cells[0])))
        with np.errstate(all="ignore"):
            for i, (part, by, x) in enumerate(zip(weights, divisors, cells)):
                out[i] = x / by * part[0] if len(part) == 1 else part[x]
        return out

    def sums(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Of the shares before and behind each, so that nothing is subtracted.
        nought = np.zeros((1, parts.shape[1]))
        with np.errstate(all="ignore"):
            return np.vstack([nought, np.cumsum(parts, axis=0)]), np.vstack([np.cumsum(parts[::-1], axis=0)[::-1], nought])

    def gaps(label: np.ndarray, parts: np.ndarray) -> np.ndarray:
        before, behind = sums(parts)
        with np.errstate(all="ignore"):
            return (label - intercept) - (before[:-1] + behind[1:])

    def prediction(parts: np.ndarray) -> np.ndarray:
        return sums(parts)[0][-1] + intercept

    return shares, gaps, prediction


def _predictions(shares, prediction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prediction(shares(cells)))], names=["label", "prediction"])

    return run


def _pieces(n: int, size: int, rounds: dict[int, list[tuple[int, int]]], most: int):
    """Rows of a task, ``most`` at a time, packed by block: with repeat -1 by their own numbers, with label and cells; for each
    repeat by the numbers of the rows whose partners they are, with cells."""
    of = images(n)

    def packed(columns: list[np.ndarray]) -> bytes:
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[str(i) for i in range(len(columns))])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def cut(repeat: int, at: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(at)
        at, columns = at[order], [c[order] for c in columns]
        blocks = at // size
        edges = [*np.flatnonzero(np.diff(blocks, prepend=-1)).tolist(), len(at)]
        found = [(int(blocks[a]), packed([np.diff(at[a:b], prepend=blocks[a] * size).astype(np.int32), *(c[a:b] for c in columns)]))
                 for a, b in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([block for block, _ in found], pa.int64()), pa.array([repeat] * len(found), pa.int32()),
             pa.array([body for _, body in found], pa.binary())], names=["block", "repeat", "body"])

    def dealt_out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, label, *cells = [c.to_numpy() for c in pa.Table.from_batches(held).columns]
        yield from cut(-1, at, [label, *cells])
        for repeat, steps in rounds.items():
            slices = [of(at[i:i + 16384], steps) for i in range(0, len(at), 16384)]  # that stay in a processor's cache
            yield from cut(repeat, np.concatenate(slices), cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                yield from dealt_out(held)
                held = []
        if any(b.num_rows for b in held):
            yield from dealt_out(held)

    return run


def _block_residuals(size: int, n_features: int, shares, gaps):
    """Squared residuals of a block's rows, summed per repeat and column."""
    def unpacked(body) -> tuple[np.ndarray, list[np.ndarray]]:
        steps, *columns = [c.to_numpy(zero_copy_only=False) for c in pa.ipc.open_stream(body.as_buffer()).read_next_batch().columns]
        return np.cumsum(steps, dtype=np.int64), columns

    def run(pieces: pa.Table) -> pa.Table:
        repeats = pieces.column("repeat").to_numpy()
        gap, sums = np.zeros((n_features, size)), {int(r): np.zeros(n_features) for r in set(repeats.tolist()) if r >= 0}
        for i in np.argsort(repeats, kind="stable").tolist():  # the own rows first
            at, columns = unpacked(pieces.column("body")[i])
            if repeats[i] < 0:
                gap[:, at] = gaps(columns[0], shares(columns[1:]))
            else:
                with np.errstate(all="ignore"):
                    sums[int(repeats[i])] += ((gap[:, at] - shares(columns)) ** 2).sum(axis=1)
        return pa.table({"repeat": pa.array(list(sums), pa.int32()), "residuals": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))})

    return run


def _weights(final: Refit) -> dict[str, np.ndarray]:
    """Weights of each raw column: one of a number; of a category one per entry, then 0 for unseen values."""
    preparation, weights, at, out = final.preparation, final.model.coefficients.toArray(), 0, {}
    for c in preparation.slots:
        size = preparation.entries.sizes[preparation.categorical.index(c)] if c in preparation.categorical else 1
        out[c] = np.append(weights[at:at + size], 0.0) if c in preparation.categorical else weights[at:at + size]
        at += size
    return out


def _score(predictions: DataFrame, task: str, by: list[str]) -> DataFrame:
    if task == REGRESSION:
        return regression_scores(predictions, LABEL, "prediction", by).withColumnRenamed("r2", "score")
    return predictions.groupBy(*by).agg(F.expr(f"avg(CAST({LABEL} = prediction AS DOUBLE)) AS score"))


def importance(drops: DataFrame) -> DataFrame:
    """(feature_ordinal, feature, mean, std) of the drops, population standard deviation."""
    return drops.groupBy("feature_ordinal", "feature").agg(
        F.expr("avg(drop) AS mean"), F.expr("stddev_pop(drop) AS std"))


def top_features(table: DataFrame, n: int = 20) -> DataFrame:
    """The n most important features with their position from 1, rounded to 6 places for display."""
    first = table.orderBy(F.desc("mean"), "feature_ordinal").limit(n)
    # At most n rows reach the window.
    return first.selectExpr("row_number() OVER (ORDER BY mean DESC, feature_ordinal) AS position", "feature",
                            "round(mean, 6) AS mean", "round(std, 6) AS std")
