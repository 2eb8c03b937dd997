"""Vector code compression: product codes from integer codebooks, assigned with Drake-Hamerly adaptive bounds.

Components become integers ``floor(scale * x)`` and vectors are cut into equal consecutive parts, each with a codebook of its
own. Every round assigns each part to the nearest entry (squared Euclidean distance, ties to the lower index) and then moves
the entries to the componentwise floor of the mean of their parts.

An assignment is not searched for again each round. Each part keeps, beside its entry, its ``b`` closest other entries in order
with a lower bound on the distance to each, and one outer bound below the distance to all further ones. When entries move,
bounds fall by how far theirs moved (the outer one by the farthest move). The distance to the own entry is worked out anew: if
it lies below the first bound, nothing can be nearer and the part is done. Otherwise the entries up to the first bound above
it are compared, and only where even the outer bound falls short are all entries. ``b`` adapts: it shrinks to the position that
all but ``SPARE`` of the parts needed in the round before. Bounds are floats, rounded to the safe side; a bound never decides
a tie. All distances compared are exact integers, in floats while they stay below 2**53 and as Python numbers beyond.

Layout: the table is written once as integers of 2, 4 or 8 bytes, then once per round with the bounds beside them; the table
of the round before is deleted when the next one stands, so that two are there at a time. Tasks add up the parts of
each entry and send one row per entry; one aggregation of those, of (parts x entries) rows, reaches the driver per
round. A task keeps one Arrow batch. Lost executors repeat only tasks of the running round.

Defined cases: vectors that are null or hold a null or a component that is not finite are dropped. Vectors shorter than the
longest, and a longest length that is no multiple of ``parts``, are filled up with zeros. The first entries are the parts of
the smallest ids; rows of one id count each, in the order of their components, and null ids come last. Fewer vectors
than entries make a shorter codebook. Rows without a label have one label together. Errors beyond a long stop at the largest long. An
empty table gives an empty result and an empty codebook. Further columns are not read; names cannot clash, as columns are renamed on entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.llm.common import by_value, join_groups
from tabscope.session import dropped, scratch_path

#: Closest entries kept at first, and the share of parts that may need more than the positions kept.
CLOSEST, SPARE = 16, 0.02

#: Numbers of a batch that are worked on at a time.
AT_ONCE = 1 << 21

_UP, _LONGEST = 1 + 1e-9, (1 << 63) - 1


class Shape(NamedTuple):
    """Parts, components of a part, and how integers are stored and compared."""

    parts: int
    width: int
    stored: str  # numpy type of the integers in the table
    compared: str  # "f8" where all distances are exact in it, else "O"


def _record(shape: Shape, b: int) -> np.dtype:
    """What each vector keeps: entry, closest others, bounds and outer bound per part."""
    p = shape.parts
    return np.dtype([("entry", "u1", (p,)), ("near", "u1", (p, b)), ("low", "<f4", (p, b)), ("far", "<f4", (p,))])


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x / _UP).astype("f4"), np.float32(-np.inf))


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row to its own entry; exact."""
    gap = x - entries
    return (gap * gap).sum(axis=-1)


def searched(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """Entry, squared distance, ``b`` closest others with their distances, and the next one's, by comparing all entries."""
    n, k = len(x), len(book)
    square = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]
    rows, entry = np.arange(n), square.argmin(axis=1)  # the first of equals
    best = square[rows, entry]
    others = np.sqrt(square.astype("f8"))
    others[rows, entry] = np.inf
    if k - 1 > b:
        near = np.argpartition(others, b, axis=1)[:, :b + 1]
        near = np.take_along_axis(near, np.take_along_axis(others, near, 1).argsort(axis=1), 1)
        gaps = np.take_along_axis(others, near, 1)
        return entry, best, near[:, :b], gaps[:, :b], gaps[:, b]
    near = others.argsort(axis=1)[:, :b]
    return entry, best, near, np.take_along_axis(others, near, 1), np.full(n, np.inf)


def reassigned(x: np.ndarray, book: np.ndarray, old: np.ndarray, part: int, moved: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """The same, from the bounds of the round before (records ``old``), and the position that each row needed."""
    entry, near = old["entry"][:, part].astype(np.int64), old["near"][:, part].astype(np.int64)
    low, far = old["low"][:, part].astype("f8") - moved[near], old["far"][:, part].astype("f8") - moved.max(initial=0)
    bounds = np.minimum.accumulate(np.concatenate([low, far[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    best = _distances(x, book[entry])
    needed = (bounds <= np.sqrt(best.astype("f8"))[:, None] * _UP).sum(axis=1)
    low, far, kept = bounds[:, :-1].copy(), bounds[:, -1].copy(), near.shape[1]
    for most in range(1, kept + 1):  # rows that the first ``most`` others may beat: these are put in order by exact distances
        rows = np.flatnonzero(needed == most)
        if len(rows):
            ids = np.concatenate([entry[rows, None], near[rows, :most]], axis=1)
            exact = _distances(x[rows, None, :], book[ids])
            order = np.lexsort((ids, exact), axis=1)
            ids, exact = np.take_along_axis(ids, order, 1), np.take_along_axis(exact, order, 1)
            entry[rows], best[rows], near[rows, :most] = ids[:, 0], exact[:, 0], ids[:, 1:]
            low[rows, :most] = np.sqrt(exact[:, 1:].astype("f8"))
    if b < kept:
        low, near, far = low[:, :b], near[:, :b], low[:, b]
    rows = np.flatnonzero(needed > kept)
    if len(rows):
        entry[rows], best[rows], near[rows], low[rows], far[rows] = searched(x[rows], book, b)
    return entry, best, near, low, far, needed


def _assign(shape: Shape, books: np.ndarray, moved: np.ndarray | None, kept: int, b: int, record: bool, sums_type: pa.DataType, names: list[str]):
    """Task of one round: reads (id, label, v, s), writes them with new bounds, then a row of sums per entry.

    The last round (``record`` false) writes code and error in the place of bounds and sums.
    """
    parts, entries = books.shape[:2]
    books = books.astype(shape.compared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, shape.width), "O")
        needs = np.zeros(kept + 2, np.int64)
        step = max(1, AT_ONCE // max(1, parts * max(shape.width, entries)))
        kinds = None
        for whole in batches:
            kinds = whole.schema
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                n = batch.num_rows
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), shape.stored).reshape(n, parts, shape.width).astype(shape.compared)
                if shape.compared == "O":
                    x = np.array([int(z) for z in x.ravel()] or [0], "O")[:x.size].reshape(x.shape)
                old = np.frombuffer(b"".join(batch.column(3).to_pylist()), _record(shape, kept)) if moved is not None else None
                new, error = np.zeros(n, _record(shape, b)), np.zeros(n, shape.compared)
                for p in range(parts):
                    if old is None:
                        entry, best, near, low, far = searched(x[:, p], books[p], b)
                    else:
                        entry, best, near, low, far, needed = reassigned(x[:, p], books[p], old, p, moved[p], b)
                        needs += np.bincount(needed, minlength=kept + 2)
                    new["entry"][:, p], new["near"][:, p], new["low"][:, p], new["far"][:, p] = entry, near, _down(low), _down(far)
                    error = error + best
                    if record:
                        counts[p] += np.bincount(entry, minlength=entries)
                        if shape.compared == "O":
                            np.add.at(sums[p], entry, x[:, p])
                        else:
                            for i in range(shape.width):
                                sums[p, :, i] += np.bincount(entry, x[:, p, i], entries).astype(np.int64)
                if record:
                    raw, size = new.tobytes(), new.dtype.itemsize
                    state = pa.array([raw[i * size:(i + 1) * size] for i in range(n)], pa.binary())
                    nothing = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(sums_type))]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], state, *nothing], names)
                else:
                    codes = pa.array([bytes(c).hex() for c in new["entry"]], pa.string())
                    errors = pa.array([min(int(e), _LONGEST) for e in error], pa.int64())
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], codes, errors], names)
        if record and kinds is not None:
            rows = [(p * entries + j, int(counts[p, j]), sums[p, j].tolist()) for p in range(parts) for j in np.flatnonzero(counts[p])]
            rows.append((-1, 0, needs.tolist()))
            lists = [[int(z) for z in r[2]] for r in rows]
            if pa.types.is_decimal(sums_type):
                from decimal import Decimal

                lists = [[Decimal(z) for z in r] for r in lists]
            none = [pa.nulls(len(rows), kinds.field(i).type) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array(lists, pa.list_(sums_type))], names)

    return run


def _integers(shape: Shape, scale: int):
    """Task that writes vectors as integers: (id, label, v, s), ``s`` still empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = shape.parts * shape.width
        for batch in batches:
            vectors = []
            for value in batch.column(2):
                x = np.zeros(size, "f8")
                given = value.values.to_numpy(zero_copy_only=False).astype("f8")
                x[:len(given)] = np.floor(given * scale)
                vectors.append(x.astype(shape.stored).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(vectors, pa.binary()), pa.nulls(batch.num_rows, pa.binary())], ["id", "label", "v", "s"])

    return run


def _mean(books: np.ndarray, rows: list, shape: Shape) -> np.ndarray:
    """The next codebooks, from the sums per entry; unused entries stay."""
    new, entries = books.copy(), books.shape[1]
    for row in rows:
        if row.entry >= 0:
            new[row.entry // entries, row.entry % entries] = [int(z) // row.n for z in row[2:2 + shape.width]]
    return new


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4,
               entries: int = 256, rounds: int = 4, scale: int = 1024, closest: int = CLOSEST) -> tuple[DataFrame, np.ndarray, list[float]]:
    """((vec_id, label, code, error) per kept vector, codebooks [part, entry, component], share of full searches per round)."""
    if not 0 < entries <= 256:
        raise ValueError("a code takes one byte, so there are at most 256 entries")
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("x")).where(
        "x IS NOT NULL AND forall(x, z -> z IS NOT NULL AND NOT isnan(z) AND abs(z) < double('Infinity'))")
    facts = kept.agg(F.max(F.size("x")).alias("size"), F.max(F.expr("array_max(transform(x, z -> abs(CAST(z AS DOUBLE))))")).alias("most"),
                     F.count("*").alias("n")).head()
    width, most = -(-(facts.size or 0) // parts), int((facts.most or 0) * scale) + 1
    exact = parts * max(width, 1) * (2 * most) ** 2 < 1 << 53
    shape = Shape(parts, width, "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8", "f8" if exact else "O")
    sums = T.LongType() if most * (facts.n + 1) < 1 << 62 else T.DecimalType(38, 0)
    keys = [T.StructField("id", kept.schema["id"].dataType), T.StructField("label", kept.schema["label"].dataType)]
    plain = T.StructType([*keys, *T.StructType.fromDDL("v binary, s binary").fields])
    state_type = T.StructType([*plain.fields, *T.StructType.fromDDL("entry int, n long").fields, T.StructField("sums", T.ArrayType(sums))])
    path = scratch_path(spark, "vectors")
    kept.mapInArrow(_integers(shape, scale), plain).write.parquet(path)
    table = spark.read.parquet(path)
    first = table.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    books = np.array([int(z) for r in first for z in np.frombuffer(bytes(r.v), shape.stored)], "O")
    books = books.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    b, before, moved, full = max(0, min(closest, len(first) - 1)), 0, None, []
    arrow = pa.decimal128(38, 0) if isinstance(sums, T.DecimalType) else pa.int64()
    for _ in range(rounds if len(first) else 0):
        run = _assign(shape, books, moved, before, b, True, arrow, state_type.names)
        new_path = scratch_path(spark, "vectors")
        table.select("id", "label", "v", "s").mapInArrow(run, state_type).write.parquet(new_path)
        dropped(spark, path)
        path, written = new_path, spark.read.schema(state_type).parquet(new_path)
        # The position needed comes in the row of entry -1, a sum per position; it has one place more than there are bounds.
        slots = max(width, before + 2)
        rows = written.where("entry IS NOT NULL").groupBy("entry").agg(
            F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"z{i}") for i in range(slots))).collect()
        needs = [int(z or 0) for r in rows if r.entry < 0 for z in r[2:2 + before + 2]]
        before = b
        if moved is not None and sum(needs):
            reached = np.cumsum(needs[:-1]) >= (1 - SPARE) * sum(needs[:-1])
            b = max(min(1, b), min(b, int(np.argmax(reached))))
            full.append(needs[-1] / sum(needs))
        new = _mean(books, rows, shape)
        moved = np.sqrt(((new - books) ** 2).sum(axis=2).astype("f8")) * _UP
        books, table = new, written.where("entry IS NULL")
    coded = T.StructType([*keys, *T.StructType.fromDDL("code string, error long").fields])
    run = _assign(shape, books, moved, before, b, False, arrow, coded.names)
    last = scratch_path(spark, "vectors")
    if len(first):
        table.select("id", "label", "v", "s").mapInArrow(run, coded).write.parquet(last)
        dropped(spark, path)
        table = spark.read.parquet(last)
    else:
        table = table.selectExpr("id", "label", "CAST(NULL AS STRING) AS code", "CAST(NULL AS BIGINT) AS error")
    return table.withColumnsRenamed({"id": "vec_id"}), books, full


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The errors summed over equal labels beside each row, whatever share of the rows a label has."""
    rows = coded.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    groups = rows.groupBy("_key").agg(F.least(total, F.lit(_LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("_n"))
    return join_groups(rows, groups, "_key", "_n", coded.count()).drop("_key", "_n")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(str(z) for z in books.ravel().tolist()).encode()).hexdigest()


by_value(__name__)
