"""Statistics and numbering that depend on row order.

Rows are range-partitioned by the order key with the scan position as the last key, so that
equal keys, however many, are spread over partitions and keep the order of the file. Nothing
is ever sorted in a single task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.values import INTEGRAL, as_double, is_numeric, positional, quoted, reference
from tabscope.session import materialised

_STEPS = (
    "ordinal int, part int, n bigint, rising bigint, falling bigint, "
    "first_whole bigint, last_whole bigint, first_real double, last_real double"
)


def _step_counts(ordinals: Sequence[int]):
    """Per task and column: number of values, of steps up or level, of steps down or level, and both ends.

    The inner function names nothing of this package, so executors need only numpy and pyarrow.
    """
    names = [part.split()[0] for part in _STEPS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(ordinals)
        n, rising, falling = ([0] * k for _ in range(3))
        first: list = [None] * k
        last: list = [None] * k
        for batch in batches:
            for j in range(k):
                values = batch.column(j).drop_null().to_numpy(zero_copy_only=False)
                if len(values) == 0:
                    continue
                if n[j]:
                    rising[j] += int(values[0] >= last[j])
                    falling[j] += int(values[0] <= last[j])
                else:
                    first[j] = values[0]
                rising[j] += int(np.count_nonzero(values[1:] >= values[:-1]))
                falling[j] += int(np.count_nonzero(values[1:] <= values[:-1]))
                n[j] += len(values)
                last[j] = values[-1]
        part = TaskContext.get().partitionId()
        rows = []
        for j in range(k):
            if n[j]:
                ends = (first[j].item(), last[j].item())
                ends = (*ends, None, None) if isinstance(ends[0], int) else (None, None, *ends)
                rows.append((ordinals[j], part, n[j], rising[j], falling[j], *ends))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def in_order(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Rows globally sorted across partitions; ties keep the scan order, hot keys are split."""
    placed = df.withColumn("_scan_position", F.monotonically_increasing_id())
    keys = [quoted(c) for c in order_by] + [F.col("_scan_position")]
    return placed.repartitionByRange(*keys).sortWithinPartitions(*keys)


def monotonicity(df: DataFrame, order_by: Sequence[str] | str | None = None,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, n_values, rising, falling, monotonicity) for numeric columns.

    ``monotonicity`` is the larger of the shares of steps that do not fall and that do not rise,
    0 with fewer than three values. Rows are taken in ``order_by``; without it in scan order,
    which is the order of the file only for a table of one file.

    One narrow pass after the sort: each task counts its own steps and reports both ends per
    column, and the joints between tasks are added from those few rows.
    """
    if isinstance(order_by, str):
        order_by = [order_by]
    fields = df.schema.fields
    chosen = [i for i, f in enumerate(fields) if is_numeric(f.dataType) and (columns is None or f.name in columns)]
    if not chosen:
        return df.sparkSession.createDataFrame(
            [], "ordinal int, n_values bigint, rising bigint, falling bigint, monotonicity double")

    def value(i: int) -> str:
        ref, data_type = f"c{i}", fields[i].dataType
        return f"CAST({ref} AS BIGINT) AS v{i}" if isinstance(data_type, INTEGRAL) else f"{as_double(ref, data_type)} AS v{i}"

    keys = [f"c{df.columns.index(c)}" for c in order_by or []]
    data = positional(df).selectExpr(*[f"{k} AS k{j}" for j, k in enumerate(keys)], *[value(i) for i in chosen])
    if keys:
        data = in_order(data, [f"k{j}" for j in range(len(keys))])
    steps = data.select(*[f"v{i}" for i in chosen]).mapInArrow(_step_counts(chosen), _STEPS)
    joints = steps.selectExpr(
        "*",
        "lag(last_whole) OVER (PARTITION BY ordinal ORDER BY part) AS before_whole",
        "lag(last_real) OVER (PARTITION BY ordinal ORDER BY part) AS before_real")
    total = joints.groupBy("ordinal").agg(
        F.expr("sum(n) AS n_values"),
        F.expr("sum(rising) + count_if(first_whole >= before_whole OR first_real >= before_real) AS rising"),
        F.expr("sum(falling) + count_if(first_whole <= before_whole OR first_real <= before_real) AS falling"))
    return total.withColumn(
        "monotonicity",
        F.expr("CASE WHEN n_values < 3 THEN 0D ELSE greatest(rising, falling) / (n_values - 1) END"))


def numbered(df: DataFrame, order_by: Sequence[str] = (), within: str | None = None, name: str = "row_index") -> DataFrame:
    """Add a gapless 0-based row number in ``order_by`` (scan order without it), per value of ``within`` if given.

    The placed rows are checkpointed once: the numbers come from a second look at them, and only
    a written copy is sure to have the same partitions in both. Offsets are one row per
    partition (and group), so they are broadcast.
    """
    keys = ([within] if within else []) + list(order_by)
    placed = in_order(df, keys).drop("_scan_position") if keys else df
    placed = materialised(placed)
    # High bits: partition. Low bits: position in it.
    marked = placed.withColumn("_nr_at", F.monotonically_increasing_id()).withColumns({
        "_nr_part": F.expr("shiftright(_nr_at, 33)"), "_nr_group": F.expr(reference(within) if within else "0")})
    parts = marked.groupBy("_nr_group", "_nr_part").agg(F.expr("count(1) AS n"), F.expr("min(_nr_at) AS first"))
    offsets = parts.selectExpr(
        "_nr_group AS _of_group", "_nr_part AS _of_part",
        "coalesce(sum(n) OVER (PARTITION BY _nr_group ORDER BY _nr_part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
        "- first AS _of_shift")
    if within is None:
        offsets = F.broadcast(offsets)  # one row per partition
    joined = marked.join(offsets, F.expr("_nr_group <=> _of_group AND _nr_part = _of_part"))
    return joined.withColumn(name, F.expr("_nr_at + _of_shift")).drop(
        "_nr_at", "_nr_part", "_nr_group", "_of_group", "_of_part", "_of_shift")
