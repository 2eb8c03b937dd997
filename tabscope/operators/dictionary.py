"""A dictionary of the values of text columns, numbered and looked up on the executors, however many there are."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.operators.frequencies import unpivoted
from tabscope.operators.order import numbered
from tabscope.session import materialised

#: Longer values stand in the dictionary as their digests, so that no text crosses the network whole.
LONGEST = 64
#: Values of a column, of LONGEST characters at most, up to which they are broadcast; the slots are the same beyond.
BROADCAST_VALUES = 100_000
#: A value with more than this part of the rows is hot: there are at most as many hot values.
HOT_SHARE = 1_000
#: Places over which rows of hot values are dealt where the others are shuffled.
SPREAD = 1_000_000


def entry_of(text: str) -> str:
    """SQL for what stands for a text in the dictionary."""
    return f"CASE WHEN length({text}) > {LONGEST} THEN sha2({text}, 256) ELSE {text} END"


@dataclass
class Dictionary:
    """(ordinal, value, n, slot): the entries of each column, numbered from 0 in text order; the driver keeps their number."""

    entries: DataFrame
    sizes: dict[int, int]
    n_rows: int

    def look_up(self, rows: DataFrame, ordinal: int, column: str, out: str, spread_by: Sequence[str]) -> DataFrame:
        """Add the slot of ``column``, which holds entries, as a double; the number of entries where it is none of them.

        Entries of few values are broadcast. Beyond that only hot ones are, and the rows that hold them are dealt by
        ``spread_by`` while the others meet their entry by a shuffle. Names that begin with ``out`` must be free.
        """
        size = self.sizes[ordinal]
        own = self.entries.where(F.col("ordinal") == ordinal)
        value, slot, salt, hot = f"{out}_v", f"{out}_s", f"{out}_p", f"{out}_t"
        names = [F.col("value").alias(value), F.col("slot").alias(slot)]
        if size <= BROADCAST_VALUES:
            met = rows.join(F.broadcast(own.select(*names)), F.col(column) == F.col(value), "left")
            return met.withColumn(out, F.expr(f"coalesce(CAST({slot} AS DOUBLE), {size}D)")).drop(value, slot)
        is_hot = f"n * {HOT_SHARE} > {self.n_rows}"
        few = own.where(is_hot).select(F.col("value").alias(f"{hot}_v"), F.col("slot").alias(hot))
        dealt = rows.join(F.broadcast(few), F.col(column) == F.col(f"{hot}_v"), "left").withColumn(
            salt, F.expr(f"CASE WHEN {hot} IS NULL THEN 0 ELSE 1 + pmod(xxhash64({', '.join(spread_by)}), {SPREAD}) END"))
        rest = own.where(f"NOT ({is_hot})").select(*names, F.lit(0).cast("bigint").alias(f"{salt}_0"))
        met = dealt.join(rest, (F.col(column) == F.col(value)) & (F.col(salt) == F.col(f"{salt}_0")), "left")
        return met.withColumn(out, F.expr(f"CAST(coalesce({hot}, {slot}, {size}) AS DOUBLE)")).drop(
            value, slot, salt, hot, f"{hot}_v", f"{salt}_0")


def dictionary(df: DataFrame, columns: Sequence[str]) -> Dictionary:
    """The entries of columns without NULLs. Counted with a map-side part, numbered by a range partitioning, written once."""
    cells = unpivoted(df.selectExpr(*columns), {i: f"c{i}" for i in range(len(columns))})
    counts = cells.groupBy("ordinal", "value").agg(F.count(F.lit(1)).alias("n"))
    entries = materialised(numbered(counts, ["value"], within="ordinal", name="slot"))
    # One row per column.
    sizes = entries.groupBy("ordinal").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")).collect()
    return Dictionary(entries, {r.ordinal: r.size for r in sizes}, max((r.n for r in sizes), default=0))
