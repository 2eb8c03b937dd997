"""Records of quoted text files, cut in parallel by a scan over quote states.

A line break inside quotes does not end a record, so where a record begins depends on all that precedes it. Here files are
still read block by block: at the start of a line only one fact matters, whether a quoted value is open. Every block is read
under both answers and summed up as a map of two states; the maps of a file's blocks, a row each, are composed by a prefix scan
in a window; and a second scan cuts records in all blocks at once. Only what a block's border cuts in two is put together afterwards.

A quote opens a value only where a field begins, so a stray one, as in ``5" pipe``, is an ordinary character.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a row of cut text is: a record, or the end, middle or beginning of one that other blocks hold the rest of.
WHOLE, END, MIDDLE, BEGINNING = range(4)


def open_after(line: str, is_open: bool, separator: str = ",", quote: str = '"') -> bool:
    """Whether a quoted value is open behind the line, if one was or was not before it."""
    if quote not in line:
        return is_open
    at = 0
    while True:
        if not is_open:
            if not line.startswith(quote, at):
                if (at := line.find(separator, at) + 1) == 0:
                    return False
                continue
            at += 1
        if (at := line.find(quote, at)) < 0:
            return True
        if line.startswith(quote, at + 1):
            at, is_open = at + 2, True  # a doubled quote is one of the value's
        elif (at := line.find(separator, at) + 1) == 0:
            return False
        else:
            is_open = False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines, in order within a block, with the file and the block's first byte."""
    return spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Slices of a batch by block."""
    places = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
    start = 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i] != places[start]:
            yield places[start], batch.slice(start, i - start)
            start = i


def block_maps(lines: DataFrame, separator: str = ",", quote: str = '"') -> DataFrame:
    """(file, block, if_shut, if_open): the state behind each block for either state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, states = None, (False, True)
        for batch in batches:
            for here, part in _runs(batch):
                if here != place:
                    if place is not None:
                        yield pa.RecordBatch.from_pylist([{"file": place[0], "block": place[1], "if_shut": states[0], "if_open": states[1]}])
                    place, states = here, (False, True)
                quoted = pc.match_substring(part.column("value"), quote)
                for line in part.column("value").filter(quoted).to_pylist():
                    shut = open_after(line, states[0], separator, quote)
                    states = shut, shut if states[0] == states[1] else open_after(line, states[1], separator, quote)
        if place is not None:
            yield pa.RecordBatch.from_pylist([{"file": place[0], "block": place[1], "if_shut": states[0], "if_open": states[1]}])

    # A task may hold a block's lines in several runs only if they follow each other, so there is one row per block.
    return lines.mapInArrow(run, "file string, block long, if_shut boolean, if_open boolean")


def open_blocks(maps: DataFrame) -> DataFrame:
    """(file, block) of the blocks that begin inside a quoted value.

    A block either fixes the state behind it, keeps it or turns it over. The state before a block is the one that the last fixing
    block left, turned over as often as blocks after that one say. The window holds one row per block of a file.
    """
    order = Window.partitionBy("file").orderBy("block")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = maps.withColumn("turns", F.sum(F.expr("CAST(if_shut AND NOT if_open AS INT)")).over(so_far))
    fixed = F.expr("CASE WHEN if_shut = if_open THEN struct(if_shut AS state, turns) END")
    seen = turns.withColumn("fixed", fixed).withColumns({
        "last": F.last("fixed", ignorenulls=True).over(before), "turned": F.coalesce(F.max("turns").over(before), F.lit(0))})
    is_open = "coalesce(last.state, false) <> ((turned - coalesce(last.turns, 0)) % 2 = 1)"
    return seen.where(is_open).select("file", "block")


def _cut(separator: str, quote: str):
    """Task that cuts lines of blocks into records: (file, block, place, text, first), ``first`` for the first record of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        place, held, kind, state, first = None, [], WHOLE, False, False

        def told() -> pa.RecordBatch:
            names = ["file", "block", "place", "text", "first"]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
            out.clear()
            return batch

        def end_block() -> None:
            if held:  # the record goes on in the next block
                out.append((*place, MIDDLE if kind == END else BEGINNING, "\n".join(held), first))

        size = 0
        for batch in batches:
            for here, part in _runs(batch):
                if here != place:
                    if place is not None:
                        end_block()
                    place, held, first = here, [], here[1] == 0
                    state = part.column("open")[0].as_py()
                    kind = END if state else WHOLE
                if not (state or first) and not pc.any(pc.match_substring(part.column("value"), quote)).as_py():
                    texts = pc.replace_substring_regex(part.column("value"), "\\r$", "")  # every line is a record
                    texts = texts.filter(pc.not_equal(pc.utf8_trim_whitespace(texts), ""))
                    if out:
                        yield told()
                    n = len(texts)
                    columns = [pa.array([here[0]] * n, pa.string()), pa.array([here[1]] * n, pa.int64()), pa.array([WHOLE] * n, pa.int32()), texts,
                               pa.array([False] * n, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "place", "text", "first"])
                    continue
                for line in part.column("value").to_pylist():
                    if first and not held:
                        line = line.removeprefix("﻿")
                    state = open_after(line, state, separator, quote)
                    if state:
                        held.append(line)
                        continue
                    text = "\n".join([*held, line]).removesuffix("\r") if held else line.removesuffix("\r")
                    if kind == END or text.strip():
                        out.append((*place, kind, text, first))
                        size += len(text)
                        first = False
                    held, kind = [], WHOLE
                    if size > 4 << 20:
                        yield told()
                        size = 0
        if place is not None:
            end_block()
        if out:
            yield told()

    return run


def records(spark: SparkSession, path: str, header: bool = True, separator: str = ",", quote: str = '"') -> DataFrame:
    """(record): one row per record of the file or files, without empty lines and, with ``header``, each file's first record."""
    lines = _lines(spark, path)
    # One row per block that begins inside a value: as many as there are tasks, at most.
    inside = F.broadcast(open_blocks(block_maps(lines, separator, quote)).withColumn("open", F.lit(True)))
    begun = lines.join(inside, ["file", "block"], "left").select("value", "file", "block", F.coalesce("open", F.lit(False)).alias("open"))
    cut = begun.mapInArrow(_cut(separator, quote), "file string, block long, place int, text string, first boolean")
    if header:
        cut = cut.where("NOT first")
    whole = cut.where(f"place = {WHOLE}").select(F.col("text").alias("record"))
    # At most two rows per block; the parts of one record follow each other, each beginning opens the next one.
    run = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = cut.where(f"place <> {WHOLE}").withColumn("number", F.sum(F.expr(f"CAST(place = {BEGINNING} AS INT)")).over(run))
    joined = parts.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "place", "text"))).alias("parts"))
    text = F.expr("array_join(transform(parts, p -> p.text), '\\n')")
    return whole.unionByName(joined.select(text.alias("record")))


# The tasks' functions travel with them, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
