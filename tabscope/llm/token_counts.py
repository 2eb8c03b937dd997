"""Token counts of documents in flat token files without an index, by a scan for separators.

A flat file is a stream of token identifiers in which an end-of-document identifier closes each document; nothing says where
documents start. It is held as rows (file, block, data): blocks of the stream in order, cut anywhere, also within documents.

1. Each block is searched on its own, as one vectorised comparison: the places of the separators give the lengths of the documents
   inside; what stands before the first and after the last one belongs to documents that cross the border.
2. A prefix scan over the block summaries says how many documents ended before a block and how many tokens have been open since. It
   runs over segments of ``SEGMENT`` blocks and then over the segments, so a file of any size is no single task's work.
3. The first length of a block is what was open before plus what stands before its first separator.

A last document without a separator is reported with ``closed`` false. Defined cases: empty documents have no tokens but a separator, so
they count; null texts are empty. A file without blocks has no documents. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.common import by_value, slices
from tabscope.session import scratch_path

BLOCK_BYTES = 1 << 20
SEGMENT = 4_096
TOKEN = "<u2"  # 16 bits, little-endian


def write_token_files(docs: DataFrame, ranks_path: str, pattern: str, end_of_document: int, text: str = "text",
                      doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Encode every text into flat files in the shared folder, one per partition of ``docs``.

    Returns the files as rows (file, block, data), and which document stands where: (file, ordinal, doc_id).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks_path, "rb") as source:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source)}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        if max(max(ranks.values()), end_of_document) >= 1 << 16:
            raise ValueError("identifiers take 16 bits")
        file, block, ordinal, held = TaskContext.get().partitionId(), 0, 0, b""

        def out(numbers: list[int], ids: list[int | None], data: list[bytes | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * len(numbers), pa.int32()), pa.array(numbers, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(data, pa.binary()), pa.array([d is not None for d in data])], names=["file", "number", "doc_id", "data", "is_block"])

        for batch in slices(batches, 1):
            ids = batch.column(0).to_pylist()
            yield out(list(range(ordinal, ordinal + len(ids))), ids, [None] * len(ids))
            ordinal += len(ids)
            parts = [held]
            for value in batch.column(1):
                parts.append(np.array([*encode(value.as_py() or ""), end_of_document], TOKEN).tobytes())
            held = b"".join(parts)
            blocks = [held[at:at + block_bytes] for at in range(0, len(held) - block_bytes + 1, block_bytes)]
            if blocks:
                yield out(list(range(block, block + len(blocks))), [None] * len(blocks), blocks)
                block += len(blocks)
                held = held[len(blocks) * block_bytes:]
        if held:
            yield out([block], [None], [held])

    path = scratch_path(docs.sparkSession, "token-files")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows.mapInArrow(run, "file int, number long, doc_id long, data binary, is_block boolean").write.partitionBy("is_block").parquet(path)
    spark, schema = docs.sparkSession, "file int, number long, doc_id long, data binary, is_block boolean"
    written = spark.read.schema(schema).parquet(path)
    return (written.where("is_block").selectExpr("file", "number AS block", "data"),
            written.where("NOT is_block").selectExpr("file", "number AS ordinal", "doc_id"))


def counted(blocks: DataFrame, end_of_document: int) -> DataFrame:
    """(file, ordinal, n_tokens, closed) for every document in the blocks (file, block, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time
                tokens = np.frombuffer(batch.column(2)[i].as_buffer(), TOKEN)
                ends = np.flatnonzero(tokens == end_of_document)
                head = int(ends[0]) if len(ends) else len(tokens)
                tail = len(tokens) - 1 - int(ends[-1]) if len(ends) else len(tokens)
                numbers = [len(tokens), len(ends), head, tail]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *(pa.array([n], pa.int64()) for n in numbers),
                     pa.array([np.diff(ends) - 1], pa.list_(pa.int64()))], names=["file", "block", "n", "ends", "head", "tail", "inner"])

    found = blocks.select("file", "block", "data").mapInArrow(
        run, "file int, block long, n long, ends long, head long, tail long, inner array<long>")
    found = found.withColumn("segment", F.expr(f"block div {SEGMENT}"))
    before = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Positions count from the start of the segment, then of the file.
    found = found.withColumns({"start": F.coalesce(F.sum("n").over(before), F.lit(0)), "ended": F.coalesce(F.sum("ends").over(before), F.lit(0))})
    found = found.withColumn("last", F.expr("CASE WHEN ends > 0 THEN start + n - tail END"))
    found = found.withColumn("last", F.max("last").over(before)).withColumn("own", F.expr("CASE WHEN ends > 0 THEN start + n - tail END"))
    segments = found.groupBy("file", "segment").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max("own").alias("own"), F.max("block").alias("top"))
    earlier = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("file").orderBy("segment").rowsBetween(1, Window.unboundedFollowing)
    segments = segments.withColumns({
        "s_start": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "s_ended": F.coalesce(F.sum("ends").over(earlier), F.lit(0)),
        "final": F.count(F.lit(1)).over(later) == 0})
    segments = segments.withColumn("s_last", F.max(F.expr("s_start + own")).over(earlier))
    rows = found.join(segments.select("file", "segment", "s_start", "s_ended", "s_last", "final", "top"), ["file", "segment"])
    rows = rows.withColumn("open", F.expr("s_start + start - coalesce(s_start + last, s_last, 0)"))
    whole = rows.where("ends > 0").selectExpr(
        "file", "s_ended + ended AS first", "posexplode(concat(array(open + head), inner)) AS (at, n_tokens)").selectExpr(
        "file", "first + at AS ordinal", "n_tokens", "true AS closed")
    rest = rows.where("final AND block = top").selectExpr(
        "file", "s_ended + ended + ends AS ordinal", "CASE WHEN ends > 0 THEN tail ELSE open + n END AS n_tokens", "false AS closed")
    return whole.unionByName(rest.where("n_tokens > 0"))


by_value(__name__)
