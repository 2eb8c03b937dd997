"""Exact duplicates by two-pass Bloom filtering. DataFrame functions only.

Pass one hashes every text. Two positions of each hash are counted in one block of a blocked Bloom
filter; the positions that were hit twice or more make up the filter of *possibly repeated* hashes.
Pass two looks every row up in it. A row that misses has no copy and passes straight through; only the
rows that hit are shuffled and compared by their SHA-256 digest, so false hits cost work but no result.

What moves: two numbers per row in pass one, and digests (or, in :func:`deduplicate`, rows) of the hits in
pass two. The filter takes ``BITS_PER_ROW`` bits per row up to ``max_filter_bits`` (64 MB), which bounds the
broadcast; a table too large for that has a denser filter, more rows that are shuffled, and the same result.

Defined cases: a null text counts as empty, and all empty texts are copies of one another. The largest
identifier stays; a row without one only if no copy has one. Of rows that repeat text and identifier, one
stays. An empty table gives an empty result. Other columns, whatever their names, are carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import ascii_lower, join_groups, written

BITS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 29
BLOCK_BITS = 1 << 15  # of one bitmap of bitmap_construct_agg


def _digest(text: str) -> Column:
    return F.expr(f"unhex(sha2({ascii_lower(f'coalesce({text}, {chr(39) * 2})')}, 256))")


def _probes(rows: DataFrame, blocks: int) -> DataFrame:
    """Add the block and the two different positions in it that a digest is looked up at."""
    return rows.withColumn("_h", F.xxhash64("_sha")).withColumns({
        "_block": F.expr(f"pmod(shiftrightunsigned(_h, 30), {blocks}L)"),
        "_p1": F.expr(f"_h & {BLOCK_BITS - 1}L"),
        "_p2": F.expr(f"(_h & {BLOCK_BITS - 1}L) ^ (1 + shiftrightunsigned(_h, 15) % {BLOCK_BITS - 1}L)"),
    }).drop("_h")


def _blocks(n_rows: int, max_filter_bits: int) -> int:
    bits = min(max(BITS_PER_ROW * n_rows, BLOCK_BITS), max_filter_bits)
    return 1 << (max(bits // BLOCK_BITS, 1) - 1).bit_length()


def _filter(probed: DataFrame) -> DataFrame:
    """(_block, _bits): the positions that two or more rows hit."""
    slots = probed.select("_block", F.explode(F.array("_p1", "_p2")).alias("_p"))
    twice = slots.groupBy("_block", "_p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("_block").agg(F.expr("bitmap_construct_agg(_p)").alias("_bits"))


def _hit(position: str) -> str:
    byte = f"CAST(conv(hex(substring(_bits, CAST({position} div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    return f"shiftright({byte}, CAST({position} % 8 AS INT)) & 1 = 1"


def _marked(probed: DataFrame, bloom: DataFrame) -> DataFrame:
    """Add _maybe: whether the row may have a copy."""
    return (probed.join(F.broadcast(bloom), "_block", "left")
            .withColumn("_maybe", F.expr(f"coalesce({_hit('_p1')} AND {_hit('_p2')}, false)"))
            .drop("_bits", "_block", "_p1", "_p2"))


def _fingerprints(docs: DataFrame, text: str, doc_id: str, max_filter_bits: int) -> tuple[DataFrame, DataFrame, int, int]:
    """(_id, _row, _sha and probes) per row, written once; the filter; the number of rows and blocks."""
    prints = written(docs.select(
        F.col(doc_id).alias("_id"), F.monotonically_increasing_id().alias("_row"), _digest(text).alias("_sha")))
    n = prints.count()
    blocks = _blocks(n, max_filter_bits)
    return prints, written(_filter(_probes(prints, blocks))), n, blocks


def _groups(maybe: DataFrame) -> DataFrame:
    # A struct with a null identifier is the smallest.
    return maybe.groupBy("_sha").agg(F.expr("max(struct(_id, _row))").alias("_keep"), F.count(F.lit(1)).alias("_size"))


def decisions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
              max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row, the dropped ones too."""
    prints, bloom, n, blocks = _fingerprints(docs, text, doc_id, max_filter_bits)
    marked = _marked(_probes(prints, blocks), bloom)
    maybe = marked.where("_maybe").drop("_maybe")
    unique = marked.where("NOT _maybe").selectExpr("_id AS doc_id", "_id AS keep_id", "1L AS group_size", "true AS kept", "_sha")
    grouped = join_groups(maybe, _groups(maybe), "_sha", "_size", n).selectExpr(
        "_id AS doc_id", "_keep._id AS keep_id", "_size AS group_size", "_row = _keep._row AS kept", "_sha")
    return unique.unionByName(grouped).withColumn("text_sha256", F.lower(F.hex("_sha"))).drop("_sha")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay. Rows that miss the filter are not shuffled."""
    prints, bloom, _, blocks = _fingerprints(docs, text, doc_id, max_filter_bits)
    stays = _groups(_marked(_probes(prints, blocks), bloom).where("_maybe")).selectExpr("_sha", "_keep._id AS _keep_id")
    rows = docs.select(F.struct("*").alias("_doc"), F.col(doc_id).alias("_id"), _digest(text).alias("_sha"))
    marked = _marked(_probes(rows, blocks), bloom)
    # Copies of one text differ in their identifier, so this join spreads them.
    found = marked.where("_maybe").alias("r").join(
        stays.alias("s"), F.expr("r._sha = s._sha AND r._id <=> s._keep_id")).select("r._doc", "r._sha")
    return marked.where("NOT _maybe").select("_doc").unionAll(found.dropDuplicates(["_sha"]).select("_doc")).select("_doc.*")
