"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

Every document belongs to a leaf of a tree of domains, languages and sources. A budget of tokens goes down the tree: the
children of a node share its budget in proportion to their weights, but none gets more than it can supply, its tokens
times ``epochs``. What a child cannot supply goes to its siblings in proportion to their weights, and only what all of them
cannot take goes back to the node, that is to the siblings of the ancestors: a node's capacity is the sum of its leaves',
and it never gets more than that. So shortages move to siblings before they move to ancestors.

The shares of one family in closed form: put the children in order of capacity per weight. A child is *full* if the budget
covers the capacities up to it and, at its own capacity per weight, all that follow; the others share what the full ones
leave by weight. All amounts are whole tokens, rounded down (less than one token per node is lost).

A leaf's amount is whole epochs over all its documents and a prefix of one more. Each epoch has its own order, an MD5 digest
of seed, epoch and doc_id; a document is in the prefix if it and all before it fit in the rest. Finding the prefix sorts no
leaf: tokens are summed over ``CELLS`` ranges of the digest, and only the documents of the one range where the rest runs out
are put in order, so that a leaf may hold any share of the rows. Texts are never shuffled, only numbers.

Tokens are words ``[^\\x20\\x09-\\x0D]+``, a stand-in that needs no vocabulary; ``tokens`` takes any SQL.

Defined cases: null texts have no tokens; such documents are in the prefix if what precedes them fits. Null languages
and sources are the leaf ``unknown``. Rows that repeat a doc_id fall on one place of the order and are taken in order of
tokens. Weights that are not listed are 1, a weight of 0 gets nothing. A budget above what the epochs supply gives all
epochs. An empty table gives an empty result. Other columns are not read or, in :func:`mixed`, carried unchanged.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.common import join_groups, sized, written

WORDS = r"regexp_count(coalesce(text, ''), r'[^\x20\x09-\x0D]+')"
LEVELS = ("domain", "language", "origin")

#: Ranges of the digest per leaf: a power of two, so that a range is its first bits.
CELL_BITS = 16
PLACE_BITS = 60

#: The domain that a source belongs to, when the table has no such column: by the source's number.
DOMAIN = ("CASE WHEN source IS NULL THEN 'unknown' WHEN regexp_like(source, '^src[0-9]+$') "
          "THEN concat('domain', pmod(CAST(substr(source, 4) AS BIGINT), 4)) ELSE 'other' END")


def _weight(level: str, weights: Mapping[str, int]) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {int(w)}" for name, w in weights.items())
    return f"CASE {level} {cases} ELSE 1 END" if cases else "1"


def _shared(children: DataFrame, parent: list[str]) -> DataFrame:
    """Add ``amount``: each child's share of its parent's ``budget``, by ``weight`` and up to ``capacity``."""
    order = Window.partitionBy(*parent).orderBy(F.expr("capacity / weight"), "name")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    family = Window.partitionBy(*parent)
    big = "DECIMAL(38,0)"
    rows = children.where("weight > 0").withColumns({
        "caps": F.sum("capacity").over(upto), "passed": F.sum("weight").over(upto), "weights": F.sum("weight").over(family)})
    # budget >= capacities so far + capacity / weight * weights that follow
    rows = rows.withColumn("is_full", F.expr(
        f"CAST(budget - caps AS {big}) * weight >= CAST(capacity AS {big}) * (weights - passed)"))
    rows = rows.withColumns({
        "left_budget": F.expr("budget") - F.coalesce(F.sum(F.expr("CASE WHEN is_full THEN capacity END")).over(family), F.lit(0)),
        "left_weight": F.sum(F.expr("CASE WHEN is_full THEN 0 ELSE weight END")).over(family)})
    amount = f"CASE WHEN is_full THEN capacity ELSE CAST(left_budget AS {big}) * weight div left_weight END"
    return rows.withColumn("amount", F.expr(amount)).drop("caps", "passed", "weights", "is_full", "left_budget", "left_weight")


def allotments(leaves: DataFrame, budget: int, epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """(domain, language, origin, n_docs, n_tokens, amount) from one row per leaf, without amount.

    The windows run over one row per child of a family. ``budget`` is in tokens.
    """
    leaves = leaves.withColumn("capacity", F.expr(f"n_tokens * {int(epochs)}L"))
    above, keys = None, []
    for level in LEVELS:
        nodes = leaves.groupBy(*keys, level).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumns({"name": F.col(level), "weight": F.expr(f"CAST({_weight(level, weights.get(level, {}))} AS BIGINT)")})
        if above is None:
            nodes = nodes.withColumns({"budget": F.lit(int(budget)).cast("long"), "root": F.lit(0)})
        else:
            nodes = nodes.join(above, keys)
        shared = _shared(nodes, keys or ["root"])
        keys = [*keys, level]
        above = shared.select(*keys, F.col("amount").alias("budget"))
    return leaves.drop("capacity").join(above.withColumnRenamed("budget", "amount"), list(LEVELS), "left").withColumn(
        "amount", F.expr("coalesce(amount, 0L)"))


def place(seed: int, epoch: str, doc_id: str) -> str:
    """SQL: place of a document in an epoch's order, PLACE_BITS bits of a digest."""
    return f"CAST(conv(substr(md5(concat_ws('|', '{int(seed)}', {epoch}, coalesce(CAST({doc_id} AS STRING), ''))), 1, 15), 16, 10) AS BIGINT)"


def chosen(docs: DataFrame, budget_share: float = 0.5, epochs: int = 4, weights: Mapping[str, Mapping[str, int]] | None = None,
           seed: int = 7, tokens: str = WORDS, domain: str = DOMAIN) -> DataFrame:
    """(doc_id, domain, language, origin, n_tokens, copies) for every row of (doc_id, text, lang, source).

    ``copies`` says how often the mix takes the document. The budget is ``budget_share`` times all tokens, rounded down.
    ``weights`` has whole numbers by level (domain, language, origin) and name.
    """
    rows = written(docs.selectExpr("doc_id", f"{domain} AS domain", "coalesce(lang, 'unknown') AS language",
                                   "coalesce(source, 'unknown') AS origin", f"CAST({tokens} AS BIGINT) AS n_tokens"))
    leaves = written(rows.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
    total = leaves.agg(F.sum("n_docs").alias("rows"), F.sum("n_tokens").alias("tokens")).head()
    n_rows, all_tokens = total.rows or 0, total.tokens or 0
    amounts = allotments(leaves, int(all_tokens * budget_share), epochs, weights or {})
    leaf = "struct(domain, language, origin) AS leaf"
    # Whole epochs and the rest of each leaf; leaves without tokens have neither.
    amounts = amounts.selectExpr(leaf, "n_docs", "CASE WHEN n_tokens > 0 THEN amount div n_tokens ELSE 0 END AS whole",
                                 "CASE WHEN n_tokens > 0 THEN amount % n_tokens ELSE 0 END AS rest")
    amounts = written(amounts)

    rows = rows.selectExpr("*", leaf, "n_tokens AS t").drop(*LEVELS)
    rows = join_groups(rows, amounts, "leaf", "n_docs", n_rows)
    rows = rows.withColumn("place", F.expr(place(seed, "whole + 1", "doc_id")))
    rows = rows.withColumn("cell", F.expr(f"shiftright(place, {PLACE_BITS - CELL_BITS})"))
    # Where the rest runs out, per leaf: one row per leaf and range is summed up, in order, and one row per leaf is left.
    cells = rows.where("rest > 0").groupBy("leaf", "cell").agg(F.sum("t").alias("t"), F.first("rest").alias("rest"), F.first("n_docs").alias("n_docs"))
    run = Window.partitionBy("leaf").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = cells.withColumn("upto", F.sum("t").over(run)).where("upto > rest").groupBy("leaf").agg(
        F.min_by(F.struct("cell", F.expr("upto - t").alias("before")), "cell").alias("edge"), F.first("n_docs").alias("n_docs"))
    edges = written(edges)  # the rest is less than the leaf's tokens, so every leaf with a rest has one
    none = rows.where("rest = 0").withColumn("more", F.lit(0))
    some = join_groups(rows.where("rest > 0").drop("n_docs"), edges, "leaf", "n_docs", n_rows)
    clear = some.where("cell <> edge.cell").withColumn("more", F.expr("CAST(cell < edge.cell AS INT)"))
    inside = Window.partitionBy("leaf").orderBy("place", "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = some.where("cell = edge.cell").withColumn("more", (F.col("edge.before") + F.sum("t").over(inside) <= F.col("rest")).cast("int"))
    columns = ["doc_id", "leaf", "n_tokens", "whole", "more"]
    out = none.select(*columns).unionByName(clear.select(*columns)).unionByName(border.select(*columns))
    return out.selectExpr("doc_id", "leaf.domain", "leaf.language", "leaf.origin", "n_tokens", "CAST(whole + more AS BIGINT) AS copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes its doc_id; rows that repeat one take its largest count."""
    picks = chosen(docs.select("doc_id", "text", "lang", "source"), **options).where("copies > 0")
    picks = sized(written(picks.groupBy(F.col("doc_id").alias("_pick")).agg(F.max("copies").alias("_copies"))))
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"))
    found = rows.join(picks, F.expr("_id <=> _pick"))
    return found.select("_doc", F.expr("explode(sequence(1L, _copies))")).select("_doc.*")
