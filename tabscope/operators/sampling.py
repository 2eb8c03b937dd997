"""Exact samples and splits by hashed keys, and keyed permutations of row numbers.

Choosing the q rows of a group with the lowest hash needs no sort: a histogram of the upper
hash bits finds the cell in which the q-th row lies, a second one over the lower bits narrows
it to one hash value. Rows below that value are in, rows above are out, and only rows that
share it (copies of one key) are ranked, by the skew-proof numbering of
:func:`tabscope.operators.order.numbered`. A group may hold any share of the table.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.values import is_missing, reference
from tabscope.operators.order import numbered
from tabscope.session import materialised

LOW_BITS = 16
BROADCAST_GROUPS = 100_000
HEAVY_SHARE = 1_000


def hash_position(key: Sequence[str], seed: int) -> str:
    """SQL: 32-bit position of a key, the first 8 hexadecimal digits of an MD5 digest."""
    parts = ", ".join(f"coalesce(CAST({reference(c)} AS STRING), '')" for c in key)
    return f"CAST(conv(substr(md5(concat_ws('|', '{seed}', {parts})), 1, 8), 16, 10) AS BIGINT)"


def _edges(rows: DataFrame, cell: str, quota: str, carried: str) -> DataFrame:
    """Per group, the cell in which the quota is reached and how many of its rows are still needed."""
    counts = rows.groupBy("_group", *([carried] if carried else []), F.expr(f"{cell} AS _cell")).agg(F.expr("count(1) AS n"))
    running = counts.selectExpr(
        "*", "sum(n) OVER (PARTITION BY _group) AS total",
        "coalesce(sum(n) OVER (PARTITION BY _group ORDER BY _cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
        "AS before")
    found = running.selectExpr("*", f"CAST({quota} AS BIGINT) - before AS need").where("need BETWEEN 1 AND n")
    return found


def _joined(rows: DataFrame, edges: DataFrame, on: str, how: str, n_rows: int | None = None) -> DataFrame:
    """Join rows to the one written edge of their group, by broadcast where the edges are counted to be few.

    Beyond that, groups with more than a HEAVY_SHARE-th of the rows (so many there can be) are broadcast and the others meet
    by a shuffle in which no key is hot. ``edges`` has ``_g`` and ``_total``, the rows of the group.
    """
    condition = F.expr(on)
    if edges.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(edges), condition, how)
    heavy = F.expr(f"_total * {HEAVY_SHARE} > {rows.count() if n_rows is None else n_rows}")
    hot, cold = F.broadcast(edges.where(heavy)), edges.where(~heavy)
    named = F.broadcast(edges.where(heavy).select("_g"))
    apart = rows.join(named, F.expr("_group <=> _g"), "left_anti").join(cold, condition, how)
    return rows.join(named, F.expr("_group <=> _g"), "left_semi").join(hot, condition, how).unionByName(apart)


def mark_lowest(df: DataFrame, key: Sequence[str], quota: str, by: str | None = None, seed: int = 42,
                flag: str = "chosen") -> DataFrame:
    """Add boolean ``flag``: true on the rows of each group with the lowest hashed key.

    ``quota`` is SQL over ``total``, the rows of the group; ``by`` names the group column. The columns of ``df`` travel
    in a struct, so none of their names is reserved; only ``flag`` must be new.
    """
    if flag.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {flag} already")
    keys = {f"_key{i}": F.col(reference(c)) for i, c in enumerate(key)}
    rows = df.select(F.struct(*map(F.col, map(reference, df.columns))).alias("_row"), F.expr(f"{reference(by) if by else '0'} AS _group"),
                     F.expr(f"{hash_position(key, seed)} AS _hash"), *[c.alias(k) for k, c in keys.items()])
    upper, lower = f"shiftright(_hash, {LOW_BITS})", f"_hash & {(1 << LOW_BITS) - 1}"
    coarse = materialised(_edges(rows, upper, quota, "").selectExpr("_group AS _g", "_cell AS _upper", "need AS _wanted", "total AS _total"))
    inside = _joined(rows.select("_group", "_hash"), coarse, f"_group <=> _g AND {upper} = _upper", "inner").drop("_g")
    inside = inside.withColumn("_carry", F.expr("struct(_upper, _wanted, _total)"))
    fine = materialised(_edges(inside, lower, "_carry._wanted", "_carry").selectExpr(
        "_group AS _g", f"shiftleft(_carry._upper, {LOW_BITS}) | _cell AS _edge", "need AS _need", "n AS _at_edge", "_carry._total AS _total"))
    placed = _joined(rows, fine, "_group <=> _g", "left")
    if fine.where("_at_edge > _need").isEmpty():
        return placed.select("_row.*", F.expr("coalesce(_hash <= _edge, false)").alias(flag))
    shared = "coalesce(_hash = _edge AND _at_edge > _need, false)"
    clear = placed.where(f"NOT {shared}").select("_row.*", F.expr("coalesce(_hash <= _edge, false)").alias(flag))
    tied = numbered(placed.where(shared), order_by=list(keys), within="_group", name="_rank")
    return clear.unionByName(tied.select("_row.*", F.expr("_rank < _need").alias(flag)))


def unused(columns: Sequence[str], name: str) -> str:
    """``name``, with as many underscores behind as no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _keyed(df: DataFrame, key: Sequence[str] | None) -> tuple[DataFrame, list[str], list[str]]:
    """Without a key, rows get a number to hash; it is dropped again at the end."""
    if key:
        return df, list(key), []
    name = unused(df.columns, "_row")
    return numbered(df, name=name), [name], [name]


def sample_exact(df: DataFrame, n: int, key: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same ones for the same key and seed."""
    rows, names, extra = _keyed(df, key)
    flag = unused(rows.columns, "_chosen")
    return mark_lowest(rows, names, f"least({int(n)}, total)", seed=seed, flag=flag).where(flag).drop(flag, *extra)


def random_split(df: DataFrame, test_size: float = 0.2, key: Sequence[str] | None = None, seed: int = 42,
                 flag: str = "is_test") -> DataFrame:
    """Add ``is_test``: true on exactly ceil(test_size * rows) rows."""
    rows, names, extra = _keyed(df, key)
    return mark_lowest(rows, names, f"ceil({test_size!r}D * total)", seed=seed, flag=flag).drop(*extra)


def stratified_split(df: DataFrame, label: str, test_size: float = 0.2, key: Sequence[str] | None = None,
                     seed: int = 42, flag: str = "is_test") -> DataFrame:
    """Add ``is_test``: true on round(test_size * rows) rows of each class; a single row stays in training."""
    rows, names, extra = _keyed(df, key)
    quota = f"CASE WHEN total = 1 THEN 0 ELSE round({test_size!r}D * total) END"
    return mark_lowest(rows, names, quota, by=label, seed=seed, flag=flag).drop(*extra)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight n / (classes * n_c): every class weighs the same in total."""
    present = df.where(f"NOT {is_missing(reference(label), df.schema[label].dataType)}")
    counts = present.groupBy(F.col(reference(label)).alias("label")).agg(F.expr("count(1) AS n"))
    # The unpartitioned windows run over one row per class.
    return counts.selectExpr("label", "n", "sum(n) OVER () / (count(1) OVER () * CAST(n AS DOUBLE)) AS weight")


def _round_keys(n: int, seed: int, repeat: int) -> list[int]:
    draw = random.Random(f"{seed}/{repeat}")
    return [draw.randrange(n) for _ in range(max(24, 2 * n.bit_length()))]


def permuted(index: str, n: int, seed: int, repeat: int) -> str:
    """SQL: image of a row number in a pseudo-random permutation of 0 .. n-1.

    Swap-or-not shuffle (Hoang, Morris, Rogaway 2012): each round pairs x with k - x (mod n) and
    swaps the pair or not by one hashed bit, so it is one-to-one for any n and needs no sort.
    """
    if n < 2:
        return f"CAST({index} AS BIGINT)"
    keys = ", ".join(f"{k}L" for k in _round_keys(n, seed, repeat))
    mirror = f"((k + {n}L - x) % {n}L)"
    swap = f"(xxhash64({seed}, {repeat}, k, greatest(x, {mirror})) & 1L) = 1L"
    return f"aggregate(array({keys}), CAST({index} AS BIGINT), (x, k) -> CASE WHEN {swap} THEN {mirror} ELSE x END)"


def permuted_column(index: Column, rows: DataFrame, n: int, seed: int, repeat: int) -> Column:
    """The same permutation as :func:`permuted`, a batch of rows at a time.

    Spark interprets the steps of a fold row by row. The hash of what a round has in common, its key included, is taken
    from Spark once; each batch then only folds its numbers into it.
    """
    if n < 2:
        return index.cast("bigint")
    return _folded(n, permutation_rounds(rows.sparkSession, n, seed, repeat))(index)


def permutation_rounds(spark: SparkSession, n: int, seed: int, repeat: int) -> list[tuple[int, int]]:
    """(key, hash of what the round has in common) of each round; backwards they make the inverse permutation."""
    if n < 2:
        return []
    keys = _round_keys(n, seed, repeat)
    # One number per round.
    begun = spark.range(1).selectExpr(*[f"xxhash64({seed}, {repeat}, {k}L) AS r{i}" for i, k in enumerate(keys)]).first()
    return list(zip(keys, begun))


def images(n: int):
    """The images of row numbers by some rounds; the function names nothing of this package, so executors need only numpy."""
    def of(x: np.ndarray, rounds: list[tuple[int, int]]) -> np.ndarray:
        p1, p2, p3, p4 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63))
        x = x.astype(np.int64)  # a copy; all steps are done in place
        mirror, rest, h, part = (np.empty(len(x), t) for t in (np.int64, np.int64, np.uint64, np.uint64))

        def turned(left: int) -> None:
            np.left_shift(h, np.uint64(left), out=part)
            np.right_shift(h, np.uint64(64 - left), out=h)
            np.bitwise_or(h, part, out=h)

        def mixed(right: int) -> None:
            np.right_shift(h, np.uint64(right), out=part)
            np.bitwise_xor(h, part, out=h)

        for key, begun in rounds:
            np.subtract(key, x, out=mirror)
            np.right_shift(mirror, 63, out=rest)  # all bits of negative numbers
            mirror += np.bitwise_and(rest, n, out=rest)
            np.maximum(x, mirror, out=h.view(np.int64))
            h *= p2
            turned(31)
            h *= p1
            h ^= np.uint64((begun + 0x27D4EB2F165667C5 + 8) % 2**64)
            turned(27)
            h *= p1
            h += p4
            mixed(33)
            h *= p2
            mixed(29)
            h *= p3
            mixed(32)
            h &= np.uint64(1)
            np.bitwise_xor(x, mirror, out=mirror)
            x ^= np.bitwise_and(mirror, np.negative(h.view(np.int64), out=rest), out=rest)
        return x

    return of


def _folded(n: int, rounds: list[tuple[int, int]]):
    """A function of row numbers; it names nothing of this package, so executors need only numpy, pandas and pyarrow."""
    of = images(n)

    @F.pandas_udf("bigint")
    def folded(index: pd.Series) -> pd.Series:
        return pd.Series(of(index.to_numpy(), rounds))

    return folded
