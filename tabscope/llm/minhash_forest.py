"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on the full shingle sets.

1. Every text becomes its set of distinct word shingles, and the set a digest, a bit sketch and ``TREES`` labels, each
   a sequence of minimum hashes. Texts with equal sets form one class and go on as its smallest doc_id.
2. Each tree is a sorted order of labels, of ``DEPTH`` minimum hashes and ``FURTHER`` more. The longest common prefix (LCP) of
   each two neighbours in the order cuts it into regions: runs in which it is ``DEPTH`` or more. Depth adapts per region:
   one of at most ``SMALL`` rows is used as it is, a larger one is cut where the LCP is one longer, and so on, until its
   parts are small or the labels end. Regions of one class, most of them, are dropped at once.
3. Within a part, rows whose sketches agree are candidates: all against all in a small one, each row with the next ``SMALL``
   in the order in one that stays larger. Candidates join classes to *neighbourhoods*. A second pass goes back to the whole
   regions and joins neighbourhoods in which any other rows agree, so that depth saves work, not links. Both only draw
   candidates together: every two sets that share a region and agree are in one neighbourhood.
4. Links are confirmed within a neighbourhood, on the full sets: breadth first from each class, which is held against the ones
   not reached yet, so a dense group of near copies is run through about once, and no pairs are ever emitted.
5. A neighbourhood of more than ``PART`` shingles is dealt over several tasks. Each links its own rows; one class of the main
   component of each part then meet; any two classes not linked by then include a row outside the neighbourhood's main
   component. Such rows are dealt in blocks of at most about ``PART`` shingles too, as are the rows of the main component, and
   each block of them meets every block that can hold a link: of a set size within reach, and not both of *spent* rows. A row
   is spent if shingles that no other row of the neighbourhood has take up its share of what two linked sets may differ in.
   So a task holds two blocks whatever the neighbourhood's size, no link is lost, and texts of one template that are too
   different to be linked for words of their own do not meet at all.
6. Components of all confirmed links by large and small stars.

A region with more than a HEAVY_SHARE-th of all rows is dealt over several tasks in both passes. In the first, each task joins
its own rows, and one row of the largest neighbourhood of each task then meet, before the second pass looks at the rest.

Two sets at a Jaccard similarity of 0.8 share no region with probability (1 - 0.8^5)^32 = 3e-6, less at higher
similarity; sketches of 128 bits let a pair of 0.8 go with probability 1e-8. No pair that passes is skipped unless links
connect its ends already, and no pair is linked that the full sets do not confirm.

Defined cases: without words, or null, the set is empty and linked with nothing; with fewer words than a shingle, the
sequence is the one shingle. A row without doc_id is linked with nothing and has no component. Rows that share a doc_id
are one vertex. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import HEAVY_SHARE, by_value, give_back, join_groups, sized, slices, written
from tabscope.llm.components import components

TREES = 32
DEPTH, FURTHER = 5, 4
#: Rows of a region that are all compared; larger ones are cut at greater depth.
SMALL = 32
SKETCH_WORDS = 2  # of 64 bits
#: Sketch bits, of 128, in which two sets have to agree to be candidates at 0.8 or more: 5.6 deviations below the mean.
AGREEING = 96
LEAST_HEAVY = 20_000  # classes of a region that one task holds in any case
#: Shingles of a part of a neighbourhood: 32 MB of hashes.
PART = 4_000_000
#: Rows from which a task counts the shingles that one row alone has, before rows are compared.
LEAST_COUNTED = 64
REMEMBERED = 200_000  # word hashes that a worker keeps

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Hashes of the words seen so far."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; words are split at ASCII white space."""
    words = (text or "").encode().lower().split()  # bytes.lower changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    if len(known) > REMEMBERED:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    total = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        total = (total ^ h[i:len(h) - width + 1 + i]) * np.uint64(_MIX[0])
        total ^= total >> np.uint64(29)
    total = (total ^ np.uint64(width)) * np.uint64(_MIX[1])
    return np.unique(total ^ (total >> np.uint64(32)))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.RandomState(20)
    odd = draw.randint(0, 2**63 - 1, TREES * DEPTH, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    return odd, draw.randint(0, 2**63 - 1, TREES * DEPTH, dtype=np.int64).astype(np.uint64)


def signature(hashes: np.ndarray, odd: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the set, 32 bits each."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 512):
        values = hashes[start:start + 512, None] * odd
        values += offset
        np.minimum(least, values.min(axis=0), out=least)
    return least >> np.uint64(32)


def _labels(least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per tree the hash of the first DEPTH minimums and the next four, 16 bits each; the sketch."""
    trees = least.reshape(TREES, DEPTH)
    key = np.zeros(TREES, np.uint64)
    for i in range(DEPTH):
        key = (key ^ trees[:, i]) * np.uint64(_MIX[0])
        key ^= key >> np.uint64(31)
    further = np.roll(trees, -1, axis=0)  # the next tree's minimums are as good for going deeper
    order = np.zeros(TREES, np.uint64)
    for i in range(FURTHER):
        order = (order << np.uint64(16)) | (further[:, i] & np.uint64(0xFFFF))
    bits = ((least * np.uint64(_MIX[1])) >> np.uint64(40)) & np.uint64(1)
    sketch = np.packbits(bits[:64 * SKETCH_WORDS].astype(np.uint8)).view(np.int64)
    return key.view(np.int64), order.view(np.int64), sketch


def _signatures(docs: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """(id, n, digest, keys, orders, s0, s1) per row; the last four only with a set and a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, offset = _multipliers()
        known = WordHashes()
        for batch in slices(batches, 1):
            rows = []
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = shingle_hashes(value, width, known)
                if not len(hashes):
                    rows.append((number, 0, None, None, None, None, None))
                    continue
                key, order, sketch = _labels(signature(hashes, odd, offset))
                rows.append((number, len(hashes), xxhash.xxh128_digest(hashes.tobytes()), key, order, *sketch.tolist()))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                             names=["id", "n", "digest", "keys", "orders", "s0", "s1"])
        give_back()

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, n long, digest binary, keys array<long>, orders array<long>, s0 long, s1 long")


def _agreement(a0, a1, b0, b1):
    return 64 * SKETCH_WORDS - np.bitwise_count(a0 ^ b0).astype(np.int64) - np.bitwise_count(a1 ^ b1)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys, and the end."""
    if not len(keys[0]):
        return np.zeros(1, int)
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(change), len(change))


_REGION = ("tree", "key", "part")


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Whole regions, some at a time: the rows are sorted by region, the last one of a batch waits for the next batch."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        now |= {k: now[k].view(np.uint64) for k in ("s0", "s1")}  # for counting bits
        if rest is not None:
            now = {k: np.concatenate([rest[k], v]) for k, v in now.items()}
        if not len(now["key"]):
            continue
        cut = int(_runs(*(now[k] for k in _REGION))[-2])
        if cut:
            yield {k: v[:cut] for k, v in now.items()}
        rest = {k: v[cut:] for k, v in now.items()}
    if rest is not None:
        yield rest


def _parts(region: np.ndarray, further: np.ndarray) -> np.ndarray:
    """Starts of the parts that sorted rows are cut into, and the end, from the starts of regions and the labels' rest.

    The longest common prefix of two neighbours is DEPTH and as many 16-bit groups more as they share from the left.
    """
    n = len(further)
    lcp = np.zeros(n, np.int64)  # with the row before, beyond DEPTH; -1 where a region starts
    apart = further[1:] ^ further[:-1]
    for k in range(FURTHER):
        lcp[1:] += apart >> np.uint64(16 * (FURTHER - 1 - k)) == 0
    lcp[region[:-1]] = -1
    starts = region
    for depth in range(1, FURTHER + 1):
        crowded = np.repeat(np.diff(starts) > SMALL, np.diff(starts))
        if not crowded.any():
            break
        cut = crowded & (lcp < depth)
        cut[starts[:-1]] = True
        starts = np.append(np.flatnonzero(cut), n)
    return starts


def _drawn(t: dict[str, np.ndarray], starts: np.ndarray) -> np.ndarray:
    """For each row the smallest id that agreeing rows of its part lead to, each compared with the next SMALL in order."""
    n = len(t["id"])
    end = np.repeat(starts[1:], np.diff(starts))
    left, right = [], []
    rows = np.arange(n)
    for gap in range(1, SMALL):
        rows = rows[rows + gap < end[rows]]
        if not len(rows):
            break
        agree = rows[_agreement(t["s0"][rows], t["s1"][rows], t["s0"][rows + gap], t["s1"][rows + gap]) >= AGREEING]
        left.append(agree)
        right.append(agree + gap)
    least = t["id"].copy()
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            low = np.minimum(least[a], least[b])
            new = least.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            if np.array_equal(new, least):
                break
            least = new
    return least


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of regions with two or more classes, with the smallest class that agreeing neighbours in the sorted order lead to."""
    for t in _table(batches):
        starts = _runs(*(t[k] for k in _REGION))
        size = np.repeat(np.diff(starts), np.diff(starts))
        keep = np.flatnonzero((size > 1) | (t["part"] >= 0))
        t["least"] = _drawn(t, _parts(starts, t["ord"].view(np.uint64)))
        names = ["tree", "key", "part", "id", "s0", "s1", "least"]
        yield pa.RecordBatch.from_arrays([pa.array(t[k][keep].view(np.int64) if k in ("s0", "s1") else t[k][keep]) for k in names], names=names)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Agreeing pairs of the rows that stand for the tasks of a heavy region, at most HEAVY_SHARE of them."""
    for t in _table(batches):
        starts = _runs(t["tree"], t["key"])
        for begin, end in zip(starts[:-1], starts[1:]):
            ids, s0, s1 = (t[k][begin:end] for k in ("id", "s0", "s1"))
            for i in range(1, len(ids)):
                other = np.flatnonzero(_agreement(s0[i], s1[i], s0[:i], s1[:i]) >= AGREEING)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), ids[i])), pa.array(ids[:i][other])], names=["a", "b"])


def _joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One agreeing pair for each class of a region outside its main neighbourhood and each other neighbourhood."""
    for t in _table(batches):
        starts = _runs(*(t[k] for k in _REGION))
        for begin, end in zip(starts[:-1], starts[1:]):
            comp = t["comp"][begin:end]
            if comp.min() == comp.max():
                continue
            order = np.argsort(comp, kind="stable") + begin
            comp, ids, s0, s1 = (t[k][order] for k in ("comp", "id", "s0", "s1"))
            sizes = _runs(comp)
            main = int(np.argmax(np.diff(sizes)))
            for i in (*range(sizes[main]), *range(sizes[main + 1], len(comp))):
                other = np.flatnonzero((_agreement(s0[i], s1[i], s0, s1) >= AGREEING) & (comp != comp[i]))
                if len(other):
                    other = other[_runs(comp[other])[:-1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), ids[i])), pa.array(ids[other])], names=["a", "b"])


def _by_region(rows: DataFrame, *further: str) -> DataFrame:
    """Whole regions in order; their partitions are coalesced by size, since each is a task, and a file when written."""
    return rows.repartition(*_REGION).sortWithinPartitions(*_REGION, *further)


def _heavy_regions(whole: DataFrame, n_rows: int) -> DataFrame | None:
    """(tree, key, parts) of regions with more rows than one task should hold, copies included; None without any.

    Rows are counted by buckets of keys first, so few of them that little is shuffled; only keys of full buckets are counted themselves.
    """
    most = max(LEAST_HEAVY, n_rows // HEAVY_SHARE)
    keys = whole.select(F.posexplode("keys").alias("tree", "key")).withColumn("bucket", F.expr(f"pmod(key, {max(16, 4 * n_rows // most)})"))
    full = written(keys.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most).drop("size"))
    if full.isEmpty():
        return None
    sizes = keys.join(F.broadcast(full), ["tree", "bucket"], "left_semi").groupBy("tree", "key").agg(F.count(F.lit(1)).alias("size"))
    heavy = written(sizes.where(F.col("size") > most).selectExpr("tree", "key", f"ceil(size / {most}) AS parts"))  # at most TREES * HEAVY_SHARE
    return None if heavy.isEmpty() else heavy


def _dealt(live: DataFrame, comps: DataFrame, n_rows: int) -> DataFrame:
    """The rows with their component and the part of their region: 0 but in heavy regions."""
    rows = live.join(comps.selectExpr("id", "component_id AS comp"), "id", "left").withColumn("comp", F.expr("coalesce(comp, id)"))
    most = max(LEAST_HEAVY, n_rows // HEAVY_SHARE)
    region = ["tree", "key"]
    heavy = live.groupBy(region).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most)  # at most TREES * HEAVY_SHARE
    sizes = rows.join(F.broadcast(heavy), region).groupBy(*region, "size", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy(*region).agg(F.max_by("comp", F.struct("n", "comp")).alias("main"),
                                      F.expr(f"max(CAST(ceil(size / {most}) AS INT))").alias("parts"))
    rows = rows.join(F.broadcast(main), region, "left")
    parts = ("CASE WHEN parts IS NULL THEN array(0) WHEN comp = main THEN array(CAST(pmod(xxhash64(id), parts) AS INT)) "
             "ELSE sequence(0, parts - 1) END")
    return rows.selectExpr("tree", "key", f"explode({parts}) AS part", "id", "comp", "s0", "s1")


def _sets(docs: DataFrame, ids: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """(id, n, s0, s1, hashes) of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, offset = _multipliers()
        known = WordHashes()
        for batch in slices(batches, 1):
            found = [shingle_hashes(value, width, known) for value in batch.column(1).to_pylist()]
            sketch = np.array([_labels(signature(h, odd, offset))[2] for h in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(h) for h in found], pa.int64()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]),
                 pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["id", "n", "s0", "s1", "hashes"])

    wanted = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi")
    return wanted.mapInArrow(run, "id long, n long, s0 long, s1 long, hashes array<long>")


class _Group:
    """The sets of the rows of one part of a neighbourhood."""

    def __init__(self, table: pa.Table):
        lists = table["hashes"].combine_chunks()
        self.values = lists.values.to_numpy().view(np.uint64)
        self.offsets = lists.offsets.to_numpy()
        self.ids, self.n = table["id"].to_numpy(), table["n"].to_numpy()
        self.s0, self.s1 = (table[k].to_numpy().view(np.uint64) for k in ("s0", "s1"))
        self.alone = np.zeros(len(self.n), np.int64)  # shingles that no other row here has
        if len(self.n) >= LEAST_COUNTED:
            order = np.argsort(self.values, kind="stable")
            starts = _runs(self.values[order])
            row = np.repeat(np.arange(len(self.n)), np.diff(self.offsets))
            once = starts[:-1][np.diff(starts) == 1]
            self.alone = np.bincount(row[order[once]], minlength=len(self.n))

    def linked(self, i: int, among: np.ndarray, least: int) -> np.ndarray:
        """The rows of ``among`` that are linked with row i."""
        n = self.n[i]
        # Linked sets differ in at most (100 - least) / (100 + least) of the sum of their sizes.
        near = among[((100 + least) * (self.alone[i] + self.alone[among]) <= (100 - least) * (n + self.n[among]))
                     & (_agreement(self.s0[i], self.s1[i], self.s0[among], self.s1[among]) >= AGREEING)
                     & (100 * np.minimum(n, self.n[among]) >= least * np.maximum(n, self.n[among]))]
        if not len(near):
            return near
        own = self.values[self.offsets[i]:self.offsets[i + 1]]
        sizes = self.n[near]
        ends = np.cumsum(sizes)
        values = np.concatenate([self.values[self.offsets[j]:self.offsets[j + 1]] for j in near])
        hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        shared = np.add.reduceat(hit, ends - sizes, dtype=np.int64)
        return near[100 * shared >= least * (n + sizes - shared)]


def _pairs(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _reached(least: int):
    """Pairs of the first row and each other of those that links connect: breadth first, against the rows not reached yet."""

    def run(table: pa.Table) -> pa.Table:
        group = _Group(table)
        rest = np.argsort(group.ids, kind="stable")
        a, b = [], []
        while len(rest):
            queue, first, rest = [rest[0]], int(group.ids[rest[0]]), rest[1:]
            while queue and len(rest):
                i = queue.pop()
                found = group.linked(i, rest, least)
                if len(found):
                    a += [first] * len(found)
                    b += group.ids[found].tolist()
                    rest = rest[~np.isin(rest, found)]
                    queue += found.tolist()
        return _pairs(a, b)

    return run


def _sought(least: int):
    """A link of each row of the left block with each other component in the right block."""

    def run(table: pa.Table) -> pa.Table:
        group, comp = _Group(table), table["comp"].to_numpy()
        left, right = (np.flatnonzero(table[k].to_numpy(zero_copy_only=False)) for k in ("in_left", "in_right"))
        a, b = [], []
        for i in left:
            found = group.linked(i, right[comp[right] != comp[i]], least)
            for j in found[np.unique(comp[found], return_index=True)[1]]:
                a.append(int(group.ids[i]))
                b.append(int(group.ids[j]))
        return _pairs(a, b)

    return run


def _spent(rows: DataFrame, least: int) -> DataFrame:
    """Add ``spent`` to rows (area, id, n, hashes, seeks); counted if the seeking rows of an area are more than a block.

    Of two spent rows of an area none is linked with the other. Rows that cannot be linked with any row are dropped.
    """
    many = rows.where("seeks").groupBy("area").agg(F.sum("n").alias("n")).where(F.col("n") > PART).select("area")
    many = written(many)
    if many.isEmpty():
        return rows.withColumn("spent", F.lit(False))
    many = sized(many)
    rows = rows.withColumn("row", F.expr("xxhash64(hashes)"))  # rows that share an id are told apart
    held = rows.join(many, "area", "left_semi").select("area", "id", "row", F.explode("hashes").alias("h"))
    once = held.groupBy("area", "h").agg(F.count(F.lit(1)).alias("k"), F.first(F.struct("id", "row")).alias("r")).where("k = 1")
    alone = written(once.groupBy("area", "r.id", "r.row").agg(F.count(F.lit(1)).alias("alone")))
    rows = rows.join(alone, ["area", "id", "row"], "left").withColumn("alone", F.expr("coalesce(alone, 0)"))
    rows = rows.where(f"100 * alone <= {100 - least} * n").withColumn("spent", F.expr(f"{100 + least} * alone > {100 - least} * n"))
    return rows.drop("row", "alone")


def _blocks(rows: DataFrame, least: int) -> DataFrame:
    """The rows by pairs of blocks (l, r) in which they may be linked; a pair holds two blocks, its left one of seeking rows."""
    rows = _spent(rows.drop("part", "parts"), least).withColumn("size", F.expr("CAST(floor(ln(n) / ln(1.25D)) AS INT)"))  # links reach one size on
    kind = ["area", "size", "spent", "seeks"]
    kinds = written(rows.groupBy(kind).agg(F.expr(f"CAST(ceil(sum(n) / {PART}) AS INT)").alias("parts")))
    block = F.expr("concat_ws(':', area, size, spent, seeks, block)")
    rows = rows.join(sized(kinds), kind).withColumn("block", F.expr("CAST(pmod(xxhash64(id, 1), parts) AS INT)"))
    rows = rows.withColumn("name", block)
    blocks = kinds.withColumn("block", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("name", block)
    pairs = blocks.alias("a").join(blocks.alias("b"), F.expr(
        "a.area = b.area AND abs(a.size - b.size) <= 1 AND NOT (a.spent AND b.spent) AND a.seeks AND (NOT b.seeks OR a.name <= b.name)"))
    pairs = pairs.selectExpr("a.name AS l", "b.name AS r")
    ends = "explode(CASE WHEN l = r THEN array(struct(l AS name, true AS in_left, true AS in_right)) " \
        "ELSE array(struct(l AS name, true AS in_left, false AS in_right), struct(r AS name, false AS in_left, true AS in_right)) END) AS e"
    ends = sized(written(pairs.selectExpr("l", "r", ends).select("l", "r", "e.*")))
    return rows.join(ends, "name").select("l", "r", "id", "n", "s0", "s1", "hashes", "comp", "in_left", "in_right")


def _links(sets: DataFrame, areas: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) that connect what links connect, from the sets and their neighbourhoods (id, component_id)."""
    rows = sets.join(areas.selectExpr("id", "component_id AS area"), "id")
    sizes = written(rows.groupBy("area").agg(F.expr(f"CAST(ceil(sum(n) / {PART}) AS INT)").alias("parts")))
    dealt = rows.join(sized(sizes), "area").withColumn("part", F.expr("pmod(xxhash64(id), parts)"))
    links = written(dealt.groupBy("area", "part").applyInArrow(_reached(least), "a long, b long"))
    large = sized(written(sizes.where("parts > 1").select("area")))
    dealt = dealt.join(large, "area", "left_semi")
    if dealt.isEmpty():
        return links

    def with_comp() -> DataFrame:
        comps = written(components(links)).selectExpr("id", "component_id AS comp")
        return dealt.join(comps, "id", "left").withColumn("comp", F.expr("coalesce(comp, id)"))

    mains = with_comp().groupBy("area", "part", "comp").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id"))
    mains = mains.groupBy("area", "part").agg(F.max_by("id", F.struct("k", "id")).alias("id")).select("id")
    links = written(links.unionByName(dealt.join(mains, "id", "left_semi").groupBy("area").applyInArrow(_reached(least), "a long, b long")))
    rows = with_comp()
    main = rows.groupBy("area", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("area").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
    rows = rows.join(sized(written(main)), "area").withColumn("seeks", F.expr("comp <> main"))
    return links.unionByName(_blocks(rows, least).groupBy("l", "r").applyInArrow(_sought(least), "a long, b long"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5,
                    least: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; ``least`` is the similarity in per cent."""
    if not 0 < width:
        raise ValueError("a shingle has one word or more")
    if least < 80:
        raise ValueError("the trees and sketches are laid out for a similarity of 0.8 or more")
    signed = written(_signatures(docs, text, doc_id, width))
    whole = signed.where("n > 0 AND id IS NOT NULL")
    # Equal sets fold into one class, before the shuffle where they meet in a task.
    classes = whole.groupBy("digest").agg(F.min("id").alias("id"), F.first(F.struct("keys", "orders", "s0", "s1")).alias("f"))
    labels = classes.select("id", F.expr("f.s0 AS s0"), F.expr("f.s1 AS s1"), F.posexplode(F.expr("arrays_zip(f.keys, f.orders)")).alias("tree", "l"))
    rows = labels.selectExpr("tree", "l.keys AS key", "id", "l.orders AS ord", "s0", "s1")
    n_rows = signed.count()
    heavy = _heavy_regions(whole, n_rows)
    if heavy is None:
        rows = rows.withColumn("part", F.lit(-1))
    else:
        rows = rows.join(F.broadcast(heavy), ["tree", "key"], "left").withColumn(
            "part", F.expr("CASE WHEN parts IS NULL THEN -1 ELSE CAST(pmod(xxhash64(id), parts) AS INT) END")).drop("parts")
    live = written(_by_region(rows, "ord", "id").select("tree", "key", "part", "id", "ord", "s0", "s1").mapInArrow(
        _neighbours, "tree int, key long, part int, id long, s0 long, s1 long, least long"))
    links = live.where("least < id").selectExpr("id AS a", "least AS b")
    if heavy is not None:
        region = ["tree", "key", "part"]
        mains = live.where("part >= 0").groupBy(*region, "least").agg(F.count(F.lit(1)).alias("k"), F.min_by(F.struct("id", "s0", "s1"), "id").alias("r"))
        mains = mains.groupBy(*region).agg(F.max_by("r", F.struct("k", "least")).alias("r")).select(*region, "r.*")
        met = mains.withColumn("part", F.lit(0)).repartition("tree", "key").sortWithinPartitions("tree", "key").mapInArrow(_met, "a long, b long")
        links = links.unionByName(met)
    live = live.drop("part")
    areas = written(components(links))
    more = _by_region(_dealt(live, areas, n_rows)).mapInArrow(_joins, "a long, b long").distinct()
    areas = written(components(areas.selectExpr("id AS a", "component_id AS b").unionByName(more)))
    sets = written(_sets(docs, sized(areas.select("id")), text, doc_id, width))
    known = components(_links(sets, areas, least))

    groups = whole.groupBy("digest").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("size"))
    groups = groups.join(known.selectExpr("id AS class", "component_id"), "class", "left")
    groups = groups.selectExpr("digest", "size", "coalesce(component_id, class) AS component_id")
    placed = join_groups(whole.select("id", "n", "digest"), groups, "digest", "size", n_rows).select("id", "n", "component_id")
    empty = signed.where("n = 0 OR id IS NULL").selectExpr("id", "n", "id AS component_id")
    return placed.unionByName(empty).selectExpr(
        "id AS doc_id", "n AS n_shingles", "component_id", "coalesce(id = component_id, true) AS kept")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, least: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that have a near-duplicate of smaller doc_id in their component."""
    gone = written(near_duplicates(docs, text, doc_id, width, least).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct())
    gone = sized(gone)
    rows = docs.select(F.struct("*").alias("_doc"), F.col(doc_id).alias("_id"))
    return rows.join(gone, F.expr("_id = _gone"), "left_anti").select("_doc.*")


by_value(__name__)
