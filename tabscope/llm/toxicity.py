"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, and a linear classifier.

Voters look at a text and fire or not. Some are fixed word lists and patterns (abuse, threats, dismissal, shouting, masked
words). Others are lexicons induced from labelled rows: words and word beginnings of 4 to 6 letters that occur in toxic texts
far more often than chance allows, one voter per family of the same first four letters and a few for the rest.

The label model is generative: a hidden class draws the votes. Voters that overlap are not independent, so each voter depends
on the class and on one other voter: the tree of largest mutual information given the class (Chow and Liu's, for
each class alike). Its accuracies, correlations and class share are fitted by expectation-maximisation over the votes of **all**
documents: texts with the same votes are one row with a count, each round is one aggregation of weighted pair counts (whole
numbers, so that the order of tasks does not matter), and the driver sees (voters x voters) sums. Rows that may be learned from
keep their label in it, which ties the hidden class to toxicity; all others get their class from the votes.

The classifier is a logistic regression with an L1 penalty on the posterior classes, over indicators of words, word beginnings
and votes, fitted by accelerated proximal gradient steps. It takes at most ``MAX_ROWS`` documents and ``MAX_SLOTS``
indicators (those of the lowest hashed doc_id), a documented bound, in one task that receives numbers, no texts. The penalty
leaves weight to few indicators, so that a very long clean text gathers no score from chance.

Defined cases: null and empty texts fire no voter and score like a text without known words. Labels other than 0 and 1 and null
labels are left out; of several labels of a document the largest counts. Without labels only the fixed voters vote, their
class anchored by a prior share. Repeated rows count each. Very long texts are read whole. An empty table gives an empty
result; a column of ``docs`` with the name of the score must not be there (an error says so), others stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import Remembered, by_value, slices, written

#: Labelled rows that lexicons are induced from, rows and indicators that the classifier is fitted on, entries of the lexicons.
MAX_LABELLED, MAX_ROWS, MAX_SLOTS, MAX_STEMS = 20_000, 8_000, 8_000_000, 2_000
THRESHOLD, PENALTY = 0.5, 3.0
SLOTS, STEMS, WORDS_KEPT = 1 << 20, (4, 5, 6), 100_000
FAMILIES, POOLS, ROUNDS, SCALE = 24, 6, 8, 1 << 16

LEXICONS = {
    "insults": "idiot idiots moron morons stupid dumb loser losers clown fool fools imbecile jerk creep pig scumbag bastard coward",
    "contempt": "pathetic worthless disgusting trash garbage scum filth vermin useless ugly revolting despicable subhuman parasite",
    "profanity": "fuck fucking shit bullshit asshole bitch damn crap dick piss whore slut cunt",
    "threats": "kill murder strangle stab shoot hang exterminate annihilate lynch",
    "german": "idiot dummkopf arschloch scheisse scheiße abschaum trottel blödmann hurensohn wichser versager drecksau",
    "french": "idiot imbécile connard connasse salope merde enculé crétin abruti débile ordure putain",
    "spanish": "idiota imbécil estúpido estúpida mierda puta cabrón gilipollas pendejo basura asqueroso escoria",
}
#: Patterns, each with words of which one must be there for it to be looked for at all (none: always looked for).
PATTERNS = {
    "address": (("you", "your"), r"\byou(?:'re| are)? (?:all )?(?:nothing but |such |just )?an? \w+|\byour kind\b"),
    "violence": (("kill", "hurt", "beat", "burn", "shoot", "hang"), r"\b(?:kill|hurt|beat|burn|shoot|hang) (?:you|yourself|him|her|them)\b"),
    "dismissal": (("shut", "hell", "lost", "drop"), r"\bshut up\b|\bgo to hell\b|\bget lost\b|\bdrop dead\b"),
    "hatred": (("hate", "despise", "loathe"), r"\b(?:hate|despise|loathe) (?:you|him|her|them|those|these)\b"),
    "masked": ((), r"[*@#$](?<=[A-Za-z].)[*@#$]+[A-Za-z]"),
    "shouting": ((), r"[A-Z]{4,}\W+[A-Z]{4,}\W+[A-Z]{4,}"),
}

_WORD = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> set[str]:
    return set(_WORD((text or "").lower()))


def stems_of(word: str) -> list[str]:
    """The word itself, marked as whole, and its beginnings."""
    return [word + "$", *(word[:n] for n in STEMS if len(word) >= n)]


class Lookup:
    """What is known of words by them and their beginnings. Most words end at the first test, of their first letters."""

    def __init__(self, values: dict):
        self._values, self._firsts = values, {stem.rstrip("$")[:STEMS[0]] for stem in values}

    def __call__(self, words: set[str]) -> set[str]:
        """The known stems of the words."""
        firsts, values, n = self._firsts, self._values, STEMS[0]
        return {s for word in words if word[:n] in firsts for s in stems_of(word) if s in values}


class Voters:
    """Bit masks of the voters that fire on a text."""

    def __init__(self, learned: list[list[str]]):
        lexicons = [[w + "$" for w in words.split()] for words in LEXICONS.values()] + learned
        self.size = len(lexicons) + len(PATTERNS) + 1
        self._bits: dict[str, int] = {}
        for bit, stems in enumerate(lexicons):
            for stem in stems:
                self._bits[stem] = self._bits.get(stem, 0) | 1 << bit
        self._stems = Lookup(self._bits)
        self._patterns = [(1 << len(lexicons) + i, gate, re.compile(pattern).search) for i, (gate, pattern) in enumerate(PATTERNS.values())]
        self._outcry = 1 << self.size - 1

    def __call__(self, text: str | None, words: set[str]) -> int:
        fired = 0
        for stem in self._stems(words):
            fired |= self._bits[stem]
        if text:
            for bit, gate, search in self._patterns:
                if (not words.isdisjoint(gate) and search(text.lower())) if gate else search(text):
                    fired |= bit
            if "!!!" in text:
                fired |= self._outcry
        return fired


def slot_of(stem: str) -> int:
    """The first 64 numbers are votes."""
    return 64 + xxhash.xxh64_intdigest(stem) % (SLOTS - 64)


def slots_of(words: set[str], fired: int, known: Remembered) -> np.ndarray:
    """Numbers of the indicators of a text: votes, then hashed words and beginnings."""
    found = [b for b in range(fired.bit_length()) if fired >> b & 1]
    for word in words:
        if (slots := known.get(word)) is None:
            slots = [slot_of(s) for s in stems_of(word)]
            known.put(word, slots)
        found += slots
    return np.unique(np.array(found, np.int64))


def _bits(masks: np.ndarray, size: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(size) & 1).astype("f8")


class LabelModel:
    """Class share, and for each voter the probability to fire given class and parent's vote."""

    def __init__(self, share: float, parent: np.ndarray, fires: np.ndarray):
        self.share, self.parent, self.fires = share, parent, fires  # fires [class, parent's vote, voter]

    @classmethod
    def first(cls, size: int, share: float) -> LabelModel:
        """A start without labels: every voter is right nine times out of ten."""
        fires = np.stack([np.full((2, size), share * 0.02), np.full((2, size), 0.2)])
        return cls(share, np.full(size, -1), fires)

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        """P(toxic) for every mask."""
        size = len(self.parent)
        votes = _bits(masks, size)
        above = np.where(self.parent >= 0, votes[:, self.parent], 0).astype(int)
        logs = []
        for y in (0, 1):
            p = self.fires[y][above, np.arange(size)]
            logs.append(np.log(np.where(votes > 0, p, 1 - p)).sum(axis=1))
        odds = logs[1] - logs[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    @classmethod
    def fitted(cls, pairs: np.ndarray, totals: np.ndarray) -> LabelModel:
        """From pair counts [class, voter, voter] (the diagonal counts single votes) and class totals."""
        size, n = pairs.shape[1], totals.sum()
        single = np.einsum("yjj->yj", pairs)
        gain = np.zeros((size, size))
        for y in (0, 1):
            both, t = pairs[y], totals[y] + 4
            for a in (0, 1):
                for b in (0, 1):
                    left = single[y][:, None] if a else totals[y] - single[y][:, None]
                    right = single[y][None, :] if b else totals[y] - single[y][None, :]
                    joint = both if a and b else left - both if a else right - both if b else totals[y] - single[y][:, None] - single[y][None, :] + both
                    p = (joint + 1) / t
                    gain += t / (n + 8) * p * np.log(p / ((left + 2) / t * (right + 2) / t))
        parent, reached = np.full(size, -1), np.zeros(size, bool)
        best, by = np.full(size, -np.inf), np.full(size, -1)
        for _ in range(size):  # the tree of largest gain, from any root
            at = int(np.where(reached, -np.inf, np.where(np.isinf(best), -1e300, best)).argmax())
            reached[at], parent[at] = True, by[at]
            better = ~reached & (gain[at] > best)
            best[better], by[better] = gain[at][better], at
        share = float((totals[1] + 1) / (n + 2))
        fires = np.empty((2, 2, size))
        for y in (0, 1):
            alone = (single[y] + 0.1) / (totals[y] + 10)  # a voter that rarely fires does so alike, whatever the class is
            for a in (0, 1):
                above = np.where(parent >= 0, single[y][parent] if a else totals[y] - single[y][parent], totals[y])
                joint = np.where(parent >= 0, pairs[y][parent, np.arange(size)] if a else single[y] - pairs[y][parent, np.arange(size)], single[y])
                fires[y, a] = (joint + 2 * alone) / (above + 2)
        return cls(share, parent, np.clip(fires, 1e-6, 1 - 1e-6))


def _labelled(labels: DataFrame, label: str, doc_id: str) -> DataFrame:
    return labels.where(f"`{label}` IN (0, 1) AND `{doc_id}` IS NOT NULL").groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))


def induced(docs: DataFrame, known: DataFrame, max_rows: int = MAX_LABELLED, most: int = MAX_STEMS) -> list[list[str]]:
    """Lexicons of words and beginnings that labelled rows show to be toxic; ``docs`` has (_id, text), ``known`` (_id, _y)."""
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(counts: dict[str, list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts)), *(pa.array([c[y] for c in counts.values()], pa.int64()) for y in (1, 0))], ["stem", "toxic", "clean"])

        counts: dict[str, list[int]] = {}
        for batch in slices(batches, 1):
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for stem in {s for word in words_of(text) for s in stems_of(word)}:
                    counts.setdefault(stem, [0, 0])[y] += 1
                if len(counts) > 500_000:
                    yield told(counts)
                    counts = {}
        if counts:
            yield told(counts)

    rows = docs.join(F.broadcast(chosen), "_id").select("_y", "text")
    stems = rows.mapInArrow(run, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seen = chosen.agg(F.count("*").alias("n"), F.sum("_y").alias("toxic")).head()
    share = ((seen.toxic or 0) + 1) / (seen.n + 2)
    z = f"(toxic - (toxic + clean) * {share}D) / sqrt((toxic + clean) * {share * (1 - share)}D)"
    found = stems.where("toxic >= 3 AND 4 * toxic >= 3 * (toxic + clean)").withColumn("z", F.expr(z)).where("z > 4").orderBy(
        F.desc("z"), "stem").limit(most).select("stem").collect()
    families: dict[str, list[str]] = {}
    for row in found:  # the strongest family first
        families.setdefault(row.stem.rstrip("$")[:4], []).append(row.stem)
    lists = list(families.values())
    pools: list[list[str]] = [[] for _ in range(POOLS)]
    for stems_ in lists[FAMILIES:]:
        pools[xxhash.xxh64_intdigest(stems_[0]) % POOLS] += stems_
    return lists[:FAMILIES] + [p for p in pools if p]


def label_model(docs: DataFrame, known: DataFrame, voters: Voters, rounds: int = ROUNDS, share: float = 0.1) -> LabelModel:
    """Fit over the votes of all documents; ``docs`` has (_id, text), ``known`` (_id, _y)."""
    size = voters.size

    @F.arrow_udf("long")
    def cast(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            fired = np.empty(len(texts), np.int64)
            for i, value in enumerate(texts):
                value = value.as_py()
                fired[i] = voters(value, words_of(value))
            yield pa.array(fired)

    rows = docs.select("_id", cast("text").alias("fired"))  # labels meet votes, not texts
    votes = written(rows.join(known, "_id", "left").groupBy("fired", F.coalesce("_y", F.lit(-1)).alias("y")).agg(F.count("*").alias("n")))
    model = LabelModel.first(size, share)

    for number in range(rounds):
        anchored = number == 0  # the first round looks at labelled rows alone, if there are any

        def weigh(batches: Iterator[pa.RecordBatch], model=model, anchored=anchored) -> Iterator[pa.RecordBatch]:
            pairs, totals = np.zeros((2, size, size), np.int64), np.zeros(2, np.int64)
            for batch in batches:
                fired, y, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                if anchored:
                    fired, y, n = fired[y >= 0], y[y >= 0], n[y >= 0]
                toxic = np.where(y >= 0, y, model.posterior(fired)) if len(n) else np.zeros(0)
                bits = _bits(fired, size).astype(np.int64)
                weight = np.rint(n * toxic * SCALE).astype(np.int64)
                for k, w in enumerate((n * SCALE - weight, weight)):
                    pairs[k] += bits.T @ (bits * w[:, None])
                    totals[k] += w.sum()
            sums = np.concatenate([pairs.reshape(2 * size, size), np.repeat(totals[:, None], size, 1)])
            at = np.flatnonzero(sums.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], ["at", "sums"])

        told = votes.mapInArrow(weigh, "at int, sums array<long>").groupBy("at").agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)))
        sums = np.zeros((2 * size + 2, size))
        for row in told.collect():
            sums[row.at] = np.array(row[1:], "f8") / SCALE
        pairs, totals = sums[:-2].reshape(2, size, size), sums[-2:, 0]
        if totals.sum() == 0:
            continue  # no labelled rows, or no rows
        new = LabelModel.fitted(pairs, totals)
        still = np.array_equal(new.parent, model.parent) and np.abs(new.fires - model.fires).max() < 1e-4 and abs(new.share - model.share) < 1e-4
        model = new
        if still:
            break
    return model


def fit(slots: list[np.ndarray], target: np.ndarray, penalty: float = PENALTY, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots with weight, weights, intercept) of the L1 logistic regression on soft targets."""
    share = float(np.clip(target.mean() if len(target) else 0.1, 1e-4, 0.9999))
    base = float(np.log(share / (1 - share)))
    ends = np.cumsum([0, *(len(s) for s in slots)])
    column = np.concatenate(slots) if slots else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(slots)), np.diff(ends))
    # Screening: an indicator whose texts have the target's share, within chance, gets no weight under the penalty.
    n, hit = np.bincount(column, minlength=SLOTS), np.bincount(column, target[row], SLOTS)
    active = np.flatnonzero((n >= 2) & (np.abs(hit - n * share) >= penalty))
    place = np.full(SLOTS, -1)
    place[active] = np.arange(len(active))
    column, row = place[column][place[column] >= 0], row[place[column] >= 0]
    if not len(active):
        return active, np.zeros(0), base
    # Steps bounded by the largest curvature along each coordinate block: a power iteration on the Gram matrix.
    v = np.ones(len(active))
    for _ in range(20):
        v = np.bincount(column, np.bincount(row, v[column], len(slots))[row], len(active))
        norm = np.linalg.norm(v)
        v /= norm
    step = 4 / (norm * 1.05 + len(slots))
    w, b, ahead, b_ahead, t = np.zeros(len(active)), base, np.zeros(len(active)), base, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, ahead[column], len(slots)) + b_ahead, -500, 500)))
        gap = p - target
        new = ahead - step * np.bincount(column, gap[row], len(active))
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b_new = b_ahead - step * gap.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((ahead - new) @ (new - w) + (b_ahead - b_new) * (b_new - b)) > 0:
            t_new = 1.0  # the momentum points uphill: start it anew
        ahead, b_ahead = new + (t - 1) / t_new * (new - w), b_new + (t - 1) / t_new * (b_new - b)
        change = max(np.abs(new - w).max(), abs(b_new - b))
        w, b, t = new, b_new, t_new
        if change < 1e-4:
            break
    return active[w != 0], w[w != 0], float(b)


class Model(NamedTuple):
    """Induced lexicons, weights of votes and of stems, intercept."""

    lexicons: list[list[str]]
    votes: list[float]
    stems: dict[str, float]
    intercept: float


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id",
          max_rows: int = MAX_ROWS, max_slots: int = MAX_SLOTS) -> Model:
    """Fit all three steps; ``labels`` has ``doc_id`` and ``label``, and only rows that may be learned from."""
    given = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    known = written(_labelled(labels, label, doc_id))
    lexicons = induced(given, known)
    voters = Voters(lexicons)
    model = label_model(given, known, voters)

    def indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Remembered(WORDS_KEPT)
        for batch in slices(batches, 1):
            lists, masks = [], []
            for value in batch.column(1).to_pylist():
                words = words_of(value)
                masks.append(voters(value, words))
                lists.append(slots_of(words, masks[-1], cache))
            target = model.posterior(np.array(masks, np.int64))
            ends = pa.array(np.cumsum([0, *(len(x) for x in lists)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(target), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists), pa.int32()))], ["at", "target", "slots"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, target, total = [], [], 0
        for batch in batches:  # in order of the hash; rows beyond the bound on indicators are left out
            for values, y in zip(batch.column(2), batch.column(1).to_pylist()):
                total += len(values)
                if total <= max_slots:
                    slots.append(values.values.to_numpy().astype(np.int64))
                    target.append(y)
        at, w, b = fit(slots, np.array(target))
        yield pa.RecordBatch.from_arrays(
            [pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([b])], ["at", "w", "b"])

    # The rows of the lowest hashes of id and text.
    hashed = given.select(F.xxhash64("_id", "text").alias("at"), "text")
    edge = hashed.select("at").orderBy("at").limit(max_rows).agg(F.max("at")).head()[0]
    if edge is None:
        return Model(lexicons, [0.0] * 64, {}, 0.0)
    sample = written(hashed.where(F.col("at") <= edge).dropDuplicates(["at"]))
    rows = written(sample.mapInArrow(indicators, "at long, target double, slots array<int>"))
    learned = written(rows.coalesce(1).sortWithinPartitions("at").mapInArrow(learn, "at array<long>, w array<double>, b double")).head()
    weight = dict(zip(learned.at, learned.w))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for batch in slices(batches):
            for value in batch.column(0).to_pylist():
                found |= {s for word in words_of(value) for s in stems_of(word) if slot_of(s) in weight}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["stem"])

    stems = [r.stem for r in sample.select("text").mapInArrow(named, "stem string").distinct().collect()]  # of the sample, so bounded
    return Model(lexicons, [weight.get(v, 0.0) for v in range(64)], {s: weight[slot_of(s)] for s in sorted(stems)}, learned.b)


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 per row, in the new column ``name``."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        voters, lookup, weight = Voters(model.lexicons), Lookup(model.stems), model.stems
        for texts in batches:
            margins = np.empty(len(texts))
            for i, value in enumerate(texts):  # one text at a time becomes a Python string
                value = value.as_py()
                words = words_of(value)
                fired = voters(value, words)
                margins[i] = model.intercept + math.fsum(weight[s] for s in lookup(words)) + sum(w for v, w in enumerate(model.votes) if fired >> v & 1)
            yield pa.array(1 / (1 + np.exp(-np.clip(margins, -500, 500))))

    return docs.withColumn(name, score(F.col(text)))


by_value(__name__)
