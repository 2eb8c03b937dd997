"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: word unigrams and bigrams, and one- to three-grams over the words' shapes (upper or
lower case, letters or digits, which marks end them, whether the word repeats the one before it). N-grams are hashed to
``SLOTS`` positions. The log-count ratio of a slot compares how often it occurs in documents of either class; indicators
are scaled by it, each document to length one, and a linear model of the hinge loss is fitted by dual coordinate descent,
with the two classes weighted alike. A logistic curve over the margins of documents held back from that fit turns margins
to scores from 0 to 1.

The fit takes at most ``max_rows`` labelled rows, a documented bound: the rows whose hashed doc_id is lowest. They are
fitted in one task, which the bound keeps small; the model (8 MB) is the only thing that the driver sees. All documents
are scored, from their whole texts.

Defined cases: null and empty texts have no n-grams and get the score of the bare intercept. Labels that are null are left
out; of several labels for a document the largest counts. Without labelled rows of both classes every score is the smoothed
share of label 1 among the labelled rows, 0.5 without any. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import by_value, written

SLOTS = 1 << 20
MAX_ROWS = 8_000
THRESHOLD = 0.3
REMEMBERED = 200_000
MARKS = """.,;:!?'\"()[]{}<>|#$%&*+-/=@\\^_`~"""

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words(dict):
    """Numbers of the words seen so far; the hashes of each word and of its shape are at that number."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros((2, 1 << 12), np.uint64)
        self.seen = np.zeros(SLOTS, np.int32)  # scratch

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        if n == self.hashes.shape[1]:
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], axis=1)
        core = word.rstrip(MARKS)
        case = "A" if core.isupper() else "a" if core.islower() else "T" if core.istitle() else "m"
        shape = case + ("w" if core.isalpha() else "0" if core.isdigit() else "x") + word[len(core):len(core) + 6]
        self.hashes[:, n] = xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest(shape)
        return n


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind)) * _M1
    h ^= h >> np.uint64(32)
    return (h * _M2) >> np.uint64(44)


def features(text: str | None, known: Words) -> np.ndarray:
    """Distinct slots of a text's n-grams."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    if len(known) >= REMEMBERED:
        known.clear()
    numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    word, shape = known.hashes[:, numbers]
    shape[1:][word[1:] == word[:-1]] = np.uint64(7)  # the shape of a repeated word
    grams = [_mixed(word, 1), _mixed(word[:-1] * _M2 + word[1:], 2), _mixed(shape, 3), _mixed(shape[:-1] * _M2 + shape[1:], 4),
             _mixed((shape[:-2] * _M2 + shape[1:-1]) * _M2 + shape[2:], 5)]
    slots = np.concatenate(grams).astype(np.int64)
    places = np.arange(len(slots), dtype=np.int32)
    known.seen[slots] = places
    return slots[known.seen[slots] == places]


def _log_ratio(slots: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.ones((2, SLOTS))
    for label in (0, 1):
        chosen = [s for s, y in zip(slots, labels) if y == label]
        if chosen:
            counts[label] += np.bincount(np.concatenate(chosen), minlength=SLOTS)
    shares = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])
    ratio[counts.sum(axis=0) < 4] = 0  # seen once: says nothing
    return ratio


def _scaled(slots: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    x = ratio[slots]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def dual_descent(slots: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 12,
                 seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and intercept of the hinge-loss model; box bounds weigh both classes alike."""
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.array([np.mean(labels == 0), np.mean(labels == 1)])
    bound = cost * 0.5 / np.maximum(share[labels], 1e-9)
    square = np.array([(v * v).sum() + 1 for v in values])
    w, b, alpha = np.zeros(SLOTS), 0.0, np.zeros(len(y))
    draw = np.random.RandomState(seed)
    for _ in range(rounds):
        for i in draw.permutation(len(y)):
            gradient = y[i] * (w[slots[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[slots[i]] += step * values[i]
                b += step
                alpha[i] = new
    return w, b


def _curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps on smoothed labels."""
    n1 = labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * margins + c)))
        g, d = p - target, p * (1 - p) + 1e-9
        h = np.array([[(d * margins * margins).sum() + 1e-6, (d * margins).sum()], [(d * margins).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * margins).sum(), g.sum()])
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(c)


def fit(texts: list[str | None], labels: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Log-count ratios and weights per slot, intercept, slope and offset of the score."""
    known = Words()
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return np.zeros((2, SLOTS), np.float32), 0.0, 1.0, float(np.log(share / (1 - share)))
    slots = [features(t, known).astype(np.int32) for t in texts]
    held = np.zeros(len(labels), bool)
    for label in (0, 1):
        held[np.flatnonzero(labels == label)[::4]] = True
    if min(np.bincount(labels[~held], minlength=2)) == 0 or min(np.bincount(labels[held], minlength=2)) < 5:
        held[:] = False

    def model(rows: np.ndarray):
        chosen = [slots[i] for i in rows]
        ratio = _log_ratio(chosen, labels[rows])
        w, b = dual_descent(chosen, [_scaled(s, ratio) for s in chosen], labels[rows])
        return ratio, w, b

    part = np.flatnonzero(~held)
    ratio, w, b = model(part)
    judged = np.flatnonzero(held) if held.any() else part
    slope, offset = _curve(np.array([w[slots[i]] @ _scaled(slots[i], ratio) + b for i in judged]), labels[judged])
    return np.stack([ratio, w]).astype(np.float32), b, slope, offset


def train(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", doc_id: str = "doc_id",
          max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float, float, float]:
    """Fit on at most ``max_rows`` of the labelled documents; ``labels`` has ``doc_id`` and ``label`` (0 or 1)."""
    known = labels.where(f"`{label}` IN (0, 1) AND `{doc_id}` IS NOT NULL").groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # ids and labels only
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(known), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.max("text").alias("text")).select("text", "_y")  # a row per id, so the bound holds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            ys += batch.column(1).to_pylist()
        order = sorted(range(len(ys)), key=lambda i: (xxhash.xxh64_intdigest(texts[i] or ""), ys[i]))  # whatever the partitions
        w, b, slope, offset = fit([texts[i] for i in order], np.array([ys[i] for i in order], int))
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(w).tobytes()], pa.binary()), *(pa.array([float(x)]) for x in (b, slope, offset))],
                                         names=["w", "b", "slope", "offset"])

    model = written(rows.coalesce(1).mapInArrow(run, "w binary, b double, slope double, offset double")).head()
    if model is None:
        return np.zeros((2, SLOTS), np.float32), 0.0, 1.0, 0.0
    return np.frombuffer(bytes(model.w), np.float32).reshape(2, SLOTS), model.b, model.slope, model.offset


def scored(docs: DataFrame, model: tuple[np.ndarray, float, float, float], text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 per row, in the column ``name``, which must not be there yet."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        (ratio, w), b, slope, offset = shared.value
        known, joined = Words(), (ratio * w).astype(np.float64)
        square = np.square(ratio, dtype=np.float64)
        for texts in batches:
            margins = np.empty(len(texts))
            for i, value in enumerate(texts):  # one text at a time becomes a Python string
                slots = features(value.as_py(), known)
                norm = np.sqrt(square[slots].sum())
                margins[i] = joined[slots].sum() / norm + b if norm else b
            yield pa.array(1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500))))

    return docs.withColumn(name, score(F.col(text)))


def keep_good(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", doc_id: str = "doc_id",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to have label 1."""
    rows = docs.select(F.struct("*").alias("_doc"), F.col(text).alias("_text"))
    return scored(rows, train(docs, labels, label, text, doc_id), "_text", "_score").where(F.col("_score") >= threshold).select("_doc.*")


by_value(__name__)
