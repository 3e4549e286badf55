"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its lower-case words (runs of letters and digits), word pairs and pairs with
one word skipped, each hashed into one of 2**20 slots with the value 1 + ln(occurrences), the whole
scaled to a fixed length; more than ``MOST_TIMES`` occurrences count as that many. Every slot has its own learning rate and an L1 penalty keeps most weights
at zero, so that the model is a list of at most ``MAX_WEIGHTS`` pairs that can be broadcast.

Null and empty texts have no features and get the model's base rate. Repeated rows are scored each.
Rows of ``labels`` with a null id or label don't count; if an id has several labels the largest
holds. With no labelled rows at all every weight is zero and each score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm import kernel
from folioweave.llm.common import free_name

SLOTS_BITS = 20
#: Labelled rows that the model is fitted on, and features of all of them, at most: the fit holds four
#: bytes for each feature. Rows come in order of a hash of the id; the first that doesn't fit ends them.
TRAIN_ROWS = 20_000
TRAIN_FEATURES = 24_000_000
MOST_TIMES = 4095
#: Pairs of slot and weight that are broadcast, at most: one for each slot and the intercept.
MAX_WEIGHTS = (1 << SLOTS_BITS) + 1
THRESHOLD = 0.7
NORM = 10.0


class Ftrl:
    """Weights of a logistic model under the FTRL-proximal update."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, positive_weight: float = 3.0):
        self.alpha, self.beta, self.l1, self.l2, self.positive_weight = alpha, beta, l1, l2, positive_weight
        self.z, self.n = np.zeros(MAX_WEIGHTS), np.zeros(MAX_WEIGHTS)
        self.penalty = np.full(MAX_WEIGHTS, l1)
        self.penalty[-1] = 0.0  # the intercept

    def weights(self, slots: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, penalty = self.z[slots], self.penalty[slots]
        free = z - np.sign(z) * penalty
        return np.where(np.abs(z) <= penalty, 0.0, -free / ((self.beta + np.sqrt(self.n[slots])) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        error = sigmoid(w @ values) - label
        gradient = error * values * (self.positive_weight if label else 1.0)
        n = self.n[slots]
        self.z[slots] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + gradient**2


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


_VALUES = np.append(0.0, 1.0 + np.log(np.arange(1, MOST_TIMES + 1)))


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: first row, end row, then row, slot and occurrences of every feature, by row."""
    shift = np.uint64(64 - SLOTS_BITS)
    for lo, hi, data, offsets in kernel.slices(column):
        words, row = kernel.word_hashes(data, offsets, kernel.ALNUM)
        grams, rows = [words], [row]
        for gap in (1, 2):
            same = row[:-gap] == row[gap:]
            grams.append(kernel.mix(words[:-gap] * np.uint64(2 * gap + 1) + words[gap:] + np.uint64(gap))[same])
            rows.append(row[:-gap][same])
        keys = (np.concatenate(rows) << SLOTS_BITS) | (np.concatenate(grams) >> shift).astype(np.int64)
        keys, count = np.unique(keys, return_counts=True)
        yield lo, hi, keys >> SLOTS_BITS, keys & ((1 << SLOTS_BITS) - 1), np.minimum(count, MOST_TIMES)


def values(row: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """The value of each feature: its row's have a fixed length."""
    value = _VALUES[count]
    length = np.sqrt(np.bincount(row, value**2, rows))
    return value * NORM / np.maximum(length, 1e-9)[row]


def fit(sample: DataFrame, epochs: int = 4) -> list[tuple[int, float]]:
    """Slots and weights other than zero, learnt in one task from rows of
    ``doc_id, order, text, label``, ``TRAIN_ROWS`` at most."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, int]] = []  # slots and occurrences in one number each
        held, open_ = 0, True
        for batch in batches:
            label = batch.column("label").to_numpy()
            for lo, hi, row, slot, count in features(batch.column("text")) if open_ else ():
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                packed = (slot.astype(np.uint32) << np.uint32(12)) | count.astype(np.uint32)
                for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    open_ = open_ and held + b - a <= TRAIN_FEATURES
                    if open_:
                        rows.append((packed[a:b].copy(), int(label[lo + i])))
                        held += b - a
        model = Ftrl()
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                packed, y = rows[i]
                value = values(np.zeros(len(packed), np.int64), packed & np.uint32(MOST_TIMES), 1)
                model.learn(np.append(packed >> np.uint32(12), MAX_WEIGHTS - 1).astype(np.int64), np.append(value, 1.0), y)
        weights = model.weights()
        slots = np.flatnonzero(weights)
        yield pa.record_batch({"slot": pa.array(slots, pa.int32()), "weight": pa.array(weights[slots], pa.float64())})

    found = sample.coalesce(1).sortWithinPartitions("order", "doc_id").select("text", "label").mapInArrow(learn, "slot int, weight double").toPandas()
    return list(zip(found["slot"].tolist(), found["weight"].tolist(), strict=True))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` documents with a label, chosen by a hash of the id, as ``doc_id, order, text, label``.

    ``docs`` has doc_id and text, ``labels`` doc_id and label. The ids are chosen from the narrow
    table of labels first, so that only chosen texts move.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
        .select("doc_id", "label", F.xxhash64(F.lit(17), "doc_id").alias("order"))
        .orderBy("order", "doc_id").limit(rows)
    )
    # a row for each id, even if documents repeat
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("order").alias("order"), F.max("text").alias("text"), F.first("label").alias("label"))


def score(docs: DataFrame, weights: list[tuple[int, float]], text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is toxic, rows and partitions as they are."""
    if len(weights) > MAX_WEIGHTS:
        raise ValueError("too many weights to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    at = [c.lower() for c in docs.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(MAX_WEIGHTS)
        for slot, weight in shared.value:
            dense[slot] = weight
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, row, slot, count in features(batch.column(at)):
                out[lo:hi] = sigmoid(np.bincount(row, dense[slot] * values(row, count, hi - lo), hi - lo) + dense[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def held_out(doc_id):
    """True for the third of ids that no model has seen."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; learns from rows not held out."""
    own = docs.select("doc_id", "text")
    known = labels.select("doc_id", F.col("toxic").alias("label")).where(~held_out(F.col("doc_id")))
    scored = score(own, fit(training_sample(own, known)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, columns as they are."""
    known = labels.select("doc_id", F.col("toxic").alias("label")).where(~held_out(F.col("doc_id")))
    weights = fit(training_sample(docs.select("doc_id", "text"), known))
    name = free_name(docs.columns, "score")
    return score(docs, weights, name=name).where(F.col(name) < threshold).drop(name)
