"""Quality scores by positive-unlabelled learning: the non-negative unbiased risk.

What is known are texts of good quality (``labels`` with quality 1, held-out ids aside); every document,
whatever its label, is an unlabelled text. Sixteen measures of a text (its length, symbols, capitals,
repeats, lines and so on) are cut into bins at quantiles of all documents, and a linear model over the
bins minimises

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),      l(g) = 1 / (1 + exp(g)),

by full gradients: a round is one pass over the table of measures, each task adds up its rows' part of
the gradient, and the driver gets one row for a bin. Where the second term turns negative the round
takes a step that raises it. The prior is estimated first: a model of trusted against unlabelled texts
is fitted on one half of all rows, by a hash of the id, and the prior is the least ratio of the shares of
both that score above a bound in the other half, each share with its sampling error.

Null and empty texts have no measures; they are a bin of their own. Rows of ``labels`` with a null id or
label don't count, and an id with several labels has the largest. Repeated rows of documents count
each. Where no trusted text is known every score is 0.5. Other columns of either table don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm import kernel
from folioweave.llm.common import scratch_table
from folioweave.llm.toxicity import held_out, sigmoid

MEASURES = 16
#: Where the values of a measure are cut: finer at the ends, where junk lies.
QUANTILES = (0.001, 0.003, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.96, 0.98, 0.99, 0.997, 0.999)
#: Bins of a measure; the first is that of texts without words. The last slot of the model is the intercept.
BINS = len(QUANTILES) + 2
SLOTS = MEASURES * BINS + 1
THRESHOLD = 0.5
#: Weight of the penalty on squares, for one trusted text: while the prior is estimated, and after it.
PRIOR_L2, L2 = 1.0, 0.03
STEP = 0.4
PRIOR_ROUNDS, ROUNDS = 15, 30
HISTOGRAM = 1000


def _share(row: np.ndarray, rows: int, of: np.ndarray) -> np.ndarray:
    return np.bincount(row, minlength=rows) / np.maximum(of, 1)


def _repeats(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the share of its keys that it has seen before, and the share of its most frequent key."""
    total = np.bincount(row, minlength=rows)
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row[at], np.diff(np.append(at, len(keys))))
    return 1 - _share(row[at], rows, total), most / np.maximum(total, 1)


def measures(column: pa.Array) -> np.ndarray:
    """One row of ``MEASURES`` numbers for each text; NaN for a text without words."""
    upper, lower, digit = (np.zeros(256, bool) for _ in range(3))
    upper[65:91], lower[97:123], digit[48:58] = True, True, True
    blank = ~kernel.NOT_SPACE
    symbol = ~(upper | lower | digit | blank)
    symbol[128:] = False
    stop, comma = np.zeros(256, bool), np.zeros(256, bool)
    stop[[33, 46, 63]], comma[[44, 58, 59]] = True, True
    out = np.full((len(column), MEASURES), np.nan, np.float32)
    for lo, hi, data, offsets in kernel.slices(column):
        rows, size = hi - lo, np.diff(offsets)
        starts, ends, row = kernel.words(data, offsets)
        if not len(starts):
            continue
        count = np.bincount(row, minlength=rows)
        # sums of flags over any span, from one running sum each
        sums = lambda flag: np.append(0, np.cumsum(flag[data]))
        whole = lambda s: s[offsets[1:]] - s[offsets[:-1]]
        ups, lows, digits, symbols = (sums(x) for x in (upper, lower, digit, symbol))
        wide = size - whole(sums(np.arange(256) < 128))
        letters = whole(ups) + whole(lows)
        named = (ends - starts) - (symbols[ends] - symbols[starts])  # bytes of a word that are no symbols
        last = data[ends - 1]
        same = np.zeros(len(data), bool)
        same[1:] = (data[1:] == data[:-1]) & kernel.NOT_SPACE[data[1:]]
        same[offsets[:-1][offsets[:-1] < len(data)]] = False
        twice = np.append(0, np.cumsum(same))
        hashes, _ = kernel.word_hashes(data, offsets)
        again, most = _repeats(hashes, row, rows)
        grams, of = kernel.shingle_hashes(hashes, row, 3)
        looped, _ = _repeats(grams, of, rows)
        line = np.ones(256, bool)
        line[10] = False
        a, b, lined = kernel.words(data, offsets, line)
        prefix, inverse = kernel.prefix_hashes(data)
        copied, _ = _repeats(kernel.span_hashes(prefix, inverse, a, b), lined, rows)
        lines = np.maximum(np.bincount(lined, minlength=rows), 1)
        longest = np.zeros(rows, np.int64)
        np.maximum.at(longest, row, ends - starts)
        found = np.stack([
            np.log2(1 + size), np.log2(1 + count), (np.bincount(row, ends - starts, rows)) / np.maximum(count, 1), np.log2(1 + longest),
            whole(ups) / np.maximum(letters, 1), whole(digits) / np.maximum(size, 1), whole(symbols) / np.maximum(size, 1), wide / np.maximum(size, 1),
            whole(twice) / np.maximum(size, 1), again, most, looped, copied, np.log2(1 + count / lines),
            _share(row[named == 0], rows, count), _share(row[symbol[last] & ~stop[last] & ~comma[last]], rows, count),
        ], 1)
        found[count == 0] = np.nan
        out[lo:hi] = found
    return out


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, measures (array of floats) and trusted (whether the text is known to be good) of every row of
    ``docs`` (doc_id, text); ``labels`` has doc_id and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.array(measures(batch.column(1)).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, MEASURES, dtype=np.int32)), flat)], names=["doc_id", "measures"])

    own = docs.select("doc_id", "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    good = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg((F.max("label") > 0).alias("trusted"))
    return own.mapInArrow(run, f"doc_id {kind}, measures array<float>").join(good, "doc_id", "left").select("doc_id", "measures", F.coalesce("trusted", F.lit(False)).alias("trusted"))


def cuts(table: DataFrame) -> np.ndarray:
    """Where each measure is cut, from all rows: ``MEASURES`` rows of bounds."""
    at = lambda i: F.get("measures", F.lit(i))
    found = table.agg(*[F.percentile_approx(F.when(~F.isnan(at(i)), at(i)), F.lit(list(QUANTILES)), F.lit(10_000)).alias(f"m{i}") for i in range(MEASURES)]).first()
    return np.array([x if x is not None else [0.0] * len(QUANTILES) for x in found], np.float32)


def slots(column: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The model's slot of every measure of every row."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, MEASURES)
    out = np.empty(values.shape, np.int64)
    for i in range(MEASURES):
        out[:, i] = i * BINS + np.where(np.isnan(values[:, i]), 0, 1 + np.searchsorted(bounds[i], values[:, i], side="left"))
    return out


def _sums(table: DataFrame, bounds: np.ndarray, weights: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all rows and over the trusted ones: (slope of l(-g) by slot for each, rows by slot, and
    [l(-g), rows] of each), with the risk's bounded loss or the logistic one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, rows, loss = np.zeros((2, SLOTS)), np.zeros((2, SLOTS)), np.zeros((2, 2))
        for batch in batches:
            at = slots(batch.column(0), bounds)
            trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            g = weights[at].sum(1) + weights[-1]
            p, value = sigmoid(g), np.logaddexp(0, g)
            if bounded:
                p, value = p * (1 - p), p
            for kind, chosen in enumerate((slice(None), trusted)):
                own = at[chosen]
                slope[kind, :-1] += np.bincount(own.reshape(-1), np.repeat(p[chosen], MEASURES), SLOTS - 1)
                rows[kind, :-1] += np.bincount(own.reshape(-1), minlength=SLOTS - 1)
                slope[kind, -1] += p[chosen].sum()
                rows[kind, -1] += len(own)
                loss[kind] += value[chosen].sum(), len(own)
        yield pa.record_batch({"slot": pa.array(np.arange(SLOTS + 1), pa.int32()), **{f"{n}{k}": pa.array(np.append(x[k], loss[k, j])) for j, (n, x) in enumerate((("slope", slope), ("rows", rows))) for k in range(2)}})

    names = ["slope0", "slope1", "rows0", "rows1"]
    parts = table.select("measures", "trusted").mapInArrow(run, "slot int, " + ", ".join(f"{n} double" for n in names))
    found = parts.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toPandas().sort_values("slot")
    all_ = found[names].to_numpy().T
    return all_[:2, :-1], all_[2:, :-1], all_[0:2, -1], all_[2:, -1]


class Adam:
    """Steps of about ``STEP`` in each slot, whatever the slopes' sizes."""

    def __init__(self):
        self.m, self.v, self.t = np.zeros(SLOTS), np.zeros(SLOTS), 0

    def step(self, weights: np.ndarray, slope: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * slope
        self.v = 0.99 * self.v + 0.01 * slope**2
        size = STEP * (1 - 0.9 * min(1.0, self.t / ROUNDS))
        return weights - size * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def risk_slope(slope: np.ndarray, loss: np.ndarray, count: np.ndarray, prior: float) -> np.ndarray:
    """The slope of the non-negative risk; where the part of the negatives is below zero, that which raises it."""
    of_all, of_good = slope[0] / count[0], slope[1] / count[1]
    if loss[0] / count[0] - prior * loss[1] / count[1] < 0:
        return prior * of_good - of_all
    return of_all - 2 * prior * of_good


def estimated_prior(table: DataFrame, bounds: np.ndarray, weights: np.ndarray, confidence: float = 0.1) -> float:
    """The share of good texts among all: the least ratio of the shares of all and of trusted rows whose score
    is at least a bound, where both shares have room for their sampling error."""
    scored = _scored(table, bounds, weights).groupBy(F.least(F.floor(F.col("score") * HISTOGRAM), F.lit(HISTOGRAM - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if("trusted").alias("good"))
    n, good = np.zeros(HISTOGRAM), np.zeros(HISTOGRAM)
    for r in scored.collect():  # one row for each bin
        n[r["bin"]], good[r["bin"]] = r["n"], r["good"]
    above, above_good = np.cumsum(n[::-1]), np.cumsum(good[::-1])
    if not good.sum():
        return 1.0
    room = np.sqrt(np.log(4 / confidence) / 2 / n.sum()) + np.sqrt(np.log(4 / confidence) / 2 / good.sum())
    q, p = above / n.sum(), above_good / good.sum()
    seen = p > 0
    best = np.argmin((q[seen] + room) / p[seen])
    return float(np.clip(q[seen][best] / p[seen][best], good.sum() / n.sum(), 1.0))


def fit(table: DataFrame, bounds: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights by slot, prior) from all rows of ``measured``; weights of zero where no row is trusted."""
    weights, adam, prior = np.zeros(SLOTS), Adam(), 0.0
    half = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(2))
    for turn in range(PRIOR_ROUNDS + ROUNDS):
        if turn == PRIOR_ROUNDS:
            prior, adam = estimated_prior(table.where(half == 1), bounds, weights), Adam()
        first = turn < PRIOR_ROUNDS
        slope, rows, loss, count = _sums(table.where(half == 0) if first else table, bounds, weights, not first)
        if not count[1]:
            if first:  # none in this half
                continue
            return np.zeros(SLOTS), 0.0
        if first:  # trusted against unlabelled
            change = slope[0] / count[0] - (rows[1] - slope[1]) / count[1]
        else:
            change = risk_slope(slope, loss, count, prior)
        weights = adam.step(weights, change + (PRIOR_L2 if first else L2) / count[1] * weights)
    return weights, prior


def _scored(table: DataFrame, bounds: np.ndarray, weights: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sigmoid(weights[slots(batch.column(1), bounds)].sum(1) + weights[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score)], names=["doc_id", "trusted", "score"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(run, f"doc_id {kind}, trusted boolean, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; learns from labels not held out."""
    known = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id")))
    table = scratch_table(measured(docs, known))
    bounds = cuts(table)
    weights, _ = fit(table, bounds)
    scored = _scored(table, bounds, weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, columns as they are; rows whose id is null stay."""
    low = quality(docs, labels, threshold).where("predicted = 0").select("doc_id").distinct()
    return docs.join(low, "doc_id", "left_anti").select(*docs.columns)
