"""Hard negatives: exact search by bit-sliced integer products.

Components are integers in two's complement, and a product with an anchor is summed plane by plane of
the row's bits, the most significant first. After plane j a score lies in an interval: what is
unread of a component is 0 to 2^j - 1, so the score is what has been summed plus that many times the
anchor's negative to its positive components. A row whose interval can't reach the window or the
best k that are known is dropped; while many rows of a block are open a plane is one matrix product,
then single pairs are carried on. After the last plane the intervals are the scores.

Anchors are searched in blocks of ``BLOCK``, that is what a broadcast holds at most; each task keeps the
best few of each anchor while its rows go by, and the tasks' best are merged. So an anchor's positives
are found in one pass over all rows, and the negatives in their windows in a second.

Rows with a null label or an unusable vector take no part; those with a null id do, after all others in
ties, but are no anchors. Vectors that are shorter than others count as ending in zeros. Of several
rows with an anchor's id the least by label and vector is the anchor, none of them is another row to it;
other repeated rows count each. Products must stay below 2^53, larger components are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioweave.llm.common import scratch_path, scratch_table
from folioweave.llm.vectors import extent, matrix, scaled, usable

#: Anchors that are broadcast at once.
BLOCK = 4096
#: Anchors and rows of one matrix product, and the share of open pairs from which single pairs are carried on.
ANCHORS, ROWS, OPEN = 256, 4096, 0.02
LAST = (1 << 63) - 1


class Searches:
    """Best k rows for each search of some anchors, of those whose score is in the search's window.

    ``low`` and ``high`` have a row for each anchor and a column for each of its searches; an empty
    window has its bounds the wrong way round.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int):
        self.ids, self.labels, self.vectors, self.same, self.low, self.high, self.k = ids, labels, vectors.astype(float), same, low, high, k
        self.plus, self.minus = np.maximum(self.vectors, 0).sum(1), np.minimum(self.vectors, 0).sum(1)
        self.scores = np.full((*low.shape, k), -np.inf)
        self.found = np.full((*low.shape, k), LAST, np.int64)
        self.summed = 0  # pairs and planes that were summed

    def needed(self, chosen: np.ndarray) -> np.ndarray:
        """The least score that a row needs, by search: that of the window or of the k-th row known."""
        return np.maximum(self.low[chosen], self.scores[chosen, :, -1])

    def add(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, bits: int) -> None:
        at = min(len(ids), 16 * self.k)  # a few rows first: what they have closes most of the others
        for lo, hi in ((0, at), *((i, min(i + ROWS, len(ids))) for i in range(at, len(ids), ROWS))):
            for a in range(0, len(self.ids), ANCHORS):
                self._add(np.arange(a, min(a + ANCHORS, len(self.ids))), ids[lo:hi], labels[lo:hi], q[lo:hi], bits)

    def _add(self, chosen: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, bits: int) -> None:
        anchors, plus, minus = self.vectors[chosen], self.plus[chosen, None], self.minus[chosen, None]
        low, high = self.needed(chosen).min(1, keepdims=True), self.high[chosen].max(1, keepdims=True)
        open_ = (self.labels[chosen, None] == labels) if self.same else (self.labels[chosen, None] != labels)
        open_ &= self.ids[chosen, None] != ids
        total, plane = np.zeros(open_.shape), bits
        count = np.count_nonzero(open_)
        while plane and count > OPEN * open_.size:
            plane -= 1
            total += _weight(plane, bits) * (anchors @ _bits(q, plane).T)
            self.summed += open_.size
            rest = float((1 << plane) - 1)
            open_ &= (total >= low - rest * plus) & (total <= high - rest * minus)
            count = np.count_nonzero(open_)
        i, j = np.nonzero(open_)
        score = total[i, j]
        while plane and len(i):
            plane -= 1
            unread = _bits(q, plane)
            score = score + _weight(plane, bits) * np.einsum("ij,ij->i", anchors[i], unread[j])
            self.summed += len(i)
            rest = float((1 << plane) - 1)
            kept = self._within(chosen, i, score + rest * minus[i, 0], score + rest * plus[i, 0])
            i, j, score = i[kept], j[kept], score[kept]
        self._merge(chosen, i, ids[j], score)

    def _within(self, chosen: np.ndarray, i: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The pairs that one of the searches may still take."""
        needed, high, kept = self.needed(chosen), self.high[chosen], np.zeros(len(i), bool)
        for s in range(needed.shape[1]):
            need = needed[i, s]
            # k rows that are surely within the window set a bound for the others
            sure = (least >= self.low[chosen[i], s]) & (most <= high[i, s])
            if np.count_nonzero(sure) >= self.k:
                who, value = i[sure], least[sure]
                order = np.lexsort((-value, who))
                first = np.searchsorted(who[order], np.arange(len(chosen))) + self.k - 1
                end = np.searchsorted(who[order], np.arange(len(chosen)), side="right")
                bound = np.full(len(chosen), -np.inf)
                bound[first < end] = value[order][first[first < end]]
                need = np.maximum(need, bound[i])
            kept |= (most >= need) & (least <= high[i, s])
        return kept

    def _merge(self, chosen: np.ndarray, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        for s in range(self.low.shape[1]):
            taken = (score >= self.low[chosen[i], s]) & (score <= self.high[chosen[i], s])
            if not taken.any():
                continue
            touched = np.unique(i[taken])
            who = np.concatenate([np.repeat(touched, self.k), i[taken]])
            value = np.concatenate([self.scores[chosen[touched], s].reshape(-1), score[taken]])
            name = np.concatenate([self.found[chosen[touched], s].reshape(-1), ids[taken]])
            order = np.lexsort((name, -value, who))
            first = np.searchsorted(who[order], touched)
            best = order[(first[:, None] + np.arange(self.k)).reshape(-1)].reshape(len(touched), self.k)
            self.scores[chosen[touched], s], self.found[chosen[touched], s] = value[best], name[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, search, id, score) of what was found."""
        a, s, n = np.nonzero(self.scores > -np.inf)
        return a, s, self.found[a, s, n], self.scores[a, s, n].astype(np.int64)


def _bits(q: np.ndarray, plane: int) -> np.ndarray:
    return ((q >> plane) & 1).astype(float)


def _weight(plane: int, bits: int) -> float:
    """The highest plane is that of the sign."""
    return float(-(1 << plane) if plane == bits - 1 else 1 << plane)


def _search(rows: DataFrame, width: int, bits: int, anchors: tuple, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> DataFrame:
    """anchor and search (as numbers), id, score and rank of the best k of all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((*anchors, same, low, high, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = Searches(*shared.value)
        for batch in batches:
            searches.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), width), bits)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(searches.rows(), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor", "search", "id", "score"])

    found = rows.select("id", "label", "q").mapInArrow(run, "anchor int, search int, id long, score long")
    rank = F.row_number().over(W.partitionBy("anchor", "search").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _anchor_blocks(rows: DataFrame, every: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and vectors of up to ``BLOCK`` anchors at a time."""
    own = rows.where((F.col("id") % every == 0) & (F.col("id") != LAST))
    one = own.groupBy("id").agg(F.min(F.struct("label", "q")).alias("v")).select("id", "v.label", "v.q")
    held: list = []
    for r in one.toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            yield _arrays(held, width)
            held = []
    if held:
        yield _arrays(held, width)


def _arrays(held: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.zeros((len(held), width), np.int64)
    for i, r in enumerate(held):
        vectors[i, : len(r["q"])] = r["q"]
    return np.array([r["id"] for r in held], np.int64), np.array([r["label"] for r in held], np.int64), vectors


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor and positive.

    ``rows``: id, label, q (array of longs). Anchors are the rows whose id is divisible by ``every``, its
    positives the best other rows of its label, and negatives the best rows of other labels with a score of
    ``least`` to ``most`` hundredths of the positive's.
    """
    spark = rows.sparkSession
    rows = scratch_table(rows.withColumn("id", F.coalesce("id", F.lit(LAST))))
    _, width, largest = extent(rows, 1 << 40)
    if width * (largest + 1) ** 2 >= 1 << 52:
        raise ValueError("products are beyond 2^52, to which they are exact")
    bits = int(largest).bit_length() + 1
    path = scratch_path(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for ids, labels, vectors in _anchor_blocks(rows, every, width):
        no_bound = np.full((len(ids), 1), np.inf)
        near = _search(rows, width, bits, (ids, labels, vectors), True, -no_bound, no_bound, positives).toPandas()  # a few rows for each anchor of the block
        low, high = np.full((len(ids), positives), np.inf), np.full((len(ids), positives), -np.inf)
        score = near["score"].to_numpy().astype(np.int64)
        low[near["anchor"], near["rank"] - 1], high[near["anchor"], near["rank"] - 1] = -(-least * score // 100), most * score // 100
        far = _search(rows, width, bits, (ids, labels, vectors), False, low, high, negatives)
        known = spark.createDataFrame([(int(ids[a]), int(a), int(s) - 1, int(i), int(v)) for a, s, i, v in near[["anchor", "rank", "id", "score"]].itertuples(index=False)], "anchor_id long, anchor int, search int, positive_id long, positive_score long")
        own = far.join(F.broadcast(known), ["anchor", "search"])  # a row for each search of the block
        null = lambda name: F.when(F.col(name) != LAST, F.col(name)).alias(name)
        own = own.select("anchor_id", null("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        own.withColumn("negative_id", null("negative_id")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def of_embeddings(embeddings: DataFrame) -> DataFrame:
    """Rows for ``hard_negatives`` of a table of vec_id, embedding and label: components are floor(256 x), and labels
    of ids divisible by 7 move on by one modulo 10."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    kept = embeddings.where(F.col("label").isNotNull() & usable(F.col("embedding")))
    return kept.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), scaled(F.col("embedding"), 256).alias("q"))
