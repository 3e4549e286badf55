"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is the set of its five-word shingles (words: runs of letters and digits, A-Z in lower
case); an item of one to four words has its whole sequence as its only shingle. It is found in a
document that holds at least 0.8 of its shingles, however long the document is.

Items are partitioned by size, doubling. All shingles have one MinHash order. In a partition of items
with up to N shingles an item's sketch is its ``missed(N) + hits(N)`` least hashes; a document that
holds 0.8 of the item misses at most ``missed(N)`` of its shingles, so it has ``hits(N)`` of the sketch
at least. A document's sketch for the partition is its hashes up to the greatest in any sketch of the
partition: no other can meet one. Large items keep about a fifth of their hashes, and so does every
document where it meets them. So the partition tunes both sides and the search has no false
negatives. A candidate is verified by counting the item's shingles, as strings, in the document.

Items go to the executors in blocks of at most ``BLOCK_BYTES`` of text, one pass over the documents
for each block; a block is arrays and one run of bytes, some three times its text. A longer item is a
block by itself. Shingles become strings only for candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from folioweave.llm import kernel

WORDS = 5
CONTAINMENT = 0.8
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 20
#: Items whose strings a task keeps.
_KEPT = 256


def missed(size: int, threshold: float) -> int:
    """Shingles that a document may lack of an item of so many, and hold the threshold of it."""
    return int((1 - threshold) * size + 1e-9)


def hits(size: int) -> int:
    """Hashes of a sketch that a document must have, in a partition of items of up to so many shingles."""
    return 1 if size < 8 else 2 if size < 32 else 4


@dataclass
class Partition:
    """Sketches of the items of one width and size: hashes ascending, and the item of each."""

    width: int
    size: int
    hash: np.ndarray
    item: np.ndarray
    #: Hashes of documents that were held against the sketches.
    read: int = 0

    def __post_init__(self):
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item = self.hash[order], self.item[order].astype(np.int32)
        self.limit = self.hash[-1]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hash >> np.uint64(64 - _FILTER_BITS)] = True

    def met(self, hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """(row, item, hash) of the hashes of documents up to the limit that are in a sketch, each once."""
        self.read += len(hashes)
        maybe = self.filter[hashes >> np.uint64(64 - _FILTER_BITS)]
        hashes, of = hashes[maybe], of[maybe]
        lo, hi = (np.searchsorted(self.hash, hashes, side=side) for side in ("left", "right"))
        met = np.flatnonzero(hi > lo)
        count = (hi - lo)[met]
        at = np.repeat(lo[met] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.unique(np.stack([np.repeat(of[met], count), self.item[at], self.hash[at].view(np.int64)]), axis=1)


class Items:
    """A block of items in partitions, as tasks read them."""

    def __init__(self, rows: list[tuple[object, bytes]], threshold: float):
        self.threshold, self.ids = threshold, [r[0] for r in rows]
        self.text, self.end = b"".join(r[1] for r in rows), np.append(0, np.cumsum([len(r[1]) for r in rows]))
        data = np.frombuffer(self.text, np.uint8)
        words, row = kernel.word_hashes(data, self.end, kernel.ALNUM)
        #: Words of the item's shingles, and how many of these a document must share with its sketch.
        self.width = np.minimum(np.bincount(row, minlength=len(rows)), WORDS)
        self.hits = np.zeros(len(rows), np.int64)
        #: By width, the largest sizes first as far as the limits go.
        self.partitions: list[Partition] = []
        for width in range(1, WORDS + 1):
            hashes, of = kernel.shingle_hashes(words, row, width)
            kept = self.width[of] == width
            if not kept.any():
                continue
            pairs = np.unique(np.stack([of[kept].astype(np.uint64), hashes[kept]]), axis=1)
            of, hashes = pairs[0].astype(np.int64), pairs[1]  # by item, hashes ascending
            items, first, count = np.unique(of, return_index=True, return_counts=True)
            largest = np.array([1 << (n - 1).bit_length() for n in count.tolist()], np.int64)  # of the item's partition
            self.hits[items] = [min(hits(int(n)), m - missed(m, threshold)) for n, m in zip(largest.tolist(), count.tolist(), strict=True)]
            size = np.minimum(count, np.array([missed(n, threshold) + hits(n) for n in largest.tolist()], np.int64))
            for n in np.unique(largest).tolist():
                own = np.flatnonzero(largest == n)
                at = np.repeat(first[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(int(size[own].sum()))
                self.partitions.append(Partition(width, n, hashes[at], of[at]))
        self.partitions.sort(key=lambda x: (x.width, -int(x.limit)))

    def candidates(self, words: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(row, item) of every document with enough of an item's sketch, by row; ``words`` are hashes."""
        pairs, width = [], 0
        for part in self.partitions:
            if part.width != width:
                width = part.width
                hashes, of = kernel.shingle_hashes(words, row, width)
            below = hashes <= part.limit
            hashes, of = hashes[below], of[below]  # limits fall: the next partition needs no others
            pairs.append(part.met(hashes, of)[:2])
        if not pairs:
            return np.zeros((0, 2), np.int64)
        pair, count = np.unique(np.concatenate(pairs, axis=1), axis=1, return_counts=True)
        return pair[:, count >= self.hits[pair[1]]].T


class Finder:
    """Verifies candidates; keeps the strings of the document and of the items seen last."""

    def __init__(self, items: Items):
        self.items, self.own = items, {}

    def shared(self, candidates: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """row, item, shingles of the item and those that the row has, of each item that is in a row."""
        held: tuple[int, dict[int, set[bytes]]] = (-1, {})
        for r, i in candidates.tolist():
            if held[0] != r:
                held = (r, {})
            width = int(self.items.width[i])
            if width not in held[1]:
                held[1][width] = strings(data[offsets[r] : offsets[r + 1]].tobytes(), width)
            if i not in self.own:
                if len(self.own) >= _KEPT:
                    self.own.clear()
                self.own[i] = strings(self.items.text[self.items.end[i] : self.items.end[i + 1]], width)
            n, both = len(self.own[i]), len(self.own[i] & held[1][width])
            if both >= self.items.threshold * n - 1e-9:
                yield r, i, n, both


def strings(text: bytes, width: int = WORDS) -> set[bytes]:
    """The distinct shingles of a text."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = kernel.words(data, np.array([0, len(data)]), kernel.ALNUM)
    folded = kernel.FOLD[data].tobytes()
    tokens = [folded[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return {b" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}


def blocks(items: DataFrame, threshold: float) -> Iterator[Items]:
    rows: list[tuple[object, bytes]] = []
    size = 0
    for item, text in items.select("item_id", F.encode("text", "UTF-8")).where("text is not null").toLocalIterator():
        if rows and size + len(text) > BLOCK_BYTES:
            yield Items(rows, threshold)
            rows, size = [], 0
        rows.append((item, bytes(text)))
        size += len(text)
    if rows:
        yield Items(rows, threshold)


def contained(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of every document row and item it holds.

    ``docs`` has doc_id and text, ``items`` item_id and text. Null texts and texts without words hold
    nothing and, as items, are in nothing. An item of fewer than five words is in every document that
    has its words in sequence, so that such items find prose. Items with equal text are each
    reported; repeated rows of ``docs`` give repeated rows.
    """
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
    schema = f"{kinds}, n_shingles long, n_shared long, containment double"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(items, threshold):
        found = found.unionByName(_search(docs, block, schema))
    return found


def _search(docs: DataFrame, block: Items, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    spark_schema = docs.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, finder = shared.value, Finder(shared.value)
        for batch in batches:
            rows, ids = [], batch.column(0)
            for lo, _, data, offsets in kernel.slices(batch.column(1)):
                pairs = own.candidates(*kernel.word_hashes(data, offsets, kernel.ALNUM))
                rows += [(ids[lo + r].as_py(), own.ids[i], n, both, both / n) for r, i, n, both in finder.shared(pairs, data, offsets)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * 5, arrow.types, strict=True)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, spark_schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that hold no item, columns as they are; no row moves."""
    kept = docs
    for block in blocks(items, threshold):
        kept = _without(kept, block)
    return kept


def _without(docs: DataFrame, block: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, finder = shared.value, Finder(shared.value)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for lo, _, data, offsets in kernel.slices(batch.column(at)):
                pairs = own.candidates(*kernel.word_hashes(data, offsets, kernel.ALNUM))
                for r, *_ in finder.shared(pairs, data, offsets):
                    clean[lo + r] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
