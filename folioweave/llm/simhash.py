"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. Bit i belongs to a vector m(i) of four bits; for each of the 15 vectors
v other than zero a table keeps the bits with an odd number of ones in ``m(i) & v``. Whatever three
bits differ, some v is orthogonal to their three vectors, and in that table all of them are masked
out: every pair within the radius collides somewhere, with certainty.

Only distinct fingerprints are compared. A bucket with more than ``BUCKET`` of them is dealt again by
a second covering of the bits that its table masks out; about 16 free bits are left after that,
which bounds a bucket whatever the data. Inside a bucket only a spanning forest of the links is
kept, and components are found by alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm import kernel
from folioweave.llm.common import cut, free_name, text_key

RADIUS = 3
TABLES = (1 << (RADIUS + 1)) - 1
BUCKET = 4096
SHINGLE = 3


def masks(bits: list[int]) -> list[int]:
    """For each table the mask of the bits that it keeps, for a covering of the given bit positions."""
    vectors = {bit: 1 + at % TABLES for at, bit in enumerate(bits)}
    return [sum(1 << bit for bit, m in vectors.items() if (m & v).bit_count() & 1) for v in range(1, TABLES + 1)]


OUTER = masks(list(range(64)))
INNER = [masks([b for b in range(64) if not kept >> b & 1]) for kept in OUTER]


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, text key and fp (long) of every row; no words: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = kernel.buffers(batch.column(1))
            out = np.fromiter((fingerprint(data[a:b].tobytes(), words) for a, b in zip(ends[:-1], ends[1:], strict=True)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out.view(np.int64))], names=["doc_id", "key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_key(F.col("text")).alias("key")).mapInArrow(run, f"doc_id {kind}, key binary, fp long")


_LOWER = bytes(kernel.FOLD)


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(x) + 1 for x in tokens]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):  # blocks keep a very long text's bits small
        hi = min(n, lo + (1 << 16))
        spans = zip(starts[lo:hi].tolist(), ends[lo + words - 1 : hi + words - 1].tolist() if len(tokens) >= words else [len(joined)], strict=True)
        h = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def links(distinct: DataFrame) -> DataFrame:
    """src > dst: a forest of links between fingerprints at ``RADIUS`` or fewer bits, from distinct ``fp``."""
    deal = F.array(*[F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for v, m in enumerate(OUTER)])
    dealt = distinct.select("fp", F.explode(deal).alias("b")).select("b.t", "b.k", "fp")
    first = cut(_buckets(dealt, outer=True))
    again = first.where("dst is null").select(F.col("t"), F.col("src").alias("fp"))
    inner = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in INNER])
    more = (
        again.select("t", "fp", F.posexplode(F.element_at(inner, F.col("t") + 1)).alias("u", "m"))
        .select((F.col("t") * TABLES + F.col("u")).cast("int").alias("t"), F.col("fp").bitwiseAND(F.col("m")).bitwiseOR(F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(_signed(x)) for x in OUTER]), F.col("t") + 1))).alias("k"), "fp")
    )
    found = first.where("dst is not null").select("src", "dst")
    return found.unionByName(_buckets(more, outer=False).select("src", "dst")).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _buckets(dealt: DataFrame, outer: bool) -> DataFrame:
    """t, src, dst: links of each bucket (t, k); of outer buckets that are too large, the rows with a null dst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        large = None
        for batch in batches:
            t, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(t):
                continue
            # the rows before the last bucket's start are complete
            last = int(np.flatnonzero((t != t[-1]) | (k != k[-1]))[-1] + 1) if ((t != t[-1]) | (k != k[-1])).any() else 0
            if large is not None:  # a bucket that is passed on as it streams by
                on = int(((t == large[0]) & (k == large[1])).sum())
                yield _rows(t[:on], fp[:on], None)
                t, k, fp, last = t[on:], k[on:], fp[on:], max(0, last - on)
                if not len(t):
                    continue
                large = None
            if last:
                held.append((t[:last], k[:last], fp[:last]))
                yield from _linked(*map(np.concatenate, zip(*held, strict=True)), outer)
                held = []
            elif held and (held[-1][0][-1] != t[0] or held[-1][1][-1] != k[0]):
                yield from _linked(*map(np.concatenate, zip(*held, strict=True)), outer)
                held = []
            held.append((t[last:], k[last:], fp[last:]))
            if outer and sum(len(x[0]) for x in held) > BUCKET and all(x[0][0] == t[-1] and x[1][0] == k[-1] for x in held):
                large = (t[-1], k[-1])
                yield from (_rows(x[0], x[2], None) for x in held)
                held = []
        if held:
            yield from _linked(*map(np.concatenate, zip(*held, strict=True)), outer)

    return dealt.repartition("t", "k").sortWithinPartitions("t", "k", "fp").mapInArrow(run, "t int, src long, dst long")


def _rows(t: np.ndarray, src: np.ndarray, dst: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(src, pa.int64()), pa.nulls(len(src), pa.int64()) if dst is None else pa.array(dst, pa.int64())], names=["t", "src", "dst"])


def _linked(t: np.ndarray, k: np.ndarray, fp: np.ndarray, outer: bool) -> Iterator[pa.RecordBatch]:
    edge = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
    starts, ends = np.append(0, edge), np.append(edge, len(t))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    two = starts[ends - starts == 2]
    if len(two):
        near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= RADIUS
        pairs.append((fp[two + 1][near], fp[two][near]))
    for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
        if outer and b - a > BUCKET:
            yield _rows(t[a:b], fp[a:b], None)
        else:
            pairs.append(forest(fp[a:b]))
    if pairs:
        src, dst = (np.concatenate(x) for x in zip(*pairs, strict=True))
        yield _rows(np.zeros(len(src), np.int32), np.maximum(src, dst), np.minimum(src, dst))


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Breadth-first trees over a bucket's links; a fingerprint leaves the rest when it is reached."""
    rest, src, dst = fp.copy(), [], []
    front: list[int] = []
    while len(rest):
        if not front:
            front.append(int(rest[0]))
            rest = rest[1:]
            continue
        at = np.int64(front.pop())
        near = np.bitwise_count((rest ^ at).view(np.uint64)) <= RADIUS
        if near.any():
            found = rest[near]
            src.append(found)
            dst.append(np.full(len(found), at))
            front += found.tolist()
            rest = rest[~near]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(src) if src else empty), (np.concatenate(dst) if dst else empty)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of ``src, dst``.

    Large stars hang a node's larger neighbours on its least one, small stars the others; both keep
    components and the edges shrink to stars. Ends when a round changes nothing.
    """
    now, before = cut(edges.select("src", "dst").where("src <> dst").distinct()), None
    while (state := now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()) != before:
        before = state
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("least")).select("src", F.least("src", "least").alias("least"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        large = large.where("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("least"))
        small = down.join(low, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst")
        now = cut(small.unionByName(low.select("src", F.col("least").alias("dst"))).distinct(), state[0])
    return now.groupBy("src").agg(F.min("dst").alias("root")).select(F.col("src").alias("node"), "root")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, key and fp of every row; fp and root of every fingerprint, root being one of its component."""
    own = cut(fingerprints(docs))
    distinct = own.select("fp").distinct()
    rooted = components(links(distinct))
    return own, cut(distinct.join(rooted, distinct["fp"] == rooted["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``.

    Null and empty texts, and those of white space, have fingerprint zero and are linked like any
    other; repeated rows share their component. A row with a null doc_id takes part in links but
    names no component: component_id is null where no id is reachable.
    """
    own, classes = _classes(docs)
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = cut(classes.join(first, "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return own.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, columns as they are: the one with the smallest doc_id (null last);
    of several such rows with different texts the one with the smallest text key, of several with
    equal texts the one that is smallest as JSON."""
    own, classes = _classes(docs)
    rows = own.groupBy("fp", "doc_id", "key").agg(F.count("*").alias("n")).join(classes, "fp")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "n")).alias("best"))
    kept_id, kept_key, kept_n = (free_name(docs.columns, f"kept_{x}") for x in ("id", "key", "n"))
    best = best.select(F.col("best.doc_id").alias(kept_id), F.col("best.key").alias(kept_key), F.col("best.n").alias(kept_n))
    key = text_key(docs["text"])
    kept = docs.join(best, docs["doc_id"].eqNullSafe(best[kept_id]) & (key == best[kept_key]))
    whole = F.struct(*[docs[c] for c in docs.columns])
    more = kept.where(F.col(kept_n) > 1).groupBy(kept_id, kept_key).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return kept.where(F.col(kept_n) == 1).select(*docs.columns).unionByName(more)
