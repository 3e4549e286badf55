"""Removal of byte strings that occur more than once, by a hash-compared suffix sort.

A string of ``LENGTH`` bytes repeats if it starts at two places of the corpus. Each such window is
owned by an anchor, the leftmost of its least-hashed ``GRAM``-byte grams, at a place inside the
window that its bytes alone decide: equal windows have equal anchors at equal offsets. So windows
need to be compared only among those of equal anchors, and the corpus is never sorted as a whole.

1. Anchors are counted by hash; those that occur once own no repeated window. What repeats is kept in
   two bit maps of a fixed size: anchors that repeat, and those among them with unlike contexts. A
   map may say yes wrongly, which costs work but changes nothing.
2. Each repeated anchor gives a row with a digest of its context, the bytes of all windows that it
   owns; equal contexts collapse in the shuffle, so a large group of copies is one row. A context
   that occurs twice repeats as a whole. The digest is BLAKE2b of 128 bits: equal digests are taken
   for equal bytes, which no known input contradicts.
3. The contexts of an anchor are sorted as suffixes from the anchor on: a mergesort whose comparisons
   find the common extension by binary search over prefix polynomial hashes modulo 2**61 - 1. Two
   windows at offset o are equal if the suffixes agree on LENGTH - o bytes, which the sort's extensions
   tell, and the o bytes before the anchor have equal hashes. Agreements are verified byte by byte; if
   two strings share a hash the group is sorted again with another base.
   At most ``GROUP`` contexts are gathered. The windows of a larger group are dealt again, by offset in
   bands of ``BANDS`` windows and by a digest of the bytes that all windows of a band have, and the
   parts are sorted in the same way; in the last band equal windows have equal digests.
4. The owned windows that repeat go back to their texts as byte ranges, and with them the longest
   string of ``SHORT`` bytes or more around an anchor that the sort's neighbours share: shorter
   passages that repeat are not removed, but known.

A text of more than a slice is read in chunks that overlap, so memory doesn't grow with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm import kernel
from folioweave.llm.common import cut, scratch_table, text_key

LENGTH = 400
GRAM = 48
#: Bytes of a shared string that is worth knowing.
SHORT = 300
#: Contexts that are sorted together, at most, and offsets in a band when more of them are dealt again.
GROUP = 1024
BANDS = (32, 1)
#: Bits of a map: 32 MB whatever the corpus.
MAP_BITS = 28
_PIECE_BITS = 19
#: Bytes of contexts that are sorted at a time, less one group.
BATCH = 256 << 10
#: Bytes that are hashed together, at most.
LONGEST = 1 << 20

_PRIME = np.uint64((1 << 61) - 1)
BASES = (0x9E3779B97F4A7C15 % ((1 << 61) - 1), 0xC2B2AE3D27D4EB4F % ((1 << 61) - 1), 0x165667B19E3779F9 % ((1 << 61) - 1))


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**63."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return x - _PRIME * (x >= _PRIME)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 30 and 31 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return _fold(((a1 * b1) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + _fold(a0 * b0))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    if base not in _POWERS:
        out = np.ones(LONGEST + 1, np.uint64)
        n = 1
        while n <= LONGEST:
            more = min(n, LONGEST + 1 - n)
            out[n : n + more] = _times(out[:more], np.full(more, pow(base, n, int(_PRIME)), np.uint64))
            n += more
        _POWERS[base] = out
    return _POWERS[base]


class Prefixes:
    """Prefix polynomial hashes of at most ``LONGEST`` bytes."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        if len(data) > LONGEST:
            raise ValueError("too many bytes to hash together")
        self.powers = _powers(base)
        c, power, half = data.astype(np.uint64) + np.uint64(1), self.powers[: len(data)], np.uint64(31)
        high = np.cumsum(c * (power >> half))
        low = np.cumsum(c * (power & np.uint64((1 << 31) - 1)))
        self.sums = np.append(np.uint64(0), _fold((high >> np.uint64(30)) + ((high & np.uint64((1 << 30) - 1)) << half) + low))

    def _difference(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _fold(self.sums[ends] + _PRIME - self.sums[starts])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of every span; equal spans have equal hashes wherever they start."""
        return _times(self._difference(starts, ends), self.powers[LONGEST - starts])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        first, second = np.minimum(a, b), np.maximum(a, b)
        return _times(self._difference(first, first + length), self.powers[second - first]) == self._difference(second, second + length)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs that stand for the bytes of each span and the number given with it."""
    view, blake = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    raw = b"".join([blake(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return both[:, 0].view(np.int64), (both[:, 1] + kernel.mix(at.astype(np.uint64) + np.uint64(1))).view(np.int64)


def chunks(column: pa.Array, overlap: int = LENGTH - 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets from 0, place of the bytes in their row) of runs of rows; a row of more
    than a slice comes in chunks, each with ``overlap`` bytes of the next."""
    limit = kernel.SLICE_BYTES
    for lo, _, data, offsets in kernel.slices(column, limit):
        if len(data) <= limit + overlap:
            yield lo, data, offsets, 0
        else:  # one row
            for at in range(0, len(data) - overlap, limit):
                part = data[at : at + limit + overlap]
                yield lo, part, np.array([0, len(part)]), at


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of each run of windows with one anchor: row, first window, last window, anchor, hash of the
    anchor's gram. Places are in ``data``."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty.astype(np.uint64)
    sums, inverse = kernel.prefix_hashes(data)  # whatever gram an anchor is, equal windows have the same
    grams = kernel.span_hashes(sums, inverse, np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1))
    width = length - gram + 1
    low = np.uint64(LONGEST - 1)
    # the least gram of each window, the leftmost of equals: prefix and suffix minima of blocks
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(keyed) // width) * width, ~np.uint64(0))
    padded[: len(keyed)] = keyed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = len(data) - length + 1
    least = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & low).astype(np.int64)
    ends = offsets[1:]
    valid = np.zeros(windows + 1, np.int8)
    long = np.diff(offsets) >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    starts_doc = offsets[:-1][long]
    new[starts_doc] = True
    first = np.flatnonzero(new)
    stops = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False))
    anchor = least[first]
    row = np.searchsorted(offsets[:-1], first, side="right") - 1
    return row, first, stops, anchor, grams[anchor]


class Bits:
    """A set of hashes as a bit map of a fixed size: it may hold more than was put in, never less."""

    def __init__(self, pieces: list[tuple[int, bytes]]):
        self.bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
        for at, piece in pieces:
            self.bits[at << (_PIECE_BITS - 3) : (at + 1) << (_PIECE_BITS - 3)] = np.frombuffer(piece, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - MAP_BITS)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bit_map(hashes: DataFrame, column: str) -> Bits:
    """Gathers a column of hashes; the driver gets ``2**MAP_BITS`` bits at most."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(_PIECE_BITS)).astype(np.int32)), pa.array((at & np.uint64((1 << _PIECE_BITS) - 1)).astype(np.int32))], names=["piece", "bit"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            piece, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(piece).tolist():
                pieces.setdefault(p, np.zeros(1 << _PIECE_BITS, bool))[bit[piece == p]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in pieces.values()], pa.binary())], names=["piece", "bits"])

    # a piece is 64 KB: each is packed in one task
    bits = hashes.select(column).mapInArrow(fill, "piece int, bit int").distinct().repartition("piece").mapInArrow(pack, "piece int, bits binary")
    return Bits([(r["piece"], bytes(r["bits"])) for r in bits.collect()])


def _anchor_hashes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets, _ in chunks(batch.column(0)):
                _, first, last, anchor, gram = anchors(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(digests(data, first, last + LENGTH, anchor - first)[0])], names=["gram", "context"])

    return docs.select("text").mapInArrow(run, "gram long, context long")


_ROWS = "key binary, first long, split long, hi long, lo long, at int, n int, bytes binary"


def _repeated_anchors(docs: DataFrame, repeated: Bits, unlike: Bits) -> DataFrame:
    """key, first, split (the gram's hash), hi, lo (digest of the context), at (anchor less first window), n
    (windows), bytes (of the context if needed)."""
    shared = docs.sparkSession.sparkContext.broadcast((repeated, unlike))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, unlike = shared.value
        for batch in batches:
            for lo, data, offsets, base in chunks(batch.column(1)):
                row, first, last, anchor, gram = anchors(data, offsets)
                kept = repeated.holds(gram)
                row, first, last, anchor, gram = (x[kept] for x in (row, first, last, anchor, gram))
                need = unlike.holds(gram)
                hi, low = digests(data, first, last + LENGTH, anchor - first)
                content = [data[a : b + LENGTH].tobytes() if x else None for a, b, x in zip(first.tolist(), last.tolist(), need.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + row)), pa.array(base + first - offsets[row]), pa.array(gram.view(np.int64)), pa.array(hi), pa.array(low), pa.array((anchor - first).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(content, pa.binary())], names=["key", "first", "split", "hi", "lo", "at", "n", "bytes"])

    return docs.select("key", "text").mapInArrow(run, _ROWS)


def common_extension(hashes: Prefixes, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
    """Bytes that two suffixes share, up to a limit each, by binary search over prefix hashes; ``back``: bytes
    before the two places."""
    low, high = np.zeros(len(a), np.int64), limit.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_] + 1) >> 1
        same = hashes.equal(a[open_] - middle * back, b[open_] - middle * back, middle)
        low[open_[same]] = middle[same]
        high[open_[~same]] = middle[~same] - 1


def suffix_sort(data: np.ndarray, hashes: Prefixes, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by group and bytes, and the extension each shares with the one before.

    ``group`` ascends. All groups are merged at once, runs doubling: an element's place in a merged
    run is its place in its own run and its rank in the neighbour, found by binary search.
    """
    n = len(starts)
    padded = np.append(data, 0)

    def before(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        length_a, length_b = ends[a] - starts[a], ends[b] - starts[b]
        shared = common_extension(hashes, starts[a], starts[b], np.minimum(length_a, length_b))
        byte_a = np.where(shared < length_a, padded[starts[a] + shared].astype(np.int16), -1)
        byte_b = np.where(shared < length_b, padded[starts[b] + shared].astype(np.int16), -1)
        return (byte_a < byte_b) | (or_equal & (byte_a == byte_b))

    order = np.arange(n)
    group_start = np.searchsorted(group, group, side="left")
    group_end = np.searchsorted(group, group, side="right")
    place = np.arange(n)
    width = 1
    while width < int((group_end - group_start).max(initial=0)):
        inside = place - group_start  # of the element at each place: groups keep their places
        run = inside // width
        mate = run ^ 1
        lo = group_start + mate * width
        hi = np.minimum(lo + width, group_end)
        has = np.flatnonzero(lo < group_end)
        left, right = lo[has].copy(), hi[has].copy()
        first = (run[has] & 1) == 0  # elements of the first run go before equals of the second
        while True:
            open_ = np.flatnonzero(left < right)
            if not len(open_):
                break
            middle = (left[open_] + right[open_]) >> 1
            smaller = before(order[middle], order[has[open_]], ~first[open_])
            left[open_[smaller]] = middle[smaller] + 1
            right[open_[~smaller]] = middle[~smaller]
        target = place.copy()
        base = group_start[has] + (run[has] & ~1) * width
        target[has] = base + (inside[has] - run[has] * width) + (left - lo[has])
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    shared = np.zeros(n, np.int64)
    later = np.flatnonzero(group[1:] == group[:-1]) + 1
    a, b = order[later - 1], order[later]
    shared[later] = common_extension(hashes, starts[a], starts[b], np.minimum(ends[a] - starts[a], ends[b] - starts[b]))
    return order, shared


class Collision(Exception):
    """Two strings share a hash."""


def verify(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> None:
    """Raises if any two spans that hashes call equal differ."""
    for lo in range(0, len(a), 512):
        n = length[lo : lo + 512]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(a[lo : lo + 512], n) + within] != data[np.repeat(b[lo : lo + 512], n) + within]).any():
            raise Collision


def repeated_windows(content: list[bytes], at: np.ndarray, n: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For contexts (content, anchor less first window, windows), sorted by group: a flat mask of the
    windows of each, in turn, that another context of the group has too; and the bytes around each
    context's anchor that it shares with a neighbour in the sort."""
    for base in BASES:
        try:
            return _repeated_windows(content, at, n, group, length, base)
        except Collision:
            continue
    raise RuntimeError("strings share a hash under every base")


def _repeated_windows(content: list[bytes], at: np.ndarray, n: np.ndarray, group: np.ndarray, length: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(content), np.uint8)
    size = np.fromiter(map(len, content), np.int64, len(content))
    begin = np.cumsum(size) - size
    anchor, end = begin + at, begin + size
    hashes = Prefixes(data, base)
    order, shared = suffix_sort(data, hashes, anchor, end, group)
    later = np.flatnonzero(shared > 0)
    x, y = order[later - 1], order[later]
    verify(data, anchor[x], anchor[y], shared[later])
    left = common_extension(hashes, anchor[x], anchor[y], np.minimum(at[x], at[y]), back=True)
    verify(data, anchor[x] - left, anchor[y] - left, left)
    reach = np.zeros(len(content), np.int64)
    np.maximum.at(reach, np.concatenate([x, y]), np.tile(left + shared[later], 2))
    flat = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), bool)
    high, low = at[order], at[order] - n[order] + 1  # the offsets of an owned window's anchor
    farthest, partner = np.zeros(len(content), np.int64), np.arange(len(content))
    for o in range(int(low.min()), int(high.max()) + 1):
        # suffixes that agree on the window's bytes from the anchor on have one class
        same = np.cumsum(shared < length - o)
        of = np.flatnonzero((low <= o) & (o <= high))
        own = order[of]
        before = hashes.spans(anchor[own] - o, anchor[own])
        rank = np.lexsort((before, same[of]))
        equal = np.flatnonzero((before[rank][1:] == before[rank][:-1]) & (same[of][rank][1:] == same[of][rank][:-1]))
        if len(equal):
            x, y = own[rank[equal]], own[rank[equal + 1]]
            farthest[x] = farthest[y] = o
            partner[x], partner[y] = y, x
            hit = np.unique(np.concatenate([x, y]))
            out[flat[hit] + at[hit] - o] = True
    verify(data, anchor - farthest, anchor[partner] - farthest, farthest)
    return out, reach


def _runs(mask: np.ndarray) -> list[int]:
    """Starts and ends of the runs of a mask, in turn."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges.tolist()


_DECIDED = "split long, hi long, lo long, runs array<int>, reach int, bytes binary, at int, n int"


def _decide(contexts: DataFrame) -> DataFrame:
    """split, hi, lo, the runs of windows that repeat and the bytes that neighbours share, if there are runs or
    ``SHORT`` bytes; contexts of too large groups come through whole.

    ``contexts`` has a row for each split and digest: copies, at, n, bytes.
    """

    def out(rows: list[tuple], runs: list, reach: list | None = None, whole: bool = False) -> pa.RecordBatch:
        split, hi, lo, _, at, n, content = zip(*rows, strict=True) if rows else [[]] * 7
        if not whole:
            at, n, content = [[None] * len(rows)] * 3
        # copies share their whole context
        reach = reach or [r[5] + LENGTH - 1 for r in rows]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((split, hi, lo, runs, reach, content, at, n), kinds, strict=True)], names=["split", "hi", "lo", "runs", "reach", "bytes", "at", "n"])

    def copied(row: tuple) -> list[int] | None:
        return [0, row[5]] if row[3] > 1 else None

    def sort(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            split = np.array([r[0] for r in rows])
            n = np.array([r[5] for r in rows], np.int64)
            mask, reach = repeated_windows([r[6] for r in rows], np.array([r[4] for r in rows], np.int64), n, np.cumsum(np.append(0, split[1:] != split[:-1])))
            upto = np.append(0, np.cumsum(n))
            runs = [copied(r) or _runs(mask[a:b]) for r, a, b in zip(rows, upto[:-1], upto[1:], strict=True)]
            reach = [r[5] + LENGTH - 1 if r[3] > 1 else x for r, x in zip(rows, reach.tolist(), strict=True)]
            kept = [i for i, x in enumerate(runs) if x or reach[i] >= SHORT]
            yield out([rows[i] for i in kept], [runs[i] for i in kept], [reach[i] for i in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups that need sorting
        group: list[tuple] = []
        size, large = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, group, size
            if len(group) == 1:
                if copied(group[0]):
                    yield out(group, [copied(group[0])])
            elif group:
                held += group
                size += sum(len(r[6]) for r in group)
                if size > BATCH:
                    yield from sort(held)
                    held, size = [], 0
            group = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    yield from close()
                if large is not None and row[0] == large:
                    yield out([row], [copied(row)], whole=True)
                    continue
                large = None
                group.append(row)
                if len(group) > GROUP:
                    large = row[0]
                    yield out(group, [copied(r) for r in group], whole=True)
                    group = []
        yield from close()
        yield from sort(held)

    return contexts.select("split", "hi", "lo", "copies", "at", "n", "bytes").repartition("split").sortWithinPartitions("split", "hi", "lo").mapInArrow(run, _DECIDED)


def _parts(large: DataFrame, band: int) -> DataFrame:
    """The windows of contexts in bands of offsets: owner (split, hi, lo), base (first window in the owner) and
    the part's own split, hi, lo, at, n, bytes. All windows of a part's split have the same core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                split, hi, lo, at, n = (batch.column(c)[i].as_py() for c in range(5))
                data = np.frombuffer(batch.column(5)[i].as_buffer(), np.uint8)
                bands = np.arange((at - n + 1) // band, at // band + 1)
                most, least = np.minimum(at, (bands + 1) * band - 1), np.maximum(at - n + 1, bands * band)
                core, _ = digests(data, at - bands * band, at - (bands + 1) * band + 1 + LENGTH, bands)
                own_hi, own_lo = digests(data, at - most, at - least + LENGTH, most)
                k = len(bands)
                content = [data[a:b].tobytes() if band > 1 else None for a, b in zip((at - most).tolist(), (at - least + LENGTH).tolist(), strict=True)]
                key = kernel.mix(core.view(np.uint64) + kernel.mix(bands.astype(np.uint64))).view(np.int64) if band > 1 else own_hi
                arrays = [np.full(k, split), np.full(k, hi), np.full(k, lo), (at - most).astype(np.int32), key, own_hi, own_lo, most.astype(np.int32), (most - least + 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(content, pa.binary())], names=["owner", "owner_hi", "owner_lo", "base", "split", "hi", "lo", "at", "n", "bytes"])

    return large.select("split", "hi", "lo", "at", "n", "bytes").mapInArrow(run, "owner long, owner_hi long, owner_lo long, base int, split long, hi long, lo long, at int, n int, bytes binary")


def _collapsed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "hi", "lo").agg(F.count("*").alias("copies"), F.first("at").alias("at"), F.first("n").alias("n"), F.max("bytes").alias("bytes"))


def _repeats(rows: DataFrame, level: int = 0) -> DataFrame:
    """split, hi, lo, runs of windows that repeat and reach, in one row or more for each context of ``rows``."""
    decided = scratch_table(_decide(_collapsed(rows)))
    sure = decided.where("runs is not null").select("split", "hi", "lo", "runs", "reach")
    large = decided.where("bytes is not null")
    if level == len(BANDS) or large.isEmpty():
        return sure
    parts = scratch_table(_parts(large, BANDS[level]))
    inner = parts.drop("bytes", "at", "n").join(_repeats(parts, level + 1), ["split", "hi", "lo"])
    base = F.col("base")
    return sure.unionByName(inner.select(F.col("owner").alias("split"), F.col("owner_hi").alias("hi"), F.col("owner_lo").alias("lo"), F.transform("runs", lambda w: w + base).alias("runs"), "reach"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """key, spans (array of start and end bytes), longest of the texts that share strings; spans may overlap.

    ``docs`` has key and text.
    """
    counted = _anchor_hashes(docs).groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("least"), F.max("context").alias("most")).where("n > 1")
    counted = cut(counted.select("gram", (F.col("least") != F.col("most")).alias("unlike")))
    repeated, unlike = bit_map(counted, "gram"), bit_map(counted.where("unlike"), "gram")
    rows = scratch_table(_repeated_anchors(docs, repeated, unlike))
    placed = rows.select("key", "first", "split", "hi", "lo").join(_repeats(rows), ["split", "hi", "lo"])
    pairs = F.transform(F.sequence(F.lit(0), F.size("runs") - 1, F.lit(2)), lambda i: F.struct((F.col("first") + F.element_at("runs", i + 1)).alias("start"), (F.col("first") + F.element_at("runs", i + 2) + LENGTH - 1).alias("end")))
    each = placed.select("key", "reach", F.explode_outer(F.when(F.size("runs") > 0, pairs)).alias("s"))
    return each.groupBy("key").agg(F.collect_set("s").alias("spans"), F.max("reach").cast("long").alias("longest"))


def joined(spans: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that spans cover together."""
    start, end = (spans.field(i).to_numpy() for i in range(2))
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, longest, kept (binary) of every row of ``docs`` (doc_id, text).

    ``longest`` are the bytes of the longest shared string that was met, from ``SHORT`` on, else 0: it
    shows most passages that are too short to be removed, and is no less than ``LENGTH`` where bytes go.

    Null texts count as empty. Texts of fewer than ``LENGTH`` bytes stay whole. Repeated rows and
    equal texts are repeats of each other and lose all bytes if they are long enough. An empty table
    gives no rows.
    """
    own = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(own.select("key", "text")).withColumnRenamed("key", "span_key")
    both = own.join(spans, F.col("key") == F.col("span_key"), "left").select("doc_id", "text", "spans", F.coalesce("longest", F.lit(0)).alias("longest"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = kernel.buffers(batch.column(1))
            kept, removed, count = [], [], []
            for i, spans in enumerate(batch.column(2)):
                text = data[ends[i] : ends[i + 1]]
                start, end = joined(spans.values) if spans.is_valid and len(spans.values) else (np.zeros(0, np.int64),) * 2
                kept.append(b"".join(text[a:b].tobytes() for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True)))
                removed.append(len(text) - len(kept[-1]))
                count.append(len(start))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), batch.column(3), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "longest", "kept"])

    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, longest long, kept binary")
