"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

File format: a folder with three Parquet tables. ``ranks`` has a row (rank int, id int) for each id
that occurs; rank 0 is the most frequent id, of equally frequent ones the smaller comes first.
``parts`` has a row (part int, start long) for each part of the documents: the ids of all parts
before it. ``blocks`` has a row for a run of documents:

    part int, seq long   position of its first document: (part, seq) ascends with doc_id
    start long           ids of the part's documents before its first
    n long               ids in the block
    doc_id array         its documents
    lengths binary       ids in each of them (with the end id), in the code below
    payload binary       ranks of all their ids, in the code below

Code of n numbers: ceil(n / 4) control bytes, each with the byte lengths less one of four numbers in
two bits each, the first number lowest; then the numbers' bytes, little end first. A table of the
256 control bytes gives the lengths of all numbers at once, so that numpy decodes without a loop
over numbers.

Texts are encoded where they lie, in slices: numpy cuts a slice into pre-tokens and looks their hashes
up among those that the worker has met; a piece's characters are compared with those kept, so that a
collision costs time and changes nothing. The library encodes each new piece once, and whole texts
that hold characters outside ``CLASSES``, the string of an added token or a collision. Only ids are
shuffled, by ranges of doc_id.

The ids are the library's with ``add_special_tokens=False``: the string of an added token in a text
is that token. Null and empty texts give the end id alone; repeated rows are encoded each. Rows with equal ids
follow each other by text; a null doc_id comes first. An empty table gives an empty file. Texts that are not
UTF-8 are read with replacement characters.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import kernel
from folioweave.llm.common import scratch_path, scratch_table

END = 0
BLOCK_IDS = 1 << 18
#: Pieces, and their characters, that a Python worker keeps; a longer piece is never kept.
CACHE_PIECES, CACHE_CHARS, LONGEST = 600_000, 8 << 20, 64

ODD, LETTER, NUMBER, SPACE, OTHER = range(5)


def _classes() -> np.ndarray:
    """The class of each character that the pre-token pattern tells apart; ODD where Unicode versions could differ."""
    out = np.zeros(0x2070, np.uint8)
    for lo, hi in ((9, 10), (13, 13), (0x20, 0x7E), (0xA1, 0xAC), (0xAE, 0x24F), (0x370, 0x52F), (0x2010, 0x2027), (0x2030, 0x205E)):
        for c in range(lo, hi + 1):
            kind = unicodedata.category(chr(c))
            out[c] = SPACE if chr(c).isspace() else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER if kind[0] in "PS" else ODD
    return out


CLASSES = _classes()


def pre_tokens(chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts that lie end to end, without odd characters.

    The pattern of byte-level BPE, in runs of one class: a run takes the blank before it; white space
    leaves its last character alone if a text goes on after it; an apostrophe by itself that follows
    no blank takes the s, t, m, d, re, ve or ll after it.
    """
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    kind = CLASSES[chars]
    edge = first[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(edge)
    stop, of = np.append(run[1:], n), kind[run]
    start = edge
    joined = (of != SPACE) & ~first[run] & (chars[run - 1] == ord(" "))
    start[run[joined]] = False
    start[run[joined] - 1] = True
    start[stop[(of == SPACE) & ~first[stop]] - 1] = True
    quote = np.flatnonzero((of == OTHER) & (stop - run == 1) & (chars[run] == ord("'")) & ~joined & ~first[stop])
    quote = quote[of[np.minimum(quote + 1, len(of) - 1)] == LETTER]
    at = run[quote] + 1
    one, two = chars[at], np.where(at + 1 < stop[quote + 1], chars[np.minimum(at + 1, n - 1)], 0)
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    for pair in ("re", "ve", "ll"):
        size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
    at, size = at[size > 0], size[size > 0]
    start[at] = False
    rest = at + size
    start[rest[rest < n]] = True
    return np.flatnonzero(start)


def _gather(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of every i, count[i] of them."""
    upto = np.cumsum(count)
    return np.repeat(first - (upto - count), count) + np.arange(int(upto[-1]) if len(upto) else 0)


class Grown:
    """An array that is appended to."""

    def __init__(self, dtype):
        self.room, self.n = np.empty(1 << 16, dtype), 0

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            room = np.empty(2 * (self.n + len(x)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)


class Places:
    """Numbers by 64-bit keys, in open addressing; ``CACHE_PIECES`` of them fill a third at most."""

    def __init__(self):
        self.bits = (3 * CACHE_PIECES).bit_length()
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it has none."""
        out, slot, open_ = np.full(len(keys), -1, np.int64), self._slots(keys), np.arange(len(keys))
        while len(open_):
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Takes keys that are distinct and new."""
        self.n += len(keys)
        slot, open_ = self._slots(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            self.keys[slot[free]] = keys[free]  # of keys for one slot the last stays
            placed = self.keys[slot[open_]] == keys[open_]
            self.values[slot[open_[placed]]] = values[open_[placed]]
            open_ = open_[~placed]
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)


class Encoder:
    """Ids of texts, with the ids of the pieces met so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a token of a byte-level vocabulary has a character for each of its bytes
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # an added token of letters and spaces may arise where words are laid end to end
        self.joins = not any(x.replace(" ", "").isalpha() for x in self.added)
        self.type = id_type(path)
        self.clear()

    def clear(self) -> None:
        self.places, self.chars, self.ids = Places(), Grown(np.uint16), Grown(self.type)
        # of each piece: where its characters and ids begin, and how many there are
        self.at, self.size, self.first, self.length = (Grown(np.int32) for _ in range(4))
        self.kept = 0, 0, 0

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.type) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chars: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Keeps the ids of new pieces, which lie end to end; their numbers. Words of a space and letters
        stay whole when they are laid end to end, so that hundreds are encoded as one text; their
        tokens are told apart by bytes."""
        begin = np.cumsum(size) - size
        letters = CLASSES[chars] == LETTER
        letters[begin] |= chars[begin] == ord(" ")
        word = np.minimum.reduceat(letters, begin) & (chars[begin] == ord(" ")) & (size > 1) & self.joins
        order = np.argsort(~word, kind="stable")
        plain = int(word.sum())
        chars, size = chars[_gather(begin[order], size[order])], size[order]
        upto = np.append(0, np.cumsum(size))
        text = chars.astype("<u4").tobytes().decode("utf-32-le")
        joined = self.library([text[upto[i] : upto[min(i + 256, plain)]] for i in range(0, plain, 256)])
        single = self.library([text[a:b] for a, b in zip(upto[plain:-1].tolist(), upto[plain + 1 :].tolist(), strict=True)])
        ids = np.concatenate([np.zeros(0, self.type), *joined])
        length = np.zeros(0, np.int64)
        if plain:
            wide = np.append(0, np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800)))
            cuts = np.searchsorted(np.cumsum(self.bytes[ids]), wide[upto[1 : plain + 1]]) + 1
            length = np.diff(np.append(0, cuts))
        length = np.append(length, np.fromiter(map(len, single), np.int64, len(single)))
        number = np.empty(len(size), np.int64)
        number[order] = self.at.n + np.arange(len(size))
        self.at.extend(self.chars.n + upto[:-1])
        self.size.extend(size)
        self.first.extend(self.ids.n + np.cumsum(length) - length)
        self.length.extend(length)
        self.chars.extend(chars)
        self.ids.extend(np.concatenate([ids, *single]))
        return number

    def find(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces among those kept, and which pieces are others of the same hash."""
        sums, inverse = kernel.prefix_hashes(chars)
        hashes = kernel.span_hashes(sums, inverse, start, start + size) | np.uint64(1)
        coded = pa.array(hashes).dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        if self.places.n + len(distinct) > CACHE_PIECES or self.chars.n > CACHE_CHARS:
            self.clear()
        number = self.places.find(distinct)
        self.kept = self.at.n, self.chars.n, self.ids.n
        new = np.flatnonzero(number < 0)
        if len(new):
            one = np.zeros(len(distinct), np.int64)
            one[code[::-1]] = np.arange(len(code))[::-1]
            for long in (False, True):
                which = new[(size[one[new]] > LONGEST) == long]
                if len(which):
                    number[which] = self.learn(chars[_gather(start[one[which]], size[one[which]])], size[one[which]])
                    if not long:
                        self.places.add(distinct[which], number[which])
                        self.kept = self.at.n, self.chars.n, self.ids.n
        found = number[code]
        unlike = self.size.room[found] != size
        same = np.flatnonzero(~unlike)
        differ = self.chars.room[_gather(self.at.room[found[same]], size[same])] != chars[_gather(start[same], size[same])]
        if differ.any():
            unlike[same[np.searchsorted(np.cumsum(size[same]), np.flatnonzero(differ), side="right")]] = True
        return found, unlike

    def forget(self) -> None:
        """Drops the pieces of more than ``LONGEST`` characters, which were learnt last."""
        self.at.n, self.chars.n, self.ids.n = self.kept
        self.size.n = self.first.n = self.length.n = self.at.n

    def plain(self, text: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts that lie end to end (each with the end id), how many each has, and which have none
        because the library must encode them. ``offsets`` are in characters."""
        rows = len(offsets) - 1
        wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.minimum(wide, len(CLASSES) - 1).astype(np.uint16)
        odd = np.zeros(rows, bool)
        strange = np.flatnonzero((CLASSES[inside] == ODD) | (wide >= len(CLASSES)))
        odd[np.searchsorted(offsets, strange, side="right") - 1] = True
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                odd[np.searchsorted(offsets, at, side="right") - 1] = True
                at = text.find(token, at + 1)
        if odd.any():
            own = np.flatnonzero(~odd)
            inside = inside[np.repeat(~odd, np.diff(offsets))]
            sizes = np.diff(offsets)[own]
        else:
            own, sizes = np.arange(rows), np.diff(offsets)
        upto = np.append(0, np.cumsum(sizes))
        start = pre_tokens(inside, upto)
        size = np.diff(np.append(start, len(inside)))
        code, unlike = self.find(inside, start, size) if len(start) else (np.zeros(0, np.int64), np.zeros(0, bool))
        row = own[np.searchsorted(upto, start, side="right") - 1]
        if unlike.any():
            odd[row[unlike]] = True
            code, row = code[~odd[row]], row[~odd[row]]
        length = self.length.room[code].astype(np.int64)
        n = np.bincount(row, length, rows).astype(np.int64) + 1
        n[odd] = 0
        ends = np.cumsum(n)
        out = np.full(int(ends[-1]) if rows else 0, END, self.type)
        before = np.cumsum(length) - length
        lead = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        place = (ends - n)[row] + before - np.repeat(before[lead], np.diff(np.append(lead, len(row))))
        out[_gather(place, length)] = self.ids.room[_gather(self.first.room[code], length)]
        return out, n, odd

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each slice: first row, end row, the rows' ids (each with the end id) and how many each has."""
        for lo, hi, data, offsets in kernel.slices(column):
            raw = data.tobytes()
            try:
                text = raw.decode()
                ends = offsets if len(text) == len(raw) else np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
                out, n, odd = self.plain(text, ends)
                self.forget()
                texts = [text[ends[i] : ends[i + 1]] for i in np.flatnonzero(odd).tolist()]
            except UnicodeDecodeError:
                out, n, odd = np.zeros(0, self.type), np.zeros(hi - lo, np.int64), np.ones(hi - lo, bool)
                texts = [raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            if odd.any():
                whole = [np.append(x, self.type(END)) for x in self.library(texts)]
                kept = np.repeat(~odd, n)  # the plain rows' ids keep their order
                n[odd] = [len(x) for x in whole]
                both = np.empty(int(n.sum()), self.type)
                both[np.repeat(~odd, n)] = out[kept]
                both[np.repeat(odd, n)] = np.concatenate(whole)
                out = both
            yield lo, hi, out, n


_ENCODERS: dict[str, Encoder] = {}


def id_type(path: str) -> type:
    """Two bytes hold the ids of a vocabulary of up to 2**16, four those of a larger one."""
    from tokenizers import Tokenizer

    return np.uint16 if max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) < 1 << 16 else np.uint32


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, key, nth, n, ids of every row, wherever it lies; and for each task a row whose ``seen``
    and ``times`` say how often it has met each id."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:  # kept while the worker lives
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        encoder, nth = _ENCODERS[tokenizer], TaskContext.get().partitionId() << 40
        total, names = np.zeros(0, np.int64), ["doc_id", "key", "nth", "n", "ids", "seen", "times"]
        empty = None
        for batch in batches:
            empty = batch.column(0).slice(0, 0)
            for lo, hi, ids, n in encoder.encode(batch.column(1)):
                count = np.bincount(ids, minlength=len(total))
                count[: len(total)] += total
                total = count
                rows = hi - lo
                ends = np.append(0, np.cumsum(n * ids.itemsize)).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), batch.column(2).slice(lo, rows), pa.array(np.arange(nth, nth + rows)), pa.array(n), binary, pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary())], names=names)
                nth += rows
        if empty is not None:
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, empty.type), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary()), pa.array([seen.astype("<u4").tobytes()]), pa.array([total[seen].astype("<i8").tobytes()])], names=names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(run, f"doc_id {kind}, key long, nth long, n long, ids binary, seen binary, times binary")


def encode_numbers(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x, "<u4")
    extra = (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    codes = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    codes[: len(x)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes() + x.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]].tobytes()


_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def decode_numbers(code: bytes, n: int) -> np.ndarray:
    data = np.frombuffer(code, np.uint8)
    controls = -(-n // 4)
    length = _LENGTHS[data[:controls]].reshape(-1)[:n]
    at = controls + np.cumsum(length) - length
    out = data[at].astype(np.uint32)
    for byte in (1, 2, 3):
        more = np.flatnonzero(length > byte)
        if not len(more):
            break
        out[more] |= data[at[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Writes ``docs`` (doc_id, text) in the file format above; tokenizes each text once."""
    spark = docs.sparkSession
    rows = scratch_table(tokenized(docs, tokenizer))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for seen, times in zip(batch.column(0), batch.column(1), strict=True):
                for i, n in zip(np.frombuffer(seen.as_buffer(), "<u4").tolist(), np.frombuffer(times.as_buffer(), "<i8").tolist(), strict=True):
                    total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["id", "n"])

    counted = rows.where("seen is not null").select("seen", "times").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [r["id"] for r in sorted(counted.collect(), key=lambda r: (-r["n"], r["id"]))]  # a row for each id of the vocabulary at most
    spark.createDataFrame([(i, x) for i, x in enumerate(ranked)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)
    kind, dtype = docs.schema["doc_id"].dataType.simpleString(), id_type(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, part, seq, before = shared.value, TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            data, ends = kernel.buffers(batch.column(2))
            upto, lo = np.append(0, np.cumsum(n)), 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + BLOCK_IDS, side="right")) - 1)
                ids = np.frombuffer(data[ends[lo] : ends[hi]].tobytes(), dtype)
                doc_id = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq]), pa.array([before]), pa.array([len(ids)]), doc_id, pa.array([encode_numbers(n[lo:hi])], pa.binary()), pa.array([encode_numbers(rank[ids])], pa.binary())], names=["part", "seq", "start", "n", "doc_id", "lengths", "payload"])
                seq, before, lo = seq + hi - lo, before + len(ids), hi

    # nth tells equal rows apart, so that any number of them spreads over the ranges
    order = ["doc_id", "key", "nth"]
    ordered = rows.where("seen is null").select(*order, "n", "ids").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("doc_id", "n", "ids").mapInArrow(encode, f"part int, seq long, start long, n long, doc_id array<{kind}>, lengths binary, payload binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n"))
    start, first = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in sizes.collect()):  # a row for each file
        first.append((part, start))
        start += n
    spark.createDataFrame(first, "part int, start long").coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (array<int>) of every document of a file."""
    return _decoded(spark, path, "ids array<int>", lambda ids: ids.astype(np.int32))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from a file."""
    return _decoded(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()))


def _decoded(spark: SparkSession, path: str, column: str, derive) -> DataFrame:
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_id"].dataType.elementType.simpleString()
    ranked = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]  # a row for each id of the vocabulary at most
    parts = {r["part"]: r["start"] for r in spark.read.parquet(f"{path}/parts").collect()}  # a row for each file
    shared = spark.sparkContext.broadcast((np.array(ranked, "<u4"), parts))
    value = pa.list_(pa.int32()) if "array" in column else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, parts = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                start, ids = parts[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py(), batch.column(2)[i].values
                n = decode_numbers(batch.column(3)[i].as_py(), len(ids)).astype(np.int64)
                upto = np.append(0, np.cumsum(n))
                tokens = ranked[decode_numbers(batch.column(4)[i].as_py(), int(upto[-1]))]
                found = pa.array([derive(tokens[a:b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], value)
                yield pa.RecordBatch.from_arrays([ids, pa.array(start + upto[:-1]), pa.array(n), found], names=["doc_id", "start", "n_tokens", column.split()[0]])

    return blocks.select("part", "start", "doc_id", "lengths", "payload").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, {column}")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the file (into the shared folder if no path is given) and returns what is read back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark)
    write_tokens(docs, path, tokenizer)
    return token_digests(spark, path)
