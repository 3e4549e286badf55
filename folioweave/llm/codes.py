"""Vector codes: Lloyd's rounds with Elkan's bounds, one codebook for each part of a vector.

Each row keeps, for each of its parts, an upper bound of the distance to its entry and one lower bound for
every entry of the codebook. A round moves the bounds by what the entries have moved, and looks only at
entries that both the lower bound and half the distance between the entries allow: an entry is passed
over if it is strictly farther than the upper bound, so that entries at the same distance are always
compared, by whole numbers, and the lower index holds.

Rows and their bounds are written after each round, lower bounds in a byte each (rounded down, by a
scale for each part), and the table of the round before goes. The sums of an entry are added up in
each task and over the tasks; the driver gets the codebooks, whose size depends on the width of the
vectors alone.

Rows with an unusable vector are left out. Fewer than ``ENTRIES`` rows make a shorter codebook. Vectors that
are shorter than the longest, or than a multiple of the parts, count as ending in zeros. Rows with
the same id count each, ordered by their vectors; a null id comes last. Components beyond 2^24 are an error:
whole distances would not be exact. No rows make no codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import remove, scratch_path, scratch_table
from folioweave.llm.vectors import extent, matrix, scaled, usable

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Rows that a task handles at once.
SLICE = 1024
#: Labels whose sums are broadcast, at most; the sums of more are joined, each dealt ``SALTS`` times.
MOST_LABELS, SALTS = 1_000_000, 16
#: Room for rounding, relative to a bound.
_ROOM = 1e-9


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact whole numbers."""
    a, b = x.astype(float), book.astype(float)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def packed(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a byte for each bound, the scale of each row): what they mean is never above the bounds."""
    scale = (lower.max(1) / 255).astype(np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):
        units = np.where(scale[:, None] > 0, np.floor(lower / scale[:, None].astype(float)), 0)
    return np.clip(units, 0, 255).astype(np.uint8), scale


def unpacked(units: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return units * (scale[:, None].astype(float) * (1 - _ROOM))


def assigned(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, upper, lower, distances computed) of the parts ``x`` after the entries have moved by ``moved``."""
    code, rows = code.astype(np.int64), np.arange(len(x))
    upper = (upper + moved[code]) * (1 + _ROOM)
    lower = np.maximum(lower - moved, 0)
    half = np.sqrt(squares(book, book)) / 2 * (1 - _ROOM)
    nearest = half + np.where(np.eye(len(book), dtype=bool), np.inf, 0)
    unsure = np.flatnonzero(upper >= nearest.min(1)[code])
    # the true distance to the own entry, then what may be as near
    own = ((x[unsure] - book[code[unsure]]) ** 2).sum(1)
    upper[unsure] = np.sqrt(own) * (1 + _ROOM)
    lower[unsure, code[unsure]] = np.sqrt(own) * (1 - _ROOM)
    u = upper[unsure, None]
    may = (lower[unsure] <= u) & (half[code[unsure]] <= u)
    may[np.arange(len(unsure)), code[unsure]] = False
    i, j = np.nonzero(may)
    row = unsure[i]
    found = ((x[row] - book[j]) ** 2).sum(1)
    lower[row, j] = np.sqrt(found) * (1 - _ROOM)
    # least distance, then least index, among the own entry and those computed
    who, what, far = np.append(unsure, row), np.append(code[unsure], j), np.append(own, found)
    order = np.lexsort((what, far, who))
    first = order[np.searchsorted(who[order], unsure)]
    code[unsure], upper[unsure] = what[first], np.sqrt(far[first]) * (1 + _ROOM)
    return code, upper, lower, len(own) + len(found)


def _rounds_schema(rows: DataFrame) -> str:
    kind = lambda name: rows.schema[name].dataType.simpleString()
    return f"id {kind('id')}, label {kind('label')}, q array<long>, code binary, upper array<double>, lower binary, scale array<float>, computed long"


def _assign(state: DataFrame, books: np.ndarray, moved: np.ndarray | None, width: int, schema: str) -> DataFrame:
    """``state`` with codes and bounds for the books; without ``moved`` there are no bounds yet."""
    shared = state.sparkSession.sparkContext.broadcast((books, moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved = shared.value
        entries = books.shape[1]
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                n, q = part.num_rows, matrix(part.column(2), width)
                code, upper = np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS))
                lower, scale, computed = np.zeros((n, PARTS, entries), np.uint8), np.zeros((n, PARTS), np.float32), np.zeros(n, np.int64)
                if moved is not None:
                    old = [np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8) for c in (3, 5)]
                    old_code, old_lower = old[0].reshape(n, PARTS), old[1].reshape(n, PARTS, entries)
                    old_upper, old_scale = (part.column(c).flatten().to_numpy().reshape(n, PARTS) for c in (4, 6))
                for p, x in enumerate(np.split(q, PARTS, axis=1)):
                    if moved is None:
                        far = squares(x, books[p])
                        at = far.argmin(1)  # the first of the least
                        code[:, p], upper[:, p] = at, np.sqrt(far[np.arange(n), at]) * (1 + _ROOM)
                        bounds, tried = np.sqrt(far) * (1 - _ROOM), n * entries
                    else:
                        bounds = unpacked(old_lower[:, p], old_scale[:, p])
                        code[:, p], upper[:, p], bounds, tried = assigned(x, books[p], old_code[:, p], old_upper[:, p], bounds, moved[p])
                    lower[:, p], scale[:, p] = packed(bounds)
                    computed[0] += tried
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, PARTS, dtype=np.int32)), pa.array(x.reshape(-1)))
                raw = lambda x: pa.array([y.tobytes() for y in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), raw(code), lists(upper), raw(lower), lists(scale), pa.array(computed)], names=["id", "label", "q", "code", "upper", "lower", "scale", "computed"])

    return state.mapInArrow(run, schema)


def _sums(state: DataFrame, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the components, rows) by part and entry."""
    m = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS * entries, m + 1), np.int64)
        for batch in batches:
            q, code = matrix(batch.column(1), width), np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                np.add.at(sums, code[:, p].astype(np.int64) + p * entries, np.append(q[:, p * m : (p + 1) * m], np.ones((len(q), 1), np.int64), axis=1))
        used = np.flatnonzero(sums[:, -1])
        flat = pa.array(sums[used].reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, m + 1, dtype=np.int32)), flat)], names=["entry", "sums"])

    parts = state.select("code", "q").mapInArrow(run, "entry int, sums array<long>").select("entry", F.posexplode("sums").alias("at", "x"))
    out = np.zeros((PARTS * entries, m + 1), np.int64)
    for r in parts.groupBy("entry", "at").agg(F.sum("x").alias("x")).collect():  # the size of the codebooks
        out[r["entry"], r["at"]] = r["x"]
    out = out.reshape(PARTS, entries, m + 1)
    return out[:, :, :-1], out[:, :, -1]


def codebooks(rows: DataFrame) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(rows with their codes, codebooks by part and entry, distances computed in each round)."""
    spark, schema = rows.sparkSession, _rounds_schema(rows)
    base = scratch_table(rows)
    n, width, _ = extent(base, 1 << 24)
    width += -width % PARTS
    if not n:
        return spark.createDataFrame([], schema), np.zeros((PARTS, 0, 0), np.int64), []
    first = np.zeros((min(n, ENTRIES), width), np.int64)
    for i, r in enumerate(base.orderBy(F.col("id").asc_nulls_last(), "q").limit(ENTRIES).collect()):
        first[i, : len(r["q"])] = r["q"]
    books = np.stack(np.split(first, PARTS, axis=1))
    state, moved, before, computed = base, None, None, []
    for turn in range(ROUNDS + 1):
        path = scratch_path(spark)
        _assign(state, books, moved, width, schema).write.option("compression", "zstd").parquet(path)
        state = spark.read.schema(schema).parquet(path)
        if before is not None:
            remove(spark, before)  # what was made of it is written
        before = path
        computed.append(state.agg(F.sum("computed")).first()[0])
        if turn < ROUNDS:
            sums, count = _sums(state, books.shape[1], width)
            new = np.where(count[:, :, None] > 0, sums // np.maximum(count, 1)[:, :, None], books)
            moved = np.sqrt(((new - books) ** 2).sum(2)) * (1 + _ROOM)
            books = new
    return state, books, computed


def errors(state: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (hexadecimal) and error of every row of ``codebooks``."""
    shared, width = state.sparkSession.sparkContext.broadcast(books), books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(3).to_pylist()
            code = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, PARTS)
            near = np.concatenate([shared.value[p][code[:, p]] for p in range(PARTS)], axis=1)
            far = ((matrix(batch.column(2), width) - near) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.hex() for x in raw]), pa.array(far)], names=["id", "label", "code", "error"])

    kind = lambda name: state.schema[name].dataType.simpleString()
    return state.select("id", "label", "q", "code").mapInArrow(run, f"id {kind('id')}, label {kind('label')}, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of error over equal labels; rows without a label are one group."""
    sums = scratch_table(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    if sums.count() <= MOST_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    dealt = sums.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    own = coded.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return own.join(dealt, F.col("label").eqNullSafe(F.col("of")) & (own["salt"] == dealt["salt"])).drop("of", "salt")


def compress(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the rows of a table of vec_id, embedding and label
    whose vector is usable; components are floor(1024 x)."""
    rows = embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), "label", scaled(F.col("embedding"), 1024).alias("q"))
    state, books, _ = codebooks(rows)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    coded = with_label_errors(scratch_table(errors(state, books)))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
