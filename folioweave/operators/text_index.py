"""An inverted index of texts that is kept: batches are appended as segments, segments merged by size.

Plain Parquet tables under one path, each dealt by segment (and, where a question reads them, by bucket
of the term):

- ``texts``: key, the columns of ``by``, length, size (the binary logarithm of the length);
- ``postings``: term, key, ``by``, size, tf, length, sorted by term and block;
- ``blocks``: for each term and block the number of postings, the largest tf and the least length. A block
  is what the texts of a segment with the same ``by`` and size are;
- ``stats``: for each block the number and length of its texts;
- ``deleted``: keys and the segment they are deleted in;
- ``log``: one row for each segment and what it replaces. A segment counts once its row is written.

Filters on the columns of ``by`` hold for every table, so that a question under a filter has the statistics
of what the filter leaves, without a look at the texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioweave.functions.batches import slices
from folioweave.session import checkpointed, remove

K1, B = 1.2, 0.75
#: Letters and digits, as Spark's and as Python's patterns have them.
TERM = r"[\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")
#: Postings up to which a question is scored at once; beyond, blocks are left out by their bounds.
DIRECT = 200_000
#: Blocks whose texts set the score that others must reach.
LEADERS = 64
#: Postings of a partition while an index is built.
DEALT = 1_000_000
LOG = "segment int, replaces array<int>, texts long, deletes boolean, buckets array<int>"

Keep = Callable[[DataFrame], DataFrame]


def weight(tf: Column, df: Column, length: Column, n: Column, mean: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


#: Bytes of text whose terms a worker holds at once, a longer text aside.
HELD = 1 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The length and the terms, counted, of each text, which is a batch's last column."""
    for batch in (part for whole in batches for part in slices(whole, HELD)):
        found = [None if x is None else _WORD.findall(x) for x in batch.columns[-1].to_pylist()]
        words = pa.array(list(chain.from_iterable(x for x in found if x)), pa.string()).dictionary_encode()
        kinds = max(1, len(words.dictionary))
        # a text's place and a term's number as one number: equal ones are counted by a sort
        at = np.repeat(np.arange(len(found), dtype=np.int64), [len(x or ()) for x in found]) * kinds
        pairs, counts = np.unique(at + words.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.searchsorted(pairs, np.arange(len(found) + 1, dtype=np.int64) * kinds).astype(np.int32))
        lists = lambda values: pa.ListArray.from_arrays(ends, values)
        own = [pa.array([None if x is None else len(x) for x in found], pa.int64()), lists(words.dictionary.take(pa.array(pairs % kinds))), lists(pa.array(counts.astype(np.int64)))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*batch.schema.names[:-1], "length", "terms", "counts"])


def best_of(scores: DataFrame, k: int, key: str) -> DataFrame:
    """key, score, rank of the k highest scores, ties by key."""
    best = scores.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


@dataclass(frozen=True)
class TextIndex:
    """The index at a path; ``by`` names the columns that questions may filter by."""

    spark: SparkSession
    path: str
    key: str = "chunk_id"
    by: tuple[str, ...] = ()
    buckets: int = 16

    # ---- upkeep ----------------------------------------------------------------------------------
    def write(self, chunks: DataFrame) -> TextIndex:
        """A new index of ``chunks`` (key, by, text) in the place of what is there."""
        remove(self.spark, self.path)
        self._add(chunks)
        return self

    def append(self, chunks: DataFrame) -> None:
        """Adds ``chunks``; a text whose key the index has takes its place."""
        self.delete(chunks.select(self.key))
        self._add(chunks)

    def delete(self, keys: DataFrame) -> None:
        """Takes the texts with these keys out. Their postings stay until their segment is merged."""
        if not self.segments():
            return
        gone = checkpointed(self.texts().join(keys.select(self.key).distinct(), self.key, "left_semi"))
        if gone.isEmpty():
            return
        n = self._next()
        gone.select(self.key, F.col("segment").alias("of")).write.mode("overwrite").parquet(f"{self.path}/deleted/segment={n}")
        minus = gone.groupBy(F.col("segment").alias("of"), *self._block()).agg((-F.count("*")).alias("n"), (-F.sum("length")).alias("total"), (-F.count("length")).alias("counted"))
        minus.write.mode("overwrite").parquet(f"{self.path}/stats/segment={n}")
        self._log(n, [], 0, True, [])

    def merge(self, most: int = 8) -> list[int]:
        """Segments of about the same size become one as soon as there are ``most`` of them; what is deleted in
        them goes. Returns the segments that were replaced; ``vacuum`` removes their files."""
        replaced: list[int] = []
        while True:
            tiers: dict[int, list] = {}
            for s in self.segments():
                tiers.setdefault(int(math.log(max(1, s["texts"]), 4)), []).append(s["segment"])
            full = sorted(x for x in tiers.values() if len(x) >= max(2, most))
            if not full:
                return replaced
            replaced += full[0]
            n, own = self._next(), full[0]
            self._store(n, self.texts(own).drop("segment"), self._live(self._read("postings", own, range(self.buckets)), own).drop("segment"), own)

    def vacuum(self) -> None:
        """Deletes the files of replaced segments; no reader may use them any more."""
        for n in {x for r in self._rows() for x in r["replaces"]}:
            for name in ("texts", "postings", "blocks", "stats"):
                remove(self.spark, f"{self.path}/{name}/segment={n}")

    def _add(self, chunks: DataFrame) -> None:
        low = chunks.select(self.key, *self.by, F.lower("text").alias("text"))
        kept = ", ".join(f"`{c}` {low.schema[c].dataType.simpleString()}" for c in (self.key, *self.by))
        # terms are counted where the texts lie: only what differs in a text is dealt
        counted = checkpointed(low.mapInArrow(_counted, f"{kept}, length long, terms array<string>, counts array<long>"))
        sized = counted.withColumn("size", F.floor(F.log2(F.greatest(F.col("length"), F.lit(1)))).cast("int"))
        each = sized.select(self.key, *self.by, "size", "length", F.explode(F.arrays_zip("terms", "counts")).alias("e"))
        each = each.select(self.key, *self.by, "size", "length", F.col("e.terms").alias("term"), F.col("e.counts").alias("tf")).withColumn("bucket", self._bucket(F.col("term")))
        size = sized.groupBy(*self._block()).agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("m")).agg(F.max("n"), F.sum("m")).first()
        # postings of a term and block lie together, dealt by their texts where these are many
        salt = F.pmod(F.xxhash64(self.key), F.lit(-(-(size[0] or 1) // DEALT)))
        dealt = self._by_bucket(each, size[1] or 0, "term", *self._block(), salt)
        self._store(self._next(), sized.select(self.key, *self.by, "size", "length"), dealt, [])

    def _by_bucket(self, rows: DataFrame, count: int, *by) -> DataFrame:
        """A partition has rows of one bucket, ``DEALT`` or fewer on average; ``by`` says which."""
        parts = -(-max(1, count) // (DEALT * self.buckets))
        return rows.repartitionById(self.buckets * parts, (F.col("bucket") * parts + F.pmod(F.xxhash64(*by), F.lit(parts))).cast("int"))

    def _store(self, n: int, texts: DataFrame, postings: DataFrame, replaces: list[int]) -> None:
        texts.write.mode("overwrite").parquet(f"{self.path}/texts/segment={n}")
        at = f"{self.path}/postings/segment={n}"
        postings.sortWithinPartitions("bucket", "term", *self._block()).write.mode("overwrite").partitionBy("bucket").parquet(at)
        texts = self.spark.read.parquet(f"{self.path}/texts/segment={n}")
        texts.groupBy(*self._block()).agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.count("length").alias("counted")).withColumn("of", F.lit(n)).write.mode("overwrite").parquet(f"{self.path}/stats/segment={n}")
        written = self.spark.read.schema(self._schema(texts, "postings")).option("basePath", at).parquet(at)
        blocks = written.groupBy("bucket", "term", *self._block()).agg(F.count("*").alias("df"), F.max("tf").alias("most"), F.min("length").alias("least"))
        at = f"{self.path}/blocks/segment={n}"
        blocks = checkpointed(blocks)
        self._by_bucket(blocks, blocks.count(), "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(at)
        used = [r["bucket"] for r in self.spark.read.schema(self._schema(texts, "blocks")).option("basePath", at).parquet(at).select("bucket").distinct().collect()]
        self._log(n, replaces, texts.count(), False, used)

    def _log(self, n: int, replaces: list[int], texts: int, deletes: bool, buckets: list[int]) -> None:
        self.spark.createDataFrame([(n, replaces, texts, deletes, sorted(buckets))], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    # ---- reading ---------------------------------------------------------------------------------
    def _rows(self) -> list:
        """The log; one row for each append, deletion and merge."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return []
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log").orderBy("segment").collect()

    def segments(self, rows: list | None = None) -> list:
        """The rows of the log whose texts count."""
        rows = self._rows() if rows is None else rows
        gone = {x for r in rows for x in r["replaces"]}
        return [r for r in rows if not r["deletes"] and r["segment"] not in gone]

    def _next(self) -> int:
        return max((r["segment"] for r in self._rows()), default=0) + 1

    def _block(self) -> list[str]:
        return [*self.by, "size"]

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(self.buckets)).cast("int")

    def _schema(self, texts: DataFrame, name: str) -> str:
        kind = lambda c: f"`{c}` {texts.schema[c].dataType.simpleString()}"
        by = [kind(c) for c in self.by]
        own = {
            "texts": [kind(self.key), *by, "size int", "length long"], "stats": [*by, "size int", "n long", "total long", "counted long", "of int"], "deleted": [kind(self.key), "of int"],
            "postings": ["term string", kind(self.key), *by, "size int", "length long", "tf long", "bucket int"], "blocks": ["term string", *by, "size int", "df long", "most long", "least long", "bucket int"],
        }[name]
        return ", ".join([*own, "segment int"])

    def _read(self, name: str, segments: list[int], buckets=None, rows: list | None = None) -> DataFrame:
        rows = self._rows() if rows is None else rows
        used = {r["segment"]: r["buckets"] for r in rows}
        texts = self.spark.read.parquet(f"{self.path}/texts/segment={self.segments(rows)[0]['segment']}")
        paths = [f"{self.path}/{name}/segment={s}" for s in segments]
        if buckets is not None:
            paths = [f"{self.path}/{name}/segment={s}/bucket={b}" for s in segments for b in buckets if b in used[s]]
        schema = self._schema(texts, name)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _live(self, df: DataFrame, segments: list[int], rows: list | None = None) -> DataFrame:
        """``df`` (key, segment) without what is deleted."""
        rows = self._rows() if rows is None else rows
        deletes = [r["segment"] for r in rows if r["deletes"]]
        if not deletes:
            return df
        gone = self._read("deleted", deletes, rows=rows).where(F.col("of").isin(segments)).select(F.col(self.key).alias("_key"), "of").distinct()
        return df.join(gone, (df[self.key] == gone["_key"]) & (df["segment"] == gone["of"]), "left_anti")

    def texts(self, segments: list[int] | None = None) -> DataFrame:
        """The texts that count: key, by, size, length and their segment."""
        rows = self._rows()
        own = [r["segment"] for r in self.segments(rows)] if segments is None else segments
        return self._live(self._read("texts", own, rows=rows), own, rows)

    def scores(self, asked: list[str], allowed: DataFrame | None = None) -> DataFrame:
        """key, score of every text with one of the terms, among those whose key is allowed; statistics are
        those of the texts allowed."""
        rows = self._rows()
        own = [r["segment"] for r in self.segments(rows)]
        hits = self._hits(asked, own, rows)
        lengths = self._live(self._read("texts", own, rows=rows), own, rows)
        if allowed is not None:
            hits, lengths = (x.join(allowed, self.key, "left_semi") for x in (hits, lengths))
        stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
        often = hits.groupBy("term").agg(F.count("*").alias("df"))
        weighed = hits.join(F.broadcast(often), "term").join(F.broadcast(stats))  # a row for each asked term, and one row
        return weighed.groupBy(self.key).agg(F.round(F.sum(weight(F.col("tf"), F.col("df"), F.col("length"), F.col("n"), F.col("mean"))), 9).alias("score"))

    def _hits(self, asked: list[str], own: list[int], rows: list) -> DataFrame:
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in asked})
        return self._live(self._read("postings", own, buckets, rows).where(F.col("term").isin(asked)), own, rows)

    def best(self, asked: list[str], k: int, keep: Keep = lambda df: df) -> DataFrame:
        """key, score, rank of the best k texts for the terms, among those that ``keep`` (a filter by the columns
        of ``by``) leaves; statistics are theirs.

        A block's bound is the sum of what its largest tf and least length would make for each term. The texts
        of the blocks with the highest bounds are scored first; of the others only the postings of
        blocks whose bound reaches the k-th score are read.
        """
        rows = self._rows()
        own = [r["segment"] for r in self.segments(rows)]
        if not own:
            raise ValueError(f"no index at {self.path}")
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in asked})
        blocks = keep(self._read("blocks", own, buckets, rows).where(F.col("term").isin(asked)))
        deletes = [r["segment"] for r in rows if r["deletes"]]
        stats = keep(self._read("stats", own + deletes, rows=rows).where(F.col("of").isin(own)))
        none = F.lit(None).cast("long")
        counted = stats.agg(F.lit(None).cast("string").alias("term"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("counted").alias("counted"))
        often = blocks.groupBy("term").agg(F.sum("df").alias("n"), none.alias("total"), none.alias("counted"))
        known = {r["term"]: r for r in counted.unionByName(often).collect()}  # a row for each asked term, and one
        hits = keep(self._hits(asked, own, rows))
        df = {t: r["n"] for t, r in known.items() if t is not None}
        if deletes:
            df |= dict.fromkeys(df, 0) | {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}
        n, total, with_length = known[None]["n"] or 0, known[None]["total"] or 0, known[None]["counted"] or 0
        mean = total / with_length if with_length else 1.0
        of = lambda tf, length: weight(tf, F.element_at(F.create_map(*[F.lit(x) for t in df for x in (t, float(df[t]))]), F.col("term")), length, F.lit(float(n)), F.lit(float(mean) or 1.0))
        if not df:
            return hits.select(self.key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        scored = lambda rows: rows.groupBy(self.key).agg(F.round(F.sum(of(F.col("tf"), F.col("length"))), 9).alias("score"))
        if sum(df.values()) <= DIRECT:
            return best_of(scored(hits), k, self.key)
        opened = self._opened(blocks, hits, of, scored, k)
        return best_of(scored(hits.join(opened, self._same_block(hits, opened), "left_semi")), k, self.key)

    def _opened(self, blocks: DataFrame, hits: DataFrame, of, scored, k: int) -> DataFrame:
        """The blocks that may hold one of the best k."""
        bounds = checkpointed(blocks.groupBy("segment", *self._block()).agg(F.sum(of(F.col("most"), F.col("least"))).alias("bound"), F.max("df").alias("texts")))
        first, texts = [], 0
        for r in bounds.orderBy(F.desc("bound"), "segment", *self._block()).limit(LEADERS).collect():
            if texts < k:
                first.append(r)
                texts += r["texts"]
        leaders = self.spark.createDataFrame(first, bounds.schema)
        found = scored(hits.join(F.broadcast(leaders), self._same_block(hits, leaders), "left_semi"))  # ``LEADERS`` rows at most
        known = found.orderBy(F.desc("score")).limit(k).collect()
        least = known[-1]["score"] if len(known) == k else 0.0
        return bounds.where(F.col("bound") >= least - 1e-6)

    def _same_block(self, a: DataFrame, b: DataFrame) -> Column:
        out = a["segment"] == b["segment"]
        for c in self._block():
            out = out & a[c].eqNullSafe(b[c])
        return out
