"""Ranking: BM25, nearest vectors, reciprocal rank fusion, re-ranking.

Scores are computed over narrow rows; texts and payload join the few that remain.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioweave.operators.text_index import TERM, Keep, TextIndex, best_of, weight
from folioweave.session import checkpointed

RRF_K = 60


def asked_terms(question: str) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]+", question.lower())))


def bm25(chunks: DataFrame, question: str, k: int, key: str = "chunk_id", index: TextIndex | None = None, keep: Keep | None = None) -> DataFrame:
    """key, score, rank of the best k rows for the terms of a question; statistics are those of ``chunks``.

    With an index only the postings of the question's terms are read; ``keep``, the filter that has made
    ``chunks``, says which of them count, or else the keys of ``chunks``. Without an index a pass over
    the texts counts the terms where the texts lie.
    """
    asked = asked_terms(question)
    if not asked:
        return chunks.select(F.col(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    if index is not None and keep is not None:
        return index.best(asked, k, keep)
    if index is not None:
        return top(index.scores(asked, chunks.select(key)), k, key)
    low = chunks.select(key, F.lower("text").alias("low"))
    # the word itself comes first: looking back at every position costs twice the time
    found = lambda t: F.regexp_count("low", F.lit(rf"{t}(?<![\p{{L}}\p{{N}}]{t})(?![\p{{L}}\p{{N}}])"))
    # a few numbers a text, read twice below
    counted = checkpointed(low.select(key, F.regexp_count("low", F.lit(TERM)).alias("length"), *[found(t).alias(f"tf{i}") for i, t in enumerate(asked)]))
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))])
    score = F.lit(0.0)
    for i in range(len(asked)):
        score = score + weight(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("length"), F.col("n"), F.col("mean"))
    hits = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(asked))))
    return top(hits.join(F.broadcast(stats)).select(key, F.round(score, 9).alias("score")), k, key)  # stats is one row


def cosine(vector: Column, query: list[float]) -> Column:
    """Dot product with a unit query; both are unit vectors."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id") -> DataFrame:
    """key, score, rank of the k vectors with the largest product, by brute force."""
    best = vectors.select(key, F.round(cosine(F.col("vector"), query), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


def fuse(*ranked: DataFrame, key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: the sum of 1 / (k + rank)."""
    out = ranked[0].select(key, "rank")
    for r in ranked[1:]:
        out = out.unionByName(r.select(key, "rank"))
    return out.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def top(rows: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    return best_of(rows, k, key)


def hybrid(chunks: DataFrame, question: str | None, query: list[float], k: int, condition: Column | None = None, use_text: bool = True, index: TextIndex | None = None, keep: Keep | None = None) -> DataFrame:
    """The best k by both rankings, filtered before ranking; without a question by vectors alone."""
    if condition is not None:
        chunks = chunks.where(condition)
    dense = nearest(chunks.where("vector is not null"), query, k)
    if not use_text or not (question or "").strip():
        return dense
    return top(fuse(dense, bm25(chunks, question, k, index=index, keep=keep)), k)


def merge_candidates(*lists: DataFrame) -> DataFrame:
    """Candidate lists in order of priority; a later list gives no rows of documents that an earlier one has."""
    out = None
    for priority, rows in enumerate(lists):
        rows = rows.withColumn("priority", F.lit(priority))
        out = rows if out is None else out.unionByName(rows.join(out.select("doc_id").distinct(), "doc_id", "left_anti"))
    return out


#: A function of a list of texts that returns a matrix of unit vectors.
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic stand-in for a model: signed hashes of words, mean-pooled, of unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % dim] += 1.0 if h >> 16 & 1 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embed(rows: DataFrame, make: Callable[[], Embedder], text: str = "text", prefix: str = "passage: ", batch: int = 32) -> DataFrame:
    """``rows`` with a vector of each text; a worker makes its model once and feeds it small batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = [prefix + (x or "") for x in part]
            vectors = [v for at in range(0, len(texts), batch) for v in model(texts[at : at + batch])]
            yield pd.Series(vectors)

    return rows.withColumn("vector", run(F.col(text)))


def rerank(rows: DataFrame, question: str, score: Callable[[str, list[str]], list[float]], k: int) -> DataFrame:
    """The best k candidates by a pair model; a row's own score stays as it is."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score(question, texts.fillna("").tolist()), dtype="float64")

    scored = rows.withColumn("relevance", run(F.col("text"))).orderBy(F.desc("relevance"), "chunk_id").limit(k)
    return scored.withColumn("rank", F.row_number().over(W.orderBy(F.desc("relevance"), "chunk_id")))
