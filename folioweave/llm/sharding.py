"""Byte-balanced shards by Karmarkar-Karp differencing; equal texts stay together.

A partial partition is a vector of ``shards`` sums. Differencing takes the two with the largest
spread and adds them oppositely ordered, the largest sum of one to the smallest of the other, until
one is left; walking the merges back gives every group its shard.

Groups of at least ``1 / LARGE`` of all bytes, of which there are at most ``LARGE``, are differenced
together first. The others are dealt by hash into blocks of about ``BLOCK`` groups; each block
starts from its share of the first result's sums, so that the shard of a giant group is spared in
every block alike, and differences its own groups against them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioweave.llm.common import cut, text_key

SHARDS = 40
LARGE = 10_240
BLOCK = 20_000
ROW_BYTES = 16


def difference(sizes: np.ndarray, shards: int, start: np.ndarray | None = None) -> np.ndarray:
    """The shard of each size; ``start`` are sums that the shards have already."""
    n = len(sizes)
    leaves = n + (start is not None)
    if not leaves:
        return np.zeros(0, np.int64)
    sums = np.zeros((2 * leaves - 1, shards), np.float64)
    sums[:n, 0] = sizes
    order = np.arange(shards)
    if start is not None:
        order = np.argsort(-start, kind="stable")
        sums[n] = start[order]
    spread = sums[:leaves, 0] - sums[:leaves, -1]
    heap = [(-s, i) for i, s in enumerate(spread.tolist())]
    heapq.heapify(heap)
    merges = np.zeros((leaves - 1, 2), np.int64)
    places = np.zeros((leaves - 1, shards), np.int16)
    for at in range(leaves - 1):
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        both = sums[a] + sums[b][::-1]
        place = np.argsort(-both, kind="stable")
        merges[at], places[at] = (a, b), place
        both = both[place]
        sums[leaves + at] = both
        heapq.heapreplace(heap, (both[-1] - both[0], leaves + at))
    label = np.zeros((2 * leaves - 1, shards), np.int16)
    label[-1] = np.arange(shards)
    for at in range(leaves - 2, -1, -1):
        (a, b), place = merges[at], places[at]
        label[a][place] = label[leaves + at]
        label[b][shards - 1 - place] = label[leaves + at]
    if start is None:
        return label[:n, 0].astype(np.int64)
    final = np.zeros(shards, np.int64)
    final[label[n]] = order
    return final[label[:n, 0]]


def shard_groups(groups: DataFrame, shards: int) -> DataFrame:
    """key, shard from one row for each group: key, bytes."""
    groups = cut(groups)
    n, total = groups.agg(F.count("*"), F.sum("bytes")).first()
    total = total or 0
    limit = max(1, total // LARGE)

    def large(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        return pd.DataFrame({"key": pdf["key"], "shard": difference(pdf["bytes"].to_numpy(), shards), "bytes": pdf["bytes"]})

    # at most LARGE rows, one group of them
    first = cut(groups.where(F.col("bytes") >= limit).groupBy(F.lit(0).alias("all")).applyInPandas(large, "key binary, shard int, bytes long"))
    sums = np.zeros(shards)
    for row in first.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():  # a row for each shard
        sums[row["shard"]] = row["bytes"]
    rest = total - sums.sum()

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        share = sums * (pdf["bytes"].sum() / max(rest, 1))
        return pd.DataFrame({"key": pdf["key"], "shard": difference(pdf["bytes"].to_numpy(), shards, share)})

    blocks = max(1, -(-n // BLOCK))
    dealt = groups.where(F.col("bytes") < limit).groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"))
    return first.select("key", "shard").unionByName(dealt.applyInPandas(small, "key binary, shard int"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs`` (doc_id, text).

    Size is the UTF-8 bytes of the text plus 16. Null and empty texts are one group. Slots count a
    shard's rows without gaps; rows that are equal in everything take theirs in any order. An empty
    table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = cut(docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), text_key(F.col("text")).alias("key")))
    placed = base.join(shard_groups(base.groupBy("key").agg(F.sum("size").alias("bytes")), shards), "key")
    # slots: the rows of a shard in hash buckets, each counted by itself and set off by those before it
    buckets = max(1, base.count() // BLOCK)
    placed = cut(placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int")))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "key"))
    numbered = placed.withColumn("nth", nth).join(offsets, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"))
