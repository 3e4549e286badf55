"""The document graph: building, similarity edges, ranking, communities, views."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioweave.functions import text as T
from folioweave.functions.folders import Principal, restrict
from folioweave.operators import moves
from folioweave.session import checkpointed

PERMUTATIONS, BANDS, ROWS = 128, 16, 8
PRIME = 4294967311
SEED = 1801


def node_key(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def first_layer(docs: DataFrame, chunks: DataFrame, both: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of indexed documents: folders, tags, issuers, own norms, references, supersession.

    ``docs``: doc_id, folder, file_name, tags, issuer, norm_id, superseded_by, status; ``chunks``:
    doc_id, text. Each relation is one projection; nodes are grouped once. Where ``both`` nodes and edges
    are used, what the texts refer to is written, so that they are searched once.
    """
    docs = docs.where("status = 'indexed'").withColumn("folder", F.coalesce("folder", F.lit("/")))
    doc = node_key("document", F.col("doc_id"))
    own = docs.select(doc.alias("src"), F.col("folder"), "doc_id", "tags", "issuer", "norm_id", "superseded_by", "file_name")
    tag = own.select("src", "folder", F.explode("tags").alias("label")).withColumn("key", T.fast_key(F.col("label"))).where("key <> ''")
    by = own.where("issuer is not null").select("src", "folder", F.col("issuer").alias("label"), T.fast_key(F.col("issuer")).alias("key")).where("key <> ''")
    norm = own.where("norm_id is not null").select("src", "doc_id", "superseded_by", "folder", F.col("norm_id").alias("label"), T.norm_key(F.col("norm_id")).alias("key")).where("key <> ''")
    # references are read where the texts lie: only they are shuffled, and meet documents by key, as these are too many to broadcast
    named = chunks.select("doc_id", F.explode(T.references(F.col("text"))).alias("ref"))
    named = checkpointed(named) if both else named
    refs = named.join(docs.select("doc_id", "folder").hint("merge"), "doc_id").select(doc.alias("src"), "folder", "ref")
    refs = refs.select("src", "folder", F.substring_index("ref", ":", 1).alias("kind"), F.col("ref").alias("tgt"), F.substring_index("ref", ":", -1).alias("key"))

    row = lambda df, kind, key, label: df.select(F.lit(kind).alias("node_type") if isinstance(kind, str) else kind.alias("node_type"), key.alias("canonical_key"), label.alias("label"), "folder", (F.col("doc_id") if kind == "document" else F.lit(None).cast("long")).alias("doc_id"))
    named = [
        row(own, "document", F.col("doc_id").cast("string"), F.coalesce("file_name", F.col("doc_id").cast("string"))), row(own, "folder", F.col("folder"), F.col("folder")), row(tag, "tag", F.col("key"), F.col("label")),
        row(by, "issuer", F.col("key"), F.col("label")), row(norm, "norm", F.col("key"), F.col("label")), refs.select(F.col("kind").alias("node_type"), F.col("key").alias("canonical_key"), F.col("key").alias("label"), "folder", F.lit(None).cast("long").alias("doc_id")),
    ]
    nodes = named[0]
    for n in named[1:]:
        nodes = nodes.unionByName(n)
    nodes = nodes.groupBy("node_type", "canonical_key").agg(F.min("label").alias("label"), F.array_sort(F.collect_set("folder")).alias("folder_paths"), F.max("doc_id").alias("doc_id"))
    nodes = nodes.select(F.concat_ws(":", "node_type", "canonical_key").alias("node_key"), "*")

    edge = lambda df, tgt, relation: df.select(F.col("src").alias("src_key"), tgt.alias("tgt_key"), F.lit(relation).alias("relation"))
    edges = edge(own, node_key("folder", F.col("folder")), "in_folder")
    for e in (edge(tag, node_key("tag", F.col("key")), "has_tag"), edge(by, node_key("issuer", F.col("key")), "issued_by"), edge(refs, F.col("tgt"), "references"), superseded(norm)):
        edges = edges.unionByName(e)
    return nodes, edges.distinct().withColumn("layer", F.lit("L1")).withColumn("w_eff", F.lit(1.0))


def superseded(norm: DataFrame) -> DataFrame:
    """Newer norm to older norm, by the document that supersedes; none to itself."""
    newer = norm.select(F.col("doc_id").alias("superseded_by"), node_key("norm", F.col("key")).alias("src_key"))
    older = norm.where("superseded_by is not null").select("superseded_by", node_key("norm", F.col("key")).alias("tgt_key"))
    return older.join(newer.hint("merge"), "superseded_by").where("src_key <> tgt_key").select("src_key", "tgt_key", F.lit("supersedes").alias("relation")).distinct()


def centroids(vectors: DataFrame) -> DataFrame:
    """doc_id and the mean of its vectors: positions are averaged with partial aggregation."""
    parts = vectors.select("doc_id", F.posexplode("vector").alias("pos", "x")).groupBy("doc_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector"))


def mutual_neighbours(centers: DataFrame, k: int = 8, least: float = 0.6, block: int = 2048) -> DataFrame:
    """src < dst, score: pairs that are among each other's k most similar with at least ``least`` (above 0).

    Exact, and pruned by the triangle inequality of angles (see ``neighbour_blocks``): each pair of blocks
    that may hold such a pair is one matrix product in one task, which passes on a row's best k only.
    """
    dealt, _ = neighbour_blocks(centers, least, block)

    def best(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        s = np.round(x @ y.T, 6)
        s[ids[:, None] == others[None, :]] = -2.0
        order = np.lexsort((np.broadcast_to(others, s.shape), -s), axis=1)[:, :k]
        i = np.repeat(np.arange(len(ids)), order.shape[1])
        out = pd.DataFrame({"src": ids[i], "dst": others[order.reshape(-1)], "score": s[i, order.reshape(-1)]})
        return out[out["score"] >= least]

    def pair(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows[rows["side"] == side] for side in (0, 1)]
        a, b = ((s["doc_id"].to_numpy(), np.stack(s["vector"].to_numpy()) if len(s) else np.zeros((0, 1))) for s in sides)
        none = pd.DataFrame({"src": pd.Series(dtype="int64"), "dst": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if key[0] == key[1]:
            return best(*a, *a)
        return pd.concat([best(*a, *b), best(*b, *a)]) if len(a[0]) and len(b[0]) else none

    found = dealt.groupBy("low", "high").applyInPandas(pair, "src long, dst long, score double")
    near = found.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst"))).where(F.col("rank") <= k).select("src", "dst", "score")
    back = near.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return near.where("src < dst").join(back, ["src", "dst"], "left_semi")


#: Cluster centres at most, the vectors they are chosen from, and how wide the rings are that a block is made of.
CENTRES, SAMPLE, RING = 1024, 8192, 0.02
_RINGS = int(np.pi / RING) + 2


def neighbour_blocks(centers: DataFrame, least: float, block: int = 2048) -> tuple[DataFrame, int]:
    """(low, high, side, doc_id, vector of unit length; number of blocks): the vectors dealt to the pairs of blocks in
    which they may have a neighbour with a product of ``least``.

    A vector belongs to the nearest of some centres, chosen far apart, and a cluster is cut into blocks of about ``block``
    vectors by the angle to its centre; a ring with more is dealt by a hash. A vector at an angle of t to a
    centre is at least t - b and a - t away from all vectors of a ring from a to b around it, so that
    it is held against the blocks only for which both are within the angle of ``least``.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    spark = centers.sparkSession
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = centers.select(F.col("doc_id").cast("long").alias("doc_id"), "vector", norm.alias("norm")).where("norm > 0").select("doc_id", F.transform("vector", lambda x: x.cast("double") / F.col("norm")).alias("vector"))
    unit = checkpointed(unit)
    n = unit.count()
    middle = _spread(np.array([r["vector"] for r in unit.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]), min(CENTRES, max(1, -(-n // block))))
    shared = spark.sparkContext.broadcast(middle)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = np.arccos(np.clip(_rows(batch.column(1)) @ shared.value.T, -1, 1))
            own = angle.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array((angle[np.arange(len(own)), own] / RING).astype(np.int32))], names=["doc_id", "vector", "centre", "ring"])

    placed = checkpointed(unit.mapInArrow(place, "doc_id long, vector array<double>, centre int, ring int")) if n else unit.selectExpr("*", "0 as centre", "0 as ring")
    counts = {(r["centre"], r["ring"]): r["count"] for r in placed.groupBy("centre", "ring").count().collect()}  # rings of the centres
    # blocks of a cluster: rings up to about ``block`` vectors, larger ones in parts
    first, parts, bounds = np.zeros((len(middle), _RINGS), np.int64), np.ones((len(middle), _RINGS), np.int64), []
    for c in range(len(middle)):
        held: list[int] = []
        for ring in range(_RINGS):
            size = sum(counts.get((c, r), 0) for r in held) + counts.get((c, ring), 0)
            if held and size > block:
                bounds += _closed(c, held, counts, first, parts, block, len(bounds))
                held = []
            held.append(ring)
        bounds += _closed(c, held, counts, first, parts, block, len(bounds))
    at = np.array(bounds, np.float64).reshape(-1, 3)  # centre, from, to
    reach = float(np.arccos(max(-1.0, least - 1e-6))) + 1e-6
    plan = spark.sparkContext.broadcast((middle, first, parts, at))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, first, parts, at = plan.value
        centre = at[:, 0].astype(np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):  # a vector may go to every block
                batch = whole.slice(lo, 64)
                ids, (c, ring) = batch.column(0).to_numpy(), (batch.column(i).to_numpy() for i in (2, 3))
                own = first[c, ring] + _mixed(ids) % parts[c, ring]
                angle = np.arccos(np.clip(_rows(batch.column(1)) @ middle.T, -1, 1))[:, centre]
                row, other = np.nonzero((np.maximum(angle - at[:, 2], at[:, 1] - angle) <= reach) | (np.arange(len(at)) == own[:, None]))
                mine = own[row]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(mine, other), pa.int32()), pa.array(np.maximum(mine, other), pa.int32()), pa.array((mine > other).astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["low", "high", "side", "doc_id", "vector"])

    return placed.mapInArrow(deal, "low int, high int, side int, doc_id long, vector array<double>"), len(at)


def _spread(sample: np.ndarray, count: int) -> np.ndarray:
    """The first vector, then each time the one that is farthest from those chosen."""
    if not len(sample):
        return sample
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _mixed(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)


def _closed(c: int, held: list[int], counts: dict, first: np.ndarray, parts: np.ndarray, block: int, at: int) -> list[tuple[int, float, float]]:
    """The blocks of these rings of a centre, from number ``at`` on; where they start, and how many they are."""
    size = sum(counts.get((c, r), 0) for r in held)
    if not size:
        return []
    full = [r for r in held if (c, r) in counts]
    n = -(-size // block)
    first[c, held], parts[c, held] = at, n
    return [(c, full[0] * RING - 1e-6, (full[-1] + 1) * RING + 1e-6)] * n


def shingles(text, words: int = 5):
    """The distinct runs of words of a text; a shorter text is one run."""
    parts = F.filter(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+"), lambda w: w != "")
    # bound as a lambda's variable: an expression inside a lambda is evaluated for each element
    run = lambda p: lambda w, i: F.concat_ws(" ", w, *[F.get(p, i + k) for k in range(1, words)])
    runs = lambda p: F.array_distinct(F.slice(F.transform(p, run(p)), 1, F.greatest(F.size(p) - words + 1, F.lit(1))))
    return F.get(F.transform(F.array(parts), runs), F.lit(0))


def similar_texts(docs: DataFrame, least: float = 0.8, but: DataFrame | None = None) -> DataFrame:
    """src < dst, jaccard of the texts (id, text; each text once, the rows ``but``, by id, aside) that share enough
    of their shingles.

    Two sets with a Jaccard of ``least`` share one of the rarest n - ceil(least n) + 1 shingles of
    either: texts meet by these alone, so that a passage which many share brings no pairs together
    unless it is most of a text. Whole sets decide. ``docs`` is read three times and neither texts nor
    all shingles are written or shuffled: only the rarest, by their hashes, and the texts that meet. A
    table so small that it has fewer parts than there are cores is dealt out first.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.select("id", "text")
    docs = checkpointed(docs.repartition(cores)) if docs.rdd.getNumPartitions() < cores else docs
    words = shingles(F.col("text"))
    own = docs.select("id", F.array_distinct(F.transform(words, lambda g: F.xxhash64(g))).alias("h"), F.size(words).alias("n")).where("n > 0")
    shared = _rarest(own, least).withColumn("df", F.count("*").over(W.partitionBy("s"))).where("df > 1").drop("df")
    shared = checkpointed(shared if but is None else shared.join(but.select("id"), "id", "left_anti"))
    left, right = shared.select(F.col("id").alias("src"), F.col("n").alias("a"), F.col("p").alias("i"), "s"), shared.select(F.col("id").alias("dst"), F.col("n").alias("b"), F.col("p").alias("j"), "s")
    met = left.join(right, "s").where((F.col("src") < F.col("dst")) & (F.least("a", "b") >= F.greatest("a", "b") * least - 1e-9))
    # besides these, two texts may share what either has after the last of them
    met = met.groupBy("src", "dst").agg(F.count("*").alias("k"), F.max("a").alias("a"), F.max("b").alias("b"), F.max("i").alias("i"), F.max("j").alias("j"))
    met = checkpointed(met.where((F.col("k") + F.least(F.col("a") - F.col("i"), F.col("b") - F.col("j")) - 1) * (1 + least) >= (F.col("a") + F.col("b")) * least - 1e-6).select("src", "dst"))
    ids = checkpointed(met.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    # a bounded number of ids goes to where the texts lie
    ids = F.broadcast(ids) if ids.count() <= MET_IDS else ids.hint("merge")
    texts = checkpointed(docs.select("id", "text").join(ids, "id", "left_semi"))
    # texts are sent to the pairs, a fifth of their shingles' size; whole shingles decide
    sides = met.join(texts.select(F.col("id").alias("src"), F.col("text").alias("x")), "src").join(texts.select(F.col("id").alias("dst"), F.col("text").alias("y")), "dst")
    sides = sides.select("src", "dst", shingles(F.col("x")).alias("x"), shingles(F.col("y")).alias("y"))
    # written, as a filter on the score would be pushed below and make the shingles once more
    sides = checkpointed(sides.select("src", "dst", F.size("x").alias("a"), F.size("y").alias("b"), F.size(F.array_intersect("x", "y")).alias("both")))
    return sides.select("src", "dst", (F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("jaccard")).where(F.col("jaccard") >= least - 1e-9)


#: Ids of texts that meet others which are broadcast to the texts, at most.
MET_IDS = 1 << 20

#: Cells in which shingles are counted by their hash, and how many of the fullest the order of shingles knows.
CELLS, KNOWN = 1 << 20, 1 << 16
#: Parts in which tasks pass on what they have counted in the cells.
_CELL_PARTS = 64


def _rarest(own: DataFrame, least: float) -> DataFrame:
    """id, n, s, p: the first n - ceil(least n) + 1 of a text's shingles (hashes ``h``) in an order that all texts share,
    and their places in it.

    Any such order finds all pairs; one from rare to frequent finds few others. So shingles in fuller cells
    come last, by the binary logarithm of how full they are, and the others first, by hash: a text is
    ordered where it lies, and only what comes first is shuffled. Collisions of hashes within a text
    leave it fewer hashes than n; it then passes on as many more, with places so far ahead that they rule out no pair.
    """
    k = _cells(own)
    fullest = np.flatnonzero(k > 1.2 * k.sum() / CELLS + 64)
    fullest = fullest[np.argsort(-k[fullest], kind="stable")][:KNOWN]
    weight = np.zeros(CELLS, np.int8)
    weight[fullest] = np.log2(k[fullest]).astype(np.int8)
    shared = own.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            h, n = batch.column(2).flatten().to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            sizes = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(len(n)), sizes)
            order = np.lexsort((h, shared.value[h & (CELLS - 1)], row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = place < (n - np.ceil(n * least - 1e-9) + 1 + (n - sizes))[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first])), pa.array(n[row[first]], pa.int64()), pa.array(h[order][first]), pa.array((place - np.where(n == sizes, 0, 1 << 30)[row])[first], pa.int32())], names=["id", "n", "s", "p"])

    return own.select("id", F.col("n").cast("long").alias("n"), "h").mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, n long, s long, p int")


def _cells(own: DataFrame) -> np.ndarray:
    """How many shingles are in each cell; a task passes on its counts packed, about a byte each."""
    cells, parts = CELLS, min(CELLS, _CELL_PARTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.zeros(cells, np.int64)
        for batch in batches:
            k += np.bincount(batch.column(0).flatten().to_numpy() & (cells - 1), minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(k, parts)], pa.binary())], names=["part", "k"])

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.zeros(cells // parts, np.int64)
        for batch in rows:
            for x in batch.column(1):
                k += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([k.tobytes()], pa.binary())], names=["part", "k"])

    added = own.select("h").mapInArrow(count, "part int, k binary").groupBy("part").applyInArrow(add, "part int, k binary").collect()  # 8 bytes a cell
    return np.concatenate([np.frombuffer(r["k"], np.int64) for r in sorted(added)] or [np.zeros(cells, np.int64)])


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**32, size=PERMUTATIONS, dtype=np.uint64), rng.integers(0, 2**32, size=PERMUTATIONS, dtype=np.uint64)


#: White space in the sense of ``shingles``.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def signature(text: str, a: np.ndarray, b: np.ndarray, words: int = 5) -> np.ndarray | None:
    """The least value of each permutation over the CRC-32 of a text's shingles; none without words."""
    parts = [x.encode() for x in _SPACE.split(text) if x]
    if not parts:
        return None
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum([len(x) + 1 for x in parts]) - 1
    starts = np.append(0, ends[:-1] + 1)[: max(1, len(parts) - words + 1)]
    hashes = np.unique(np.fromiter((zlib.crc32(joined[i:j]) for i, j in zip(starts.tolist(), ends[-len(starts) :].tolist(), strict=True)), np.uint64, len(starts)))
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        x = a[:, None] * hashes[None, at : at + 1024] + b[:, None]
        np.minimum(least, (x - x // np.uint64(PRIME) * np.uint64(PRIME)).min(1), out=least)
    return least.astype(np.int64)


def minhash(docs: DataFrame) -> DataFrame:
    """doc_id and signature (array of 128 longs) of every document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations()
        for batch in batches:
            signed = [signature(x.as_py() or "", a, b) for x in batch.column(1)]
            kept = [i for i, x in enumerate(signed) if x is not None]
            flat = np.concatenate([np.zeros(0, np.int64), *(signed[i] for i in kept)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, PERMUTATIONS, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), lists], names=["doc_id", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, signature array<long>")


#: Signatures in a bucket of a band up to which all its pairs are candidates, and how often a larger one is split.
HOT, SPLITS = 64, 3


def near_duplicates(docs: DataFrame, least: float = 0.85) -> DataFrame:
    """src < dst, score (estimated Jaccard) by banded MinHash.

    Documents with equal signatures are one class: only class representatives, of unlike
    signatures, meet in the buckets of a band, and a class's other members are linked to its
    representative, so that a large group of copies costs its size.
    """
    signed = checkpointed(minhash(docs))
    classes = checkpointed(signed.groupBy("signature").agg(F.min("doc_id").alias("first")))
    copies = signed.join(classes, "signature").where("doc_id <> first").select(F.col("first").alias("src"), F.col("doc_id").alias("dst"), F.lit(1.0).alias("score"))
    pairs = band_pairs(classes, least)
    sides = pairs.join(classes.select(F.col("first").alias("src"), F.col("signature").alias("x")), "src").join(classes.select(F.col("first").alias("dst"), F.col("signature").alias("y")), "dst")
    score = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda e: e)) / PERMUTATIONS
    return sides.select("src", "dst", score.alias("score")).where(F.col("score") >= least).unionByName(copies)


def band_pairs(classes: DataFrame, least: float = 0.85) -> DataFrame:
    """src < dst: pairs of signatures (first, signature) that share a band and may have ``least`` of all values alike.

    A bucket with more than ``HOT`` signatures isn't joined with itself. Signatures that are alike
    enough differ in ``d`` places at most; the places that a bucket doesn't share yet are cut into
    d + 1 groups, and such a pair has one group wholly alike. So the bucket is split by each group's
    values, and what is still large once more, ``SPLITS`` times at most: no pair is lost, and texts that
    share a passage only don't meet.
    """
    groups = int((1 - least) * PERMUTATIONS + 1e-9) + 1
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(F.array(i).alias("path"), F.xxhash64(i, F.slice("signature", i * ROWS + 1, ROWS)).alias("key")))
    dealt = classes.select("first", F.explode(bands).alias("b")).select("first", "b.path", "b.key")
    # what a split takes from the places of a bucket: those of a band, then those of a group
    taken, pairs = [ROWS], None
    for split in range(SPLITS + 1):
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        sized = checkpointed(dealt.join(sizes, "key"))
        few = (sized.where(F.col("n") <= HOT) if split < SPLITS else sized).select("key", "first")
        met = few.select("key", F.col("first").alias("src")).join(few.select("key", F.col("first").alias("dst")), "key").where("src < dst").select("src", "dst")
        pairs = met if pairs is None else pairs.unionByName(met)
        hot = sized.where(F.col("n") > HOT).select("first", "path", "key")
        if split == SPLITS or hot.isEmpty():
            break
        rest, left = F.col("signature"), PERMUTATIONS
        for i, size in enumerate(taken):
            rest, left = _without(rest, F.get("path", F.lit(i)) * size, F.lit(size)), left - size
        size = left // groups  # the last group has what is left over as well
        whole = hot.join(classes, "first").select("first", "path", "key", rest.alias("rest"))
        piece = lambda i, m=left, s=size: F.when(i == groups - 1, F.lit(m - s * (groups - 1))).otherwise(F.lit(s))
        each = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda i: F.struct(F.concat("path", F.array(i)).alias("path"), F.xxhash64("key", i, F.slice("rest", i * size + 1, piece(i))).alias("key")))
        dealt = whole.select("first", F.explode(each).alias("b")).select("first", "b.path", "b.key")
        taken.append(size)
    return pairs.distinct()


def _without(values: F.Column, start: F.Column, count: F.Column) -> F.Column:
    """An array without ``count`` values from a place on."""
    return F.concat(F.slice(values, F.lit(1), start), F.slice(values, start + count + 1, F.size(values)))


def replace_layer(edges: DataFrame, layer: str, new: DataFrame) -> DataFrame:
    return edges.where(F.col("layer") != layer).unionByName(new)


def second_layer(pairs: DataFrame, relation: str) -> DataFrame:
    a, b = node_key("document", F.col("src")), node_key("document", F.col("dst"))
    score = F.round("score", 4)
    return pairs.select(F.least(a, b).alias("src_key"), F.greatest(a, b).alias("tgt_key"), F.lit(relation).alias("relation"), F.lit("L2").alias("layer"), score.alias("w_eff"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes over old ones by key; analytics of old nodes stay, and old nodes that are gone too."""
    stay = old.select("node_key", "pagerank", "community_id", "participation")
    gone = old.join(new.select("node_key"), "node_key", "left_anti")
    return new.join(stay, "node_key", "left").unionByName(gone, allowMissingColumns=True)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """node_key, pagerank: power iteration; parallel edges add up, dangling mass is spread evenly."""
    start = nodes.select("node_key").distinct().withColumn("p", F.lit(None).cast("double"))
    n = max(1, start.count())
    return _walk(start.withColumn("p", F.lit(1.0 / n)), edges.select("src_key", "tgt_key", F.coalesce(F.nullif("w_eff", F.lit(0.0)), F.lit(1.0)).alias("w")), damping, rounds, tolerance).select("node_key", F.col("r").alias("pagerank"))


def personalised(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, restart: float = 0.15, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """node_key, score: walks over undirected edges that restart at the seeds (node_key)."""
    k = max(1, seeds.count())
    start = nodes.select("node_key").distinct().join(seeds.select("node_key", F.lit(1.0 / k).alias("p")), "node_key", "left").select("node_key", F.coalesce("p", F.lit(0.0)).alias("p"))
    w = F.coalesce(F.nullif("w_eff", F.lit(0.0)), F.lit(1.0)).alias("w")
    both = edges.select("src_key", "tgt_key", w).unionByName(edges.select(F.col("tgt_key").alias("src_key"), F.col("src_key").alias("tgt_key"), w))
    return _walk(start, both, 1 - restart, rounds, tolerance).select("node_key", F.col("r").alias("score"))


#: Rows from which on a written table is not broadcast: its compressed files say too little of the memory that takes.
SENT_ROWS = 1 << 18


def by_key(table: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows, which joins do not broadcast if they are many, however small its files."""
    return table.hint("merge") if rows > SENT_ROWS else table


#: A walk's changed ranks are broadcast to the edges up to this size, all rounds together.
_FRONT_BYTES = 64 << 20


def _walk(start: DataFrame, edges: DataFrame, keep: float, rounds: int, tolerance: float, moved: list[int] | None = None) -> DataFrame:
    """r = (1 - keep) p + keep (M r + dangling p), until it changes by less than the tolerance.

    After the first round only changes walk on: what a node has gained (``due``) since it last passed
    something on goes along its edges, r grows by what arrives. A change too small to matter waits
    until more has come: all that waits adds up to less than half the tolerance in r, so that a
    tolerance of 0 passes every change on and gives each round of the power iteration. The nodes of a
    round are broadcast to the edges while their keys take less than ``_FRONT_BYTES``, so that no
    edge is shuffled; once the rounds so far have sent that much, both are joined by key, and Spark
    isn't left to broadcast either: what passes the driver doesn't grow with rounds times nodes. Nor are
    all nodes broadcast to the edges, which Spark would do by the size of their compressed files.
    ``moved`` gets the nodes that passed on.
    """
    start = checkpointed(start)
    nodes, bytes_ = start.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("node_key") + 32), F.lit(0))).first()
    start, large = by_key(start, nodes), bytes_ > _FRONT_BYTES // 64
    edges = edges.join(start.select(F.col("node_key").alias("src_key")), "src_key", "left_semi").join(start.select(F.col("node_key").alias("tgt_key")), "tgt_key", "left_semi")
    edges = checkpointed(edges.groupBy("src_key", "tgt_key").agg(F.sum("w").alias("w")))
    out = by_key(edges.groupBy("src_key").agg(F.sum("w").alias("total")), nodes)
    shares = checkpointed(edges.join(out, "src_key").select(F.col("src_key").alias("node_key"), "tgt_key", (F.col("w") / F.col("total")).alias("share")))
    sources = by_key(shares.select("node_key", F.lit(True).alias("flows")).distinct(), nodes)
    least = tolerance * (1 - keep) / (2 * max(1, nodes))
    active = F.abs(F.col("due")) > least
    passed = F.when(active, F.col("due")).otherwise(F.lit(0.0))
    sends = active & F.col("flows")

    def kept(df: DataFrame) -> tuple[DataFrame, dict]:
        """The ranks written, and what the driver needs of them, summed while they are written."""
        seen = Observation()
        sums = F.coalesce(F.sum(F.when(~F.col("flows"), passed)), F.lit(0.0)).alias("lost"), F.coalesce(F.sum(F.abs("due")), F.lit(0.0)).alias("change"), F.count_if(sends).alias("count"), F.coalesce(F.sum(F.when(sends, F.octet_length("node_key") + 32)), F.lit(0)).alias("size")
        return checkpointed(df.observe(seen, *sums)), seen.get

    ranks, sums = kept(start.join(sources, "node_key", "left").select("node_key", "p", F.coalesce("flows", F.lit(False)).alias("flows"), F.col("p").alias("r"), F.col("p").alias("due")))
    sent = 0
    for turn in range(rounds):
        if turn and sums["change"] < tolerance or not sums["count"] and not sums["lost"]:
            break
        if moved is not None:
            moved.append(sums["count"])
        front = ranks.where(sends).select("node_key", "due")
        sent += sums["size"]
        into = shares.join(F.broadcast(front) if sent < _FRONT_BYTES else front.hint("merge"), "node_key").groupBy("tgt_key").agg(F.sum(F.col("due") * F.col("share")).alias("gain"))
        arrived = keep * (F.coalesce("gain", F.lit(0.0)) + sums["lost"] * F.col("p"))
        into = into.hint("merge") if large else into
        step = ranks.join(into, ranks["node_key"] == into["tgt_key"], "left").withColumn("arrived", arrived)
        left = 1.0 if turn else 1 - keep  # the walk starts with all of p, of which a part comes back each round
        ranks, sums = kept(step.select("node_key", "p", "flows", (left * F.col("r") + F.col("arrived")).alias("r"), (left * F.col("due") - passed + F.col("arrived")).alias("due")))
    return ranks.drop("due")


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of nodes once in either direction with its summed weight; loops aside."""
    w = F.coalesce(F.nullif("w_eff", F.lit(0.0)), F.lit(1.0))
    pairs = edges.where("src_key <> tgt_key").groupBy(F.least("src_key", "tgt_key").alias("a"), F.greatest("src_key", "tgt_key").alias("b")).agg(F.sum(w).alias("w"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "w").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "w"))


def participation(members: DataFrame, edges: DataFrame) -> DataFrame:
    """node_key, participation from ``members`` (node_key, community_id): 1 - sum (k_c / k)^2."""
    own = undirected(edges).join(members.hint("merge").select(F.col("node_key").alias("other"), "community_id"), "other")  # all nodes: not broadcast
    k = own.groupBy("node", "community_id").agg(F.sum("w").alias("k")).groupBy("node").agg((1 - F.sum(F.col("k") ** 2) / F.sum("k") ** 2).alias("participation"))
    return members.select("node_key").join(k, F.col("node_key") == F.col("node"), "left").select("node_key", F.coalesce("participation", F.lit(0.0)).alias("participation"))


def conductance(members: DataFrame, edges: DataFrame) -> DataFrame:
    """community_id, conductance: cut over the smaller volume; null where a side has none."""
    members = members.hint("merge")  # all nodes: not broadcast
    e = undirected(edges).join(members.select(F.col("node_key").alias("node"), "community_id"), "node").join(members.select(F.col("node_key").alias("other"), F.col("community_id").alias("other_id")), "other")
    volume = e.groupBy("community_id").agg(F.sum("w").alias("volume"), F.sum(F.when(F.col("community_id") != F.col("other_id"), F.col("w")).otherwise(0.0)).alias("cut"))
    total = e.agg(F.sum("w").alias("total"))
    least = F.least(F.col("volume"), F.col("total") - F.col("volume"))
    scored = volume.join(F.broadcast(total)).select("community_id", F.when(least > 0, F.col("cut") / least).alias("conductance"))  # total is one row
    return members.select("community_id").distinct().join(scored, "community_id", "left")


def describe_communities(members: DataFrame, ranks: DataFrame) -> DataFrame:
    """community_id, size, label (of the highest ranked member) and a fingerprint of the members.

    Members stream through their task in order: no community is held whole. Each counts once.
    """
    joined = members.select("community_id", "node_key").distinct().join(ranks.hint("merge"), "node_key")  # all nodes: not broadcast
    kind = members.schema["community_id"].dataType
    rows = joined.select("community_id", "node_key", "pagerank").repartition("community_id").sortWithinPartitions("community_id", "node_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, best, digest = None, 0, None, None
        row = lambda: pa.RecordBatch.from_arrays([at, pa.array([size]), pa.array([best[1].partition(":")[2]]), pa.array([digest.hexdigest()])], names=["community_id", "size", "label", "member_fingerprint"])
        for batch in batches:
            keys, ranked = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, community in enumerate(batch.column(0).to_pylist()):
                if digest is None or community != at[0].as_py():
                    if digest is not None:
                        yield row()
                    at, size, best, digest = batch.column(0).slice(i, 1), 0, None, hashlib.sha1()
                digest.update((("\x1f" if size else "") + keys[i]).encode())
                rank = (ranked[i] is not None, ranked[i] or 0.0, keys[i])
                size, best = size + 1, max(best or (rank, keys[i]), (rank, keys[i]))
        if digest is not None:
            yield row()

    return rows.mapInArrow(run, f"community_id {kind.simpleString()}, size long, label string, member_fingerprint string")


#: Links of a node up to which it is held against others for the same links.
ALIKE = 64

#: Nodes, and links of classes to communities, up to which one task ends the rounds of a level.
FEW_NODES, FEW_LINKS = 4 << 20, 8 << 20


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_key, community_id: modularity is climbed by local moves, then communities become nodes.

    Levels follow until none moves a node. Isolated nodes stay alone. Nodes with the same links are
    weighed as one as long as they lie in the same community, and moved one by one (see ``_alike``).
    """
    links = checkpointed(undirected(edges))
    own = checkpointed(links.groupBy("node").agg(F.sum("w").alias("k"), F.count("*").alias("links")))
    total, count = own.agg(F.coalesce(F.sum("k"), F.lit(0.0)), F.count("*")).first()
    rows, links, own = count, by_key(links, count), by_key(own, count)
    members = own.select(F.col("node").alias("node_key"), "node")
    while count:
        place, between = _alike(links, own, rows)
        at, held, moved = _local_moves(between, place, total, total / count, rows)
        if not moved:
            break
        members = by_key(checkpointed(members.join(at.select("node", "c"), "node").select("node_key", F.col("c").alias("node"))), count)
        ends = between.join(held.select("q", F.col("c").alias("a"), "n"), "q").join(held.select(F.col("q").alias("p"), F.col("c").alias("b"), F.col("n").alias("m")), "p")
        links = checkpointed(ends.where("a <> b").groupBy(F.col("a").alias("node"), F.col("b").alias("other")).agg(F.sum(F.col("w") * F.col("n") * F.col("m")).alias("w")))
        size = held.groupBy(F.col("c").alias("node")).agg(F.sum(F.col("n") * F.col("k")).alias("k"))
        own = checkpointed(size.join(links.groupBy("node").agg(F.count("*").alias("links")), "node", "left").select("node", "k", F.coalesce("links", F.lit(0)).alias("links")))
        rows = own.count()
        links, own = by_key(links, rows), by_key(own, rows)
    named = members.groupBy("node").agg(F.min("node_key").alias("community_id"))
    placed = members.join(named, "node").select("node_key", "community_id")
    return nodes.select("node_key").distinct().join(placed, "node_key", "left").select("node_key", F.coalesce("community_id", "node_key").alias("community_id"))


def _alike(links: DataFrame, own: DataFrame, rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """(node, k, q), the class of each node, named by its first; (q, p, w), the links of classes: all nodes of q with all of p.

    A class is what has the same k and the same links; nodes with more than ``ALIKE`` links are classes
    of their own, so that no list is long. No node is linked with one of its class. There are about ``rows`` nodes.
    """
    many = checkpointed(own.where(F.col("links") > ALIKE).select("node", "k"))
    many = by_key(many, many.count())
    few = own.where(F.col("links") <= ALIKE).select("node", "k")
    lists = links.join(many, "node", "left_anti").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("other", "w"))).alias("to"))
    keyed = by_key(checkpointed(few.join(lists, "node", "left").select("node", "k", F.sha2(F.to_json(F.struct("k", "to")), 256).alias("key"))), rows)
    first = by_key(checkpointed(keyed.groupBy("key").agg(F.min("node").alias("q"))), rows)
    place = by_key(checkpointed(keyed.join(first, "key").select("node", "k", "q").unionByName(many.select("node", "k", F.col("node").alias("q")))), rows)
    near = links.join(first.select(F.col("q").alias("node")), "node", "left_semi").join(place.select(F.col("node").alias("other"), F.col("q").alias("p")), "other").select(F.col("node").alias("q"), "p", "w")
    hubs = links.join(many.select("node"), "node", "left_semi").join(many.select(F.col("node").alias("other")), "other", "left_semi").select(F.col("node").alias("q"), F.col("other").alias("p"), "w")
    pairs = near.unionByName(near.select(F.col("p").alias("q"), F.col("q").alias("p"), "w")).unionByName(hubs)
    return place, by_key(checkpointed(pairs.groupBy("q", "p").agg(F.max("w").alias("w"))), rows)


def _local_moves(links: DataFrame, place: DataFrame, total: float, unit: float, rows: int = 0) -> tuple[DataFrame, DataFrame, bool]:
    """(node, k, q, c; q, k, c and how many of a class are there; whether any moved) once no node gains by a move
    to a neighbouring community.

    In each round communities have one of two colours, and nodes move from givers to takers only. No
    node then moves to a community that a neighbour leaves, so that the links count at least what the
    single moves promise; what the moves change in the volumes together is added up by community, and
    nodes whose joint move would cost more than it gains wait by a hash. A round whose gain isn't
    certain is replaced by the moves that are best for both communities they touch: their gains add up,
    and one at least is there, so that the rounds end.

    What a move gains depends on a node's class and community alone. So moves are weighed by class
    and community, and nodes are only read to be moved and counted.

    Rounds join communities, so that there is less to weigh: once it is at most ``FEW_LINKS`` links of
    at most ``FEW_NODES`` nodes, the other rounds, which are many, are reckoned in one task by the same
    rules (see ``moves``) instead of as some ten small jobs each.
    """
    at, turn, moved, careful = place.withColumn("c", F.col("node")), 0, False, False
    held = at.select("q", "k", "c", F.lit(1).alias("n"))
    degree = by_key(checkpointed(links.groupBy("q").agg(F.count("*").alias("links"))), rows)
    few = place.count() <= FEW_NODES
    while True:
        if few and held.join(degree, "q").agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0] <= FEW_LINKS:
            return _settled(links, at, total, unit, turn, careful, rows)
        seen = Observation()
        wanted = by_key(checkpointed(_wanted(links, held, total, unit).observe(seen, F.count("*").alias("count"))), rows)
        if not seen.get["count"]:
            return at, held, moved
        chosen = _disjoint(_last(wanted, at)) if careful else _thinned(_between_colours(wanted, turn), total)
        draw = F.pmod(F.xxhash64("node", F.lit(SEED - turn)), F.lit(1 << 20)) / (1 << 20)
        goes = F.col("node") == F.col("last") if careful else draw < F.col("share")
        chosen = chosen.select("q", F.col("own").alias("before"), F.col("c").alias("to"), "links_gain", "last" if careful else "share")
        tried = at.withColumnRenamed("c", "before").join(chosen, ["q", "before"], "left").withColumn("goes", F.coalesce(goes, F.lit(False)))
        tried = by_key(checkpointed(tried.select("node", "k", "q", F.when(F.col("goes"), F.col("to")).otherwise(F.col("before")).alias("c"), "before", F.when(F.col("goes"), F.col("links_gain")).alias("links_gain"))), rows)
        counts = by_key(checkpointed(tried.groupBy("q", "k", "before", "c").agg(F.count("*").alias("n"), F.max("links_gain").alias("links_gain"))), rows)
        # moves that are best for both of their communities rise by their gains, whatever the sums' last digits
        if careful or _gain(counts, total) > 1e-9 * unit:
            at, moved, careful = tried.select("node", "k", "q", "c"), True, False
            held = counts.groupBy("q", "k", "c").agg(F.sum("n").alias("n"))
        else:
            careful = True
        turn += 1


def _settled(links: DataFrame, at: DataFrame, total: float, unit: float, turn: int, careful: bool, n: int = 0) -> tuple[DataFrame, DataFrame, bool]:
    """What ``_local_moves`` returns, its rounds from a turn on reckoned in one task."""
    rows = at.select("node", "q", "c", "k", F.xxhash64("node").alias("h")).unionByName(links.select(F.lit(None).cast("string").alias("node"), "q", F.col("p").alias("c"), F.col("w").alias("k"), F.lit(None).cast("long").alias("h")))
    end = by_key(checkpointed(rows.coalesce(1).mapInArrow(lambda batches: moves.settled(batches, total, unit, SEED, turn, careful), "node string, k double, q string, c string")), n)
    return end, end.groupBy("q", "k", "c").agg(F.count("*").alias("n")), not end.where("c <> node").isEmpty()


def _wanted(links: DataFrame, held: DataFrame, total: float, unit: float) -> DataFrame:
    """q, k, own, n, c, gain, links_gain of the nodes whose best move gains, by class and community: half of what
    modularity rises by, times the weight of all links, and the part of it that links make, for one node."""
    volume = held.groupBy("c").agg(F.sum(F.col("n") * F.col("k")).alias("volume"))
    to = links.join(held.select(F.col("q").alias("p"), "c", "n"), "p").groupBy("q", "c").agg(F.sum(F.col("w") * F.col("n")).alias("w"))
    moving = held.select("q", "k", F.col("c").alias("own"), "n")
    stay = moving.withColumn("c", F.col("own")).withColumn("w", F.lit(0.0)).join(volume, "c")
    options = to.join(volume, "c").join(moving, "q").select(*stay.columns).unionByName(stay)
    same = F.col("c") == F.col("own")
    gain = lambda w, volume: F.rint((w - F.col("k") * volume / total) / unit * 1e9) / 1e9
    best = options.groupBy("q", "k", "own", "n").agg(
        F.max(F.when(~same, F.struct(gain(F.col("w"), F.col("volume")).alias("gain"), "c", "w"))).alias("to"), F.sum(F.when(same, F.col("w"))).alias("held"), F.max(F.when(same, F.col("volume"))).alias("volume")
    )
    now = gain(F.col("held"), F.col("volume") - F.col("k"))
    return best.select("q", "k", "own", "n", "to.c", ((F.col("to.gain") - now) * unit).alias("gain"), (F.col("to.w") - F.col("held")).alias("links_gain")).where(f"gain > {2e-9 * unit!r}")


def _between_colours(wanted: DataFrame, turn: int) -> DataFrame:
    """Moves from givers to takers. In even turns a community takes if more is gained by moves to it than by moves
    from it, in odd ones a hash says so."""
    if turn % 2:
        takes = lambda c: F.pmod(F.xxhash64(c, F.lit(SEED + turn)), F.lit(2)) == 0
        return wanted.where(~takes(F.col("own")) & takes(F.col("c")))
    gain = F.col("n") * F.col("gain")
    ends = wanted.select(F.explode(F.array(F.struct(F.col("c").alias("x"), gain.alias("g")), F.struct(F.col("own").alias("x"), (-gain).alias("g")))).alias("e"))
    pull = ends.groupBy("e.x").agg((F.sum("e.g") > 0).alias("takes"))
    sides = wanted.join(pull.select(F.col("x").alias("c"), "takes"), "c").join(pull.select(F.col("x").alias("own"), F.col("takes").alias("keeps")), "own")
    return sides.where("takes and not keeps").select(*wanted.columns)


def _thinned(moves: DataFrame, total: float) -> DataFrame:
    """The moves with the ``share`` of nodes at which those of either of their communities gain most together."""
    k, n = F.col("k"), F.col("n")
    for side in ("c", "own"):
        joint = (F.sum(n * k) ** 2 - F.sum(n * k**2)) / (2 * total)
        share = moves.groupBy(side).agg(F.when(joint > 0, F.sum(n * F.col("gain")) / (2 * joint)).otherwise(1.0).alias(f"share_{side}"))
        moves = moves.join(share, side)
    return moves.withColumn("share", F.least("share_c", "share_own"))


def _last(wanted: DataFrame, at: DataFrame) -> DataFrame:
    """The moves with the last node of their class and community."""
    there = wanted.join(at.select("node", "q", F.col("c").alias("own")), ["q", "own"])
    return there.groupBy(*wanted.columns).agg(F.max("node").alias("last"))


def _disjoint(wanted: DataFrame) -> DataFrame:
    """The moves, of the last node each, that are best for both communities they touch."""
    rank = F.struct("gain", "last")
    first = wanted.select(F.explode(F.array("own", "c")).alias("x"), rank.alias("rank")).groupBy("x").agg(F.max("rank").alias("rank"))
    return wanted.withColumn("rank", rank).join(first.select(F.col("x").alias("own"), "rank"), ["own", "rank"]).join(first.select(F.col("x").alias("c"), "rank"), ["c", "rank"])


def _gain(counts: DataFrame, total: float) -> float:
    """What the moves gain at least: their links, less what the squares of the volumes grow by."""
    volume = F.col("n") * F.col("k")
    change = F.array(
        F.struct(F.col("before").alias("c"), volume.alias("volume"), F.when(F.col("before") != F.col("c"), -volume).otherwise(0.0).alias("d"), (F.col("n") * F.coalesce("links_gain", F.lit(0.0))).alias("g")),
        F.struct(F.col("c"), F.lit(0.0).alias("volume"), F.when(F.col("before") != F.col("c"), volume).otherwise(0.0).alias("d"), F.lit(0.0).alias("g")),
    )
    by = counts.select(F.explode(change).alias("e")).groupBy("e.c").agg(F.sum("e.volume").alias("volume"), F.sum("e.d").alias("d"), F.sum("e.g").alias("g"))
    return by.agg(F.sum(F.col("g") - F.col("d") * (2 * F.col("volume") + F.col("d")) / (2 * total))).first()[0]


def modularity(members: DataFrame, edges: DataFrame) -> float:
    e = undirected(edges).join(members.select(F.col("node_key").alias("node"), F.col("community_id").alias("a")), "node").join(members.select(F.col("node_key").alias("other"), F.col("community_id").alias("b")), "other")
    total = e.agg(F.sum("w")).first()[0] or 1.0
    by = e.groupBy("a").agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)) / total - (F.sum("w") / total) ** 2).alias("q"))
    return by.agg(F.coalesce(F.sum("q"), F.lit(0.0))).first()[0]


def visible_documents(nodes: DataFrame, principal: Principal) -> DataFrame:
    docs = nodes.where("node_type = 'document'").withColumn("folder", F.get("folder_paths", F.lit(0)))
    return restrict(docs, principal).select("node_key", "doc_id")


def neighbours(edges: DataFrame, key: str) -> DataFrame:
    """relation, neighbour, direction of a node's edges."""
    out = edges.where(F.col("src_key") == key).select("relation", F.col("tgt_key").alias("neighbour"), F.lit("out").alias("direction"))
    return out.unionByName(edges.where(F.col("tgt_key") == key).select("relation", F.col("src_key").alias("neighbour"), F.lit("in").alias("direction")))


def search_labels(nodes: DataFrame, part: str) -> DataFrame:
    return nodes.where(F.contains(F.lower("label"), F.lit(part.lower())))


def referring_documents(edges: DataFrame, question: str, visible: DataFrame) -> DataFrame:
    """Visible documents that refer to what a question names."""
    asked = edges.sparkSession.createDataFrame([(question,)], "q string").select(F.explode(T.references(F.col("q"))).alias("tgt_key"))
    hits = edges.where("relation = 'references'").join(F.broadcast(asked), "tgt_key", "left_semi")  # the references of one question
    visible = visible.hint("merge")  # all documents may be: not broadcast
    return hits.join(visible, hits["src_key"] == visible["node_key"]).select("doc_id").distinct()


def graph_view(nodes: DataFrame, edges: DataFrame, principal: Principal, types: list[str] | None = None, limit: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of what a principal may see: visible documents, entities that touch them, the
    chosen types, the ``limit`` nodes of highest rank (None: all), and the edges between these."""
    visible = visible_documents(nodes, principal).select("node_key")
    touching = edges.join(visible, edges["src_key"] == visible["node_key"], "left_semi").select(F.col("tgt_key").alias("node_key")).unionByName(edges.join(visible, edges["tgt_key"] == visible["node_key"], "left_semi").select(F.col("src_key").alias("node_key"))).distinct()
    entities = nodes.where("node_type <> 'document'").join(touching, "node_key", "left_semi")
    shown = nodes.join(visible, "node_key", "left_semi").unionByName(entities)
    if types:
        shown = shown.where(F.col("node_type").isin(types))
    if limit is not None:
        shown = shown.orderBy(F.desc(F.coalesce("pagerank", F.lit(0.0))), "node_key").limit(max(1, limit))
    return shown, between(edges, shown)


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose two ends are both among the nodes."""
    keys = nodes.select("node_key")
    return edges.join(keys, edges["src_key"] == keys["node_key"], "left_semi").join(keys, edges["tgt_key"] == keys["node_key"], "left_semi")


def documents_of_entity(edges: DataFrame, key: str, visible: DataFrame) -> DataFrame:
    n = neighbours(edges, key).select("neighbour").distinct()
    return visible.join(n, visible["node_key"] == n["neighbour"], "left_semi")


def view_totals(nodes: DataFrame, edges: DataFrame, principal: Principal, types: list[str] | None = None, limit: int = 500) -> DataFrame:
    """One row for a view: nodes, edges and communities shown, the nodes and edges there are in all, and
    whether the limit has cut the view."""
    shown, links = graph_view(nodes, edges, principal, types, limit)
    may_be, _ = graph_view(nodes, edges, principal, types, None)
    own = shown.agg(F.count("*").alias("nodes_shown"), F.count_distinct("community_id").alias("communities_shown"))
    parts = [links.agg(F.count("*").alias("edges_shown")), nodes.agg(F.count("*").alias("nodes_total")), edges.agg(F.count("*").alias("edges_total")), may_be.agg(F.count("*").alias("visible"))]
    for part in parts:  # single rows
        own = own.join(part)
    return own.withColumn("truncated", F.col("visible") > F.col("nodes_shown")).drop("visible")


def snapshot(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """What readers of a graph look up: the type of each node, the folder of each document, which
    documents refer to a key, and both directions of every edge."""
    adjacency = edges.select(F.col("src_key").alias("node_key"), F.col("tgt_key").alias("other_key"), "relation").unionByName(edges.select(F.col("tgt_key").alias("node_key"), F.col("src_key").alias("other_key"), "relation")).distinct()
    return {
        "types": nodes.select("node_key", "node_type"),
        "folders": nodes.where("node_type = 'document'").select("doc_id", F.get("folder_paths", F.lit(0)).alias("folder")),
        "referring": edges.where("relation = 'references'").join(nodes.where("node_type = 'document'").select(F.col("node_key").alias("src_key"), "doc_id"), "src_key").select(F.col("tgt_key").alias("ref_key"), "doc_id").distinct(),
        "adjacency": adjacency,
    }
