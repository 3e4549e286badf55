"""Whole plans: retrieval, ingestion, graph refresh."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.functions import text as T
from folioweave.functions.folders import Principal, restrict
from folioweave.operators import chunking, filters, graph, listing, retrieval
from folioweave.session import checkpointed
from folioweave.sources.warehouse import Warehouse


@dataclass
class Request:
    question: str
    vector: list[float]
    principal: Principal
    folder: str | None = None
    top_k: int = 5
    doc_type: str | None = None
    language: str | None = None
    only_current: bool = False
    content_budget: int = 0
    use_text: bool = True
    fastpath: bool = True
    walk: bool = False
    restart: float = 0.15
    seeds: int = 5
    walk_documents: int = 10
    reranker: Callable[[str, list[str]], list[float]] | None = field(default=None)
    #: A kept index of the chunks by folder, doc_type and language.
    index: retrieval.TextIndex | None = None
    #: Answer without the graph, or with nothing at all, where a search fails, rather than raise.
    lenient: bool = False


def retrieve(chunks: DataFrame, docs: DataFrame, request: Request, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Ranked chunks with citation and status.

    The access filter lies below every ranking; expanded candidates pass the same filters as the
    others. Order of the last steps: sanitise, budget, status, references, only current.
    """
    if request.folder is not None and not request.principal.unrestricted and not _allowed(request):
        raise PermissionError(request.folder)

    def keep(rows: DataFrame) -> DataFrame:
        rows = restrict(rows, request.principal)
        if request.folder is not None:
            rows = restrict(rows, Principal("user", False, (request.folder,)))
        return rows.where(filters.access_filter(None, request.doc_type, request.language))

    own = keep(chunks)
    k = request.top_k * 3 if request.reranker else request.top_k
    ranked = retrieval.hybrid(own, request.question, request.vector, k, use_text=request.use_text, index=request.index, keep=keep)
    found = own.drop("vector").join(ranked, "chunk_id")
    if nodes is not None and edges is not None:
        visible = graph.visible_documents(nodes, request.principal)
        lists = [found]
        if request.fastpath:
            named = graph.referring_documents(edges, request.question, visible)
            lists.insert(0, _of_documents(own, named.join(found.select("doc_id").distinct(), "doc_id", "left_anti"), request, k))
        found = retrieval.merge_candidates(*lists)
        if request.walk:
            found = checkpointed(found)  # a few candidates, read several times below
            best = found.groupBy("doc_id").agg(F.min(F.struct("priority", "rank")).alias("first")).orderBy("first", "doc_id").limit(request.seeds)
            seeds = checkpointed(best.join(visible, "doc_id").select("node_key"))
            near = checkpointed(walk_candidates(nodes, edges, visible, seeds, request))
            found = retrieval.merge_candidates(found.drop("priority"), _of_documents(own, near, request, k))
        found = found.withColumn("rank", F.col("priority") * 1_000_000 + F.col("rank")).drop("priority")
    if request.reranker:
        found = retrieval.rerank(found.drop("rank"), request.question, request.reranker, request.top_k)
    else:
        found = found.orderBy("rank", "chunk_id").limit(request.top_k)
    found = filters.content_budget(filters.sanitize(found, request.principal), request.content_budget)
    found = filters.scrub_references(filters.with_status(found, docs), restrict(docs, request.principal))
    return filters.with_citation(filters.only_current(found) if request.only_current else found)


def retrieve_now(chunks: DataFrame, docs: DataFrame, request: Request, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """``retrieve``, evaluated. A lenient request whose graph fails is answered without it, and one whose search
    fails by no rows; any other failure is raised, and so is a folder that isn't allowed."""
    if not request.lenient:
        return checkpointed(retrieve(chunks, docs, request, nodes, edges))
    if nodes is not None:
        try:
            return checkpointed(retrieve(chunks, docs, request, nodes, edges))
        except (PySparkException, Py4JError):
            logging.getLogger(__name__).exception("the graph failed; the answer comes without it")
    try:
        return checkpointed(retrieve(chunks, docs, request))
    except (PySparkException, Py4JError):
        logging.getLogger(__name__).exception("the search failed; the answer is empty")
        none = (chunks.sparkSession.createDataFrame([], x.schema) for x in (chunks, docs))
        return retrieve(*none, replace(request, index=None))


def _allowed(request: Request) -> bool:
    from folioweave.functions.folders import normalize_folder_name as n

    return any(n(request.folder).startswith(n(a)) for a in request.principal.allowed_folders)


def _of_documents(chunks: DataFrame, ids: DataFrame, request: Request, k: int) -> DataFrame:
    part = chunks.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return part.drop("vector").join(retrieval.hybrid(part, request.question, request.vector, k, use_text=request.use_text, index=request.index), "chunk_id")


def walk_candidates(nodes: DataFrame, edges: DataFrame, visible: DataFrame, seeds: DataFrame, request: Request) -> DataFrame:
    """doc_id of the visible documents that walks from the seeds reach most, seeds aside; other
    documents are no part of the graph that is walked."""
    seen = nodes.where("node_type <> 'document'").select("node_key").unionByName(visible.select("node_key"))
    scores = graph.personalised(seen, edges, seeds, request.restart)  # which leaves out edges to other nodes
    best = scores.join(visible.hint("merge"), "node_key").join(seeds, "node_key", "left_anti")
    return best.orderBy(F.desc("score"), "node_key").limit(request.walk_documents).select("doc_id")


def norm_lookup(docs: DataFrame, norm: str, principal: Principal, only_current: bool = False) -> DataFrame:
    """Documents of a norm in any spelling."""
    asked = T.norm_key(F.lit(norm))
    found = restrict(docs.where("status = 'indexed'"), principal).where(T.norm_key(F.col("norm_id")) == asked)
    return found.where("valid_status is null or valid_status <> 'superseded'") if only_current else found


def get_document(docs: DataFrame, chunks: DataFrame, doc_id: int, principal: Principal, with_text: bool = False) -> DataFrame:
    found = restrict(docs.where(F.col("doc_id") == doc_id), principal)
    if not with_text:
        return found
    texts = listing.full_texts(chunks.where(F.col("doc_id") == doc_id)).withColumnRenamed("text", "full_text")
    return found.join(texts, "doc_id", "left")


MAX_BYTES = 50 << 20


def ingest(parsed: DataFrame, known: DataFrame, embedder=retrieval.hashing_embedder, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks with vectors) of parsed files, not too large, that their folder doesn't have yet."""
    new = listing.new_files(parsed.where((F.col("size_bytes") <= max_bytes) & F.col("error").isNull()), known)
    texts = new.withColumn("text", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n"))
    docs = texts.withColumn("doc_id", F.sha1(F.concat_ws("\x1f", "folder", "doc_hash"))).withColumn("meta", T.metadata(F.col("text")))
    docs = docs.select("doc_id", "folder", "file_name", "doc_hash", "size_bytes", "pages", "meta.*", "text").withColumn("norm_key", T.norm_key(F.col("norm_id")))
    chunks = chunking.chunk_documents(docs).join(docs.select("doc_id", "folder"), "doc_id")
    chunks = chunks.withColumn("chunk_id", T.chunk_id(F.col("doc_id"), F.col("section_path"), F.col("text"))).withColumn("tokens", T.token_estimate(F.col("text")))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    docs = docs.drop("pages").join(counts, "doc_id", "left").withColumn("status", F.lit("indexed"))
    return docs, retrieval.embed(filters.chunk_payload(docs.withColumn("tags", F.array().cast("array<string>")), chunks), embedder)


def ingest_into(warehouse: Warehouse, parsed: DataFrame, embedder=retrieval.hashing_embedder, max_bytes: int = MAX_BYTES, index: retrieval.TextIndex | None = None) -> int:
    """Stores the new ones of parsed files: size check, duplicates, metadata, chunks and vectors, in one commit that
    adds to the tables and rewrites none. Returns how many documents are new.

    The table ``norms`` gets a row for each norm of which the batch has a newer version, or the first; no
    other norm is looked at, and ``stored_documents`` takes the newest row of each. A kept index gets the
    chunks, too.
    """
    old = warehouse.read("documents")
    known = old if old is not None else parsed.select("doc_hash", F.col("folder")).limit(0)
    docs, chunks = map(checkpointed, ingest(parsed, known, embedder, max_bytes))
    n = docs.count()
    if n:
        newest, before = listing.newest_of_norms(docs), warehouse.read("norms")
        if before is not None:
            dated = before.join(newest.select("norm_key"), "norm_key", "left_semi").groupBy("norm_key").agg(F.min("newest").alias("held"))
            newest = newest.join(dated, "norm_key", "left").where("held is null or newest < held").drop("held")
        warehouse.extend(documents=docs, chunks=chunks, norms=newest)
        if index is not None:
            index.append(chunks)
    return n


def stored_documents(warehouse: Warehouse) -> DataFrame | None:
    """The documents that ``ingest_into`` has stored, with the version status of each; None if there are none."""
    docs, norms = warehouse.read("documents"), warehouse.read("norms")
    return None if docs is None else listing.with_newest(docs, norms.groupBy("norm_key").agg(F.min("newest").alias("newest")))


def redate(warehouse: Warehouse) -> None:
    """Makes ``norms`` anew, as is needed once a norm's newest document has been deleted."""
    warehouse.commit(norms=checkpointed(listing.newest_of_norms(warehouse.read("documents"))))


def reindex(docs: DataFrame, chunks: DataFrame, embedder=retrieval.hashing_embedder) -> tuple[DataFrame, DataFrame]:
    """(search rows, counters) of all canonical chunks anew: payload of the document as it is now, and a vector.

    Counters: doc_id, n chunks, and whether the document has none and must be parsed again.
    """
    rows = retrieval.embed(filters.chunk_payload(docs, chunks), embedder)
    counted = docs.select("doc_id").join(chunks.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    return rows, counted.select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


class GraphCache:
    """A graph's lookup tables in memory, read again when its version token has changed; the token is looked
    at again after ``seconds`` at the earliest."""

    def __init__(self, load: Callable[[], tuple[DataFrame, DataFrame]], token: Callable[[], object], seconds: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.load, self.token, self.seconds, self.clock = load, token, seconds, clock
        self.tables: dict[str, DataFrame] = {}
        self.version: object = None
        self.looked: float | None = None

    def get(self) -> dict[str, DataFrame]:
        now = self.clock()
        if self.looked is None or now - self.looked >= self.seconds:
            version = self.token()
            if self.looked is None or version != self.version:
                self.invalidate()
                self.tables = {name: df.persist() for name, df in graph.snapshot(*self.load()).items()}
                self.version = version
            self.looked = now
        return self.tables

    def invalidate(self) -> None:
        for df in self.tables.values():
            df.unpersist()
        self.tables, self.looked = {}, None


def refresh_graph(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, rounds: int = 100) -> dict[str, DataFrame]:
    """nodes with rank, community and participation; edges of both layers; communities."""
    nodes, first = graph.first_layer(docs, chunks)
    nodes, first = checkpointed(nodes), checkpointed(first)
    similar = graph.second_layer(graph.mutual_neighbours(graph.centroids(vectors)), "similar_to")
    copies = graph.second_layer(graph.near_duplicates(docs.select("doc_id", "text")), "near_dup")
    known = nodes.select("node_key")
    second = similar.unionByName(copies)
    second = graph.between(second, known)
    edges = checkpointed(first.unionByName(second))
    ranks, members = graph.pagerank(nodes, edges, rounds=rounds), checkpointed(graph.communities(nodes, edges))
    nodes = nodes.join(ranks, "node_key").join(members, "node_key").join(graph.participation(members, edges), "node_key")
    return {"nodes": nodes, "edges": edges, "communities": graph.describe_communities(members, ranks).join(graph.conductance(members, edges), "community_id")}
