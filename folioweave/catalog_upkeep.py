"""Queries of the upkeep of a collection: warehouse, decisions, lists, logs, graph snapshots, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioweave import model as M
from folioweave.functions import folders as A
from folioweave.functions import text as T
from folioweave.operators import chunking, filters, graph, listing, maintenance, retrieval
from folioweave.registry import query
from folioweave.session import checkpointed, shared_folder
from folioweave.sources import files, formats
from folioweave.sources.warehouse import Warehouse, migrate
from folioweave.streaming import jobs, keyed


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- warehouse ----------------------------------------------------------------------------------------
@query("""SELECT * FROM (
  SELECT 'latest' AS tag, doc_id, CASE WHEN doc_id = 3 THEN '/neu/' ELSE folder END AS folder FROM docs WHERE doc_id NOT IN (1, 2) AND doc_id % 10 <> 5
  UNION ALL SELECT 'current', doc_id, folder FROM docs WHERE doc_id % 10 <> 5 UNION ALL SELECT 'prev', doc_id, folder FROM docs WHERE doc_id % 10 < 5)""", M.DOCS_SQL)
def publish_roundtrip(spark, d):
    """A warehouse after two published versions, appended rows, a move, deletions, compaction and pruning: each tag's rows."""
    docs = M.docs(spark, d).select("doc_id", "folder", "language")
    own = Warehouse(spark, _scratch(spark, "warehouse"))
    own.commit(documents=docs.where("doc_id % 10 < 5"), chunks=docs.where("doc_id % 10 < 5"))
    own.publish()
    own.append("documents", docs.where("doc_id % 10 > 5").drop("language"), docs.schema)
    own.publish()
    own.publish()  # nothing has changed
    own.delete_documents([1, 2])
    own.move_document(3, "neu")
    own.compact("documents")
    own.prune(0)
    out = None
    for tag in ("latest", "current", "prev"):
        rows = Warehouse(spark, own.path, tag).read("documents").select(F.lit(tag).alias("tag"), "doc_id", "folder")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT 'documents' AS name, count(*) AS n FROM docs UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'nothing', 0", M.DOCS_SQL, M.CHUNKS_SQL)
def table_counts(spark, d):
    own = Warehouse(spark, _scratch(spark, "warehouse"))
    own.commit(documents=M.docs(spark, d).select("doc_id"), chunks=M.chunks(spark, d).select("chunk_id"))
    return spark.createDataFrame([(n, own.count(n)) for n in ("documents", "chunks", "nothing")], "name string, n long")


@query("SELECT doc_id, folder FROM docs WHERE doc_id % 2 = 0", M.DOCS_SQL)
def backup_restored(spark, d):
    """What a copy of a warehouse holds under its published tag."""
    docs = M.docs(spark, d).select("doc_id", "folder")
    own, copy = Warehouse(spark, _scratch(spark, "warehouse")), _scratch(spark, "backup")
    own.commit(documents=docs.where("doc_id % 2 = 0"))
    own.publish()
    own.reset("documents", docs.schema)
    own.copy_to(Warehouse(spark, copy))
    return Warehouse(spark, copy, "current").read("documents")


@query("SELECT doc_id, folder, NULL::VARCHAR AS norm_id FROM docs", M.DOCS_SQL)
def migrated(spark, d):
    docs = M.docs(spark, d)
    return migrate(docs.select("doc_id", "folder", "text"), docs.select("doc_id", "folder", "norm_id").limit(0))


# ---- lists, totals, decisions -----------------------------------------------------------------------
@query("SELECT doc_id, (SELECT count(*) FROM docs WHERE language = 'en' AND status = 'indexed') AS total FROM docs WHERE starts_with(folder, '/en/') AND status = 'indexed' ORDER BY uploaded_at DESC, doc_id LIMIT 30 OFFSET 10", M.DOCS_SQL)
def list_page_total(spark, d):
    return filters.list_page_with_total(M.docs(spark, d), 30, 10, prefix="/en/", status="indexed").select("doc_id", "total")


@query("SELECT count(*) AS admins, count(*) > 1 AS may_remove FROM customer WHERE c_mktsegment = 'MACHINERY'")
def admin_guard(spark, d):
    return listing.admins(M.read(spark, d, "customer").select(F.when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("user").alias("role")))


_SUGGESTED = "s AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE (doc_id % 7)::INTEGER END AS community_id, '/' || language || '/' AS suggested_folder, folder AS current_folder FROM docs)"


def _suggested(spark, d):
    return M.docs(spark, d).selectExpr("doc_id", "cast(if(doc_id % 13 = 0, null, doc_id % 7) as int) as community_id", "concat('/', language, '/') as suggested_folder", "folder as current_folder")


@query("SELECT doc_id, row_number() OVER (ORDER BY community_id NULLS LAST, suggested_folder, doc_id) AS place FROM s", M.DOCS_SQL, _SUGGESTED)
def suggestion_order(spark, d):
    return listing.suggestion_list(_suggested(spark, d)).select("doc_id", "place")


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM events QUALIFY place <= 100")
def log_order(spark, d):
    return listing.log_list(M.query_log(spark, d)).select("event_id", "place")


_PAIRS = """hashes AS (SELECT doc_hash, arg_min(doc_id, (uploaded_at, doc_id)) AS keep FROM docs GROUP BY doc_hash HAVING count(*) > 1),
  pairs AS (SELECT keep, doc_id AS remove, CASE remove % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM docs JOIN hashes USING (doc_hash) WHERE doc_id <> keep)"""


def _decided(spark, d):
    docs = M.docs(spark, d)
    pairs = listing.duplicate_pairs(docs).select("keep", "remove", F.lit("pending").alias("status"))
    return docs, maintenance.decide_duplicates(pairs, pairs.selectExpr("keep", "remove", "case remove % 3 when 0 then 'accept' when 1 then 'reject' end as action"))


@query("SELECT * FROM pairs", M.DOCS_SQL, _PAIRS)
def duplicates_decided(spark, d):
    return _decided(spark, d)[1]


@query("SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT remove FROM pairs WHERE status = 'accepted')", M.DOCS_SQL, _PAIRS)
def duplicates_removed(spark, d):
    return maintenance.without_duplicates(*_decided(spark, d)).select("doc_id")


@query("SELECT doc_id, current_folder || ' → ' || suggested_folder AS summary, TIMESTAMP '2024-03-31 00:00:00' AS expires_at FROM s WHERE doc_id % 2 = 0", M.DOCS_SQL, _SUGGESTED)
def move_journal(spark, d):
    accepted = _suggested(spark, d).withColumn("status", F.when(F.col("doc_id") % 2 == 0, "accepted").otherwise("pending"))
    return maintenance.move_journal(accepted, F.lit("2024-03-01").cast("timestamp")).select("doc_id", "summary", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '/' || language || '/' ELSE folder END AS folder FROM docs", M.DOCS_SQL)
def moves_undone(spark, d):
    """Every second document moves; of these moves every second one is undone."""
    docs = M.docs(spark, d).select("doc_id", "folder")
    accepted = _suggested(spark, d).where("doc_id % 2 = 0").withColumn("status", F.lit("accepted"))
    moved = maintenance.move_documents(docs, accepted.select("doc_id", F.col("suggested_folder").alias("target")))
    journal = maintenance.move_journal(accepted, F.lit("2024-03-01").cast("timestamp")).withColumn("undo_applied", F.col("doc_id") % 4 == 0)
    return maintenance.undo_moves(moved, journal)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN doc_id % 3 = 0 THEN '/old/' ELSE '/new/' END AS suggested_folder FROM docs WHERE doc_id % 3 <> 1", M.DOCS_SQL)
def pending_replaced(spark, d):
    old = M.docs(spark, d).selectExpr("doc_id", "if(doc_id % 3 = 0, 'rejected', 'pending') as status", "'/old/' as suggested_folder")
    return maintenance.replace_pending(old, old.where("doc_id % 3 = 2").withColumn("suggested_folder", F.lit("/new/")))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '/rest/' ELSE '/karte/' || doc_id % 3 || '/' END AS folder FROM docs", M.DOCS_SQL)
def zip_folder_map(spark, d):
    names = M.docs(spark, d).select("doc_id", "file_name")
    mapping = names.where("doc_id % 5 <> 0").selectExpr("file_name", "concat('karte//', doc_id % 3) as folder")
    return A.mapped_folder(names, mapping, "rest").select("doc_id", "folder")


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey % 3 = 0 ELSE c_mktsegment = 'BUILDING' END AS may_write, CASE WHEN c_nationkey % 2 = 0 THEN true ELSE true END AS may_read FROM customer")
def scopes(spark, d):
    rows = M.read(spark, d, "customer").selectExpr("c_custkey as id", "if(c_nationkey % 2 = 0, 'key', 'user') as kind", "if(c_mktsegment = 'BUILDING', 'admin', 'user') as role", "if(c_custkey % 3 = 0, array('read', 'write'), array('read')) as scopes")
    held = lambda scope: A.has_scope(F.col("kind"), F.col("role"), F.col("scopes"), scope)
    return rows.select("id", held("write").alias("may_write"), held("read").alias("may_read"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0 OR o_orderdate > TIMESTAMP '1996-01-01'")
def unexpired_keys(spark, d):
    keys = M.read(spark, d, "orders").selectExpr("o_orderkey as id", "if(o_orderkey % 5 = 0, null, o_orderdate) as expires_at")
    return filters.unexpired(keys, F.lit("1996-01-01").cast("timestamp_ntz")).select("id")


@query("""SELECT o_orderkey AS id, CASE WHEN age < 3600 * 24 * 365 THEN 'live' WHEN age < 3600 * 24 * 730 THEN 'expired' ELSE 'gone' END AS state
  FROM (SELECT o_orderkey, epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate) AS age FROM orders)""")
def session_states(spark, d):
    rows = M.read(spark, d, "orders").selectExpr("o_orderkey as id", "o_orderdate as created_at")
    return listing.session_states(rows, F.lit("1998-01-01").cast("timestamp"), 365 * 86400, 730 * 86400).select("id", "state")


@query("SELECT event_id, CASE WHEN date_trunc('day', ts) + INTERVAL 2 HOUR > ts THEN date_trunc('day', ts) + INTERVAL 2 HOUR ELSE date_trunc('day', ts) + INTERVAL 26 HOUR END AS next_run FROM events")
def next_runs(spark, d):
    log = M.query_log(spark, d)
    return log.select("event_id", listing.next_run(F.col("ts").cast("timestamp"), 2).cast("timestamp_ntz").alias("next_run"))


@query("SELECT CAST(ts AS DATE) AS day, event_type AS model, count(*) AS n, max(length(repeat(event_type, 1000))) > 4000 AS was_long, 4000 AS most FROM events GROUP BY ALL")
def query_log_sink(spark, d):
    """A log of two batches, the second written twice: queries of each day and model, and the longest text kept."""
    log = M.query_log(spark, d).select("event_id", "created_at", F.col("event_type").alias("model"), F.repeat("event_type", 1000).alias("query_text"))
    path = _scratch(spark, "log")
    for batch, rows in ((0, log.where("event_id % 2 = 0")), (1, log.where("event_id % 2 = 1")), (1, log.where("event_id % 2 = 1"))):
        listing.append_log(rows, path, batch)
    kept = listing.read_log(spark, path).groupBy("day", "model").agg(F.count("*").alias("n"), F.max(F.length("query_text")).alias("most"))
    return kept.select("day", "model", "n", (F.length("model") * 1000 > 4000).alias("was_long"), F.col("most").cast("int").alias("most"))


# ---- chunks, texts ---------------------------------------------------------------------------------------
@query("""SELECT chunk_id, folder, tags, doc_type, norm_id, doc_version, 'Teil ' || ordinal % 3 AS section_title, 'txt' AS source_type
  FROM chunks JOIN (SELECT doc_id, tags, doc_type, norm_id, doc_version FROM docs) USING (doc_id)""", M.DOCS_SQL, M.CHUNKS_SQL)
def payload_rows(spark, d):
    """The search table's rows from canonical chunks, as a reindex makes them."""
    chunks = M.chunks(spark, d).select("chunk_id", "doc_id", "folder", "text", F.concat(F.lit("Kapitel › Teil "), F.col("ordinal") % 3).alias("section_path"))
    return filters.chunk_payload(M.docs(spark, d), chunks).select("chunk_id", "folder", "tags", "doc_type", "norm_id", "doc_version", "section_title", "source_type")


@query("""SELECT doc_id, count(*) AS chunks, count_if(ordinal % 4 <> 0) AS children, count_if(ordinal % 4 = 0) AS parents, count_if(ordinal % 4 <> 0 AND length(trim(text)) < 80) AS short,
  (CASE WHEN count_if(ordinal % 4 <> 0) = 0 THEN 'no text,' ELSE '' END) || (CASE WHEN count_if(ordinal % 4 <> 0 AND length(trim(text)) < 80) > count_if(ordinal % 4 <> 0) / 2 THEN 'mostly short chunks,' ELSE '' END) AS warnings FROM chunks GROUP BY doc_id""", M.CHUNKS_SQL)
def ingest_report(spark, d):
    rows = M.chunks(spark, d).withColumn("level", F.when(F.col("ordinal") % 4 == 0, "parent").otherwise("child"))
    report = listing.ingest_report(rows)
    return report.withColumn("warnings", F.array_join(F.transform("warnings", lambda w: F.concat(w, F.lit(","))), ""))


@query("SELECT doc_id, chunk_id, ordinal, text FROM (SELECT doc_id, 'c' || ordinal % 4 AS chunk_id, min(ordinal) AS ordinal, arg_max(text, ordinal) AS text FROM chunks GROUP BY ALL)", M.CHUNKS_SQL)
def chunks_once(spark, d):
    return chunking.last_of_each(M.chunks(spark, d).withColumn("chunk_id", F.concat(F.lit("c"), F.col("ordinal") % 4)))


@query("SELECT doc_id, 'ÖNORM B ' || (1000 + doc_id % 40) || ',DIN EN ISO 9001:2015,' || 'ÖNORM B ' || (1000 + doc_id % 40) AS raws, '-,2015,-' AS versions FROM docs", M.DOCS_SQL)
def norm_hits(spark, d):
    """All norms of a text in order, repeated ones too, with their years."""
    line = F.concat(F.lit("Nach ÖNORM B "), 1000 + F.col("doc_id") % 40, F.lit(" und DIN EN ISO 9001:2015; ÖNORM B "), 1000 + F.col("doc_id") % 40, F.lit("."))
    hits = M.docs(spark, d).select("doc_id", T.norm_matches(line).alias("m"))
    return hits.select("doc_id", F.array_join(F.transform("m", lambda m: m["raw"]), ",").alias("raws"), F.array_join(F.transform("m", lambda m: F.coalesce(m["version"], F.lit("-"))), ",").alias("versions"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN (2001 + doc_id % 20)::VARCHAR WHEN 1 THEN (1990 + doc_id % 9)::VARCHAR END AS doc_version, CASE doc_id % 3 WHEN 0 THEN (2001 + doc_id % 20) || '-05-07' WHEN 1 THEN (1990 + doc_id % 9)::VARCHAR END AS issued_date, 'norm' AS doc_type FROM docs", M.DOCS_SQL)
def head_versions(spark, d):
    """Version and date of heads with a date, with an edition, and with neither."""
    i = F.col("doc_id")
    tail = F.when(i % 3 == 0, F.concat(F.lit("vom "), 2001 + i % 20, F.lit("-05-07"))).when(i % 3 == 1, F.concat(F.lit("Ausgabe: "), 1990 + i % 9)).otherwise("ohne Jahr")
    rows = M.docs(spark, d).select("doc_id", T.metadata(F.concat(F.lit("ÖNORM B 1801-1 "), tail)).alias("m"))
    return rows.select("doc_id", "m.doc_version", "m.issued_date", "m.doc_type")


_PARENTS = "c AS (SELECT doc_id, ordinal, 's' || (ordinal // 5) AS path, greatest(1, length(text) // 4) AS tokens, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS nth FROM chunks)"


@query(f"""WITH RECURSIVE {M.CHUNKS_SQL}, {_PARENTS}, f AS (SELECT doc_id, ordinal, nth, path, tokens AS total, 0 AS parent FROM c WHERE nth = 1
  UNION ALL SELECT c.doc_id, c.ordinal, c.nth, c.path, CASE WHEN c.path <> f.path OR f.total + c.tokens > 1024 THEN c.tokens ELSE f.total + c.tokens END, f.parent + CASE WHEN c.path <> f.path OR f.total + c.tokens > 1024 THEN 1 ELSE 0 END FROM f JOIN c ON c.doc_id = f.doc_id AND c.nth = f.nth + 1)
  SELECT doc_id, ordinal, parent::INTEGER AS parent FROM f""")
def parent_runs(spark, d):
    parts = M.chunks(spark, d).select("doc_id", "ordinal", F.concat(F.lit("s"), F.floor(F.col("ordinal") / 5)).alias("section_path"), T.token_estimate(F.col("text")).alias("tokens"))
    return chunking.assign_parents(parts)


@query("""WITH RECURSIVE w AS (SELECT user_id, min(ts) AS s FROM events GROUP BY user_id UNION ALL SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.s + INTERVAL 6 HOUR GROUP BY w.user_id),
  placed AS (SELECT e.user_id, e.event_id, e.ts, max(w.s) AS s FROM events e JOIN w ON w.user_id = e.user_id AND w.s <= e.ts GROUP BY ALL)
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) <= 3 AS allowed FROM placed""")
def rate_limit_windows(spark, d):
    return listing.rate_limit(M.query_log(spark, d), 3, 6 * 3600)


# ---- files ---------------------------------------------------------------------------------------------
@query("SELECT '/a/' || file AS path, suffix, suffix IN ('txt', 'md', 'html', 'htm', 'docx', 'xlsx', 'pdf') AS supported FROM (SELECT 'f' || doc_id || '.' || s AS file, lower(s) AS suffix FROM (SELECT doc_id, ['PDF', 'docx', 'Md', 'exe'][doc_id % 4 + 1] AS s FROM docs))", M.DOCS_SQL)
def files_inspected(spark, d):
    paths = M.docs(spark, d).selectExpr("concat('/a/f', doc_id, '.', element_at(array('PDF', 'docx', 'Md', 'exe'), cast(doc_id % 4 + 1 as int))) as path")
    return files.inspect(paths).select("path", "suffix", "supported")


@query("SELECT doc_id, 'doc_' || doc_id || '.txt' AS file_name, sha256(text) AS doc_hash, strlen(text) AS size_bytes, text FROM documents")
def text_files_parsed(spark, d):
    """Documents written as text files' rows and parsed by suffix."""
    rows = M.read(spark, d, "documents").selectExpr("concat('/in/doc_', doc_id, '.txt') as path", "encode(text, 'UTF-8') as content")
    parsed = files.parse_files(rows)
    return parsed.select(F.regexp_extract("file_name", "([0-9]+)", 1).cast("long").alias("doc_id"), "file_name", "doc_hash", F.col("size_bytes").cast("long").alias("size_bytes"), F.col("pages")[0]["text"].alias("text"))


@query("SELECT doc_id, folder || sub AS folder, error FROM (SELECT doc_id, folder, CASE doc_id % 3 WHEN 0 THEN 'x/' ELSE '' END AS sub, CASE doc_id % 3 WHEN 2 THEN 'parent folder' END AS error FROM docs)", M.DOCS_SQL)
def zip_members(spark, d):
    """A member of each document's archive: its folder under the document's, or why it is refused."""
    docs = M.docs(spark, d).select("doc_id", "folder", F.element_at(F.array(F.lit("x/a.txt"), F.lit("a.txt"), F.lit("../a.txt")), (F.col("doc_id") % 3 + 1).cast("int")).alias("member"))
    packed = files.unzip(docs.select(F.col("doc_id").cast("string").alias("path"), files.zipped("member", F.lit("text")).alias("content")))
    named = packed.select(F.col("archive").cast("long").alias("doc_id"), F.col("path").alias("inner"), "error")
    joined = docs.join(named, "doc_id")
    return joined.select("doc_id", F.when(F.col("error").isNull(), A.zip_folder(F.col("inner"), F.col("folder"))).otherwise(F.col("folder")).alias("folder"), "error")


@query("SELECT doc_id, 'd' || doc_id % 7 || '/doc_' || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS doc_hash, strlen(coalesce(text, '')) AS size_bytes, coalesce(text, '') AS text FROM documents")
def archives_exported(spark, d):
    """All documents written as archives of many members, read back by ranges of members and parsed."""
    formats.register(spark)
    path = _scratch(spark, "archives")
    docs = M.read(spark, d, "documents").selectExpr("concat('d', doc_id % 7, '/doc_', doc_id, '.txt') as path", "encode(coalesce(text, ''), 'UTF-8') as content")
    docs.write.format("archive_members").mode("append").save(path)
    read = spark.read.format("archive_members").option("max_members", 1 << 40).option("max_bytes", 1 << 50).load(path)
    parsed = files.parse_files(read.where("error is null"))
    return parsed.select(F.regexp_extract("file_name", "([0-9]+)", 1).cast("long").alias("doc_id"), "path", "doc_hash", F.col("size_bytes").cast("long").alias("size_bytes"), F.col("pages")[0]["text"].alias("text"))


_NODE_ROWS = """nrows AS (SELECT 'document:' || doc_id AS node_key, 'document' AS node_type, file_name AS label, folder FROM ok UNION ALL SELECT 'folder:' || folder, 'folder', folder, folder FROM ok UNION ALL SELECT 'tag:' || unnest(tags), 'tag', unnest(tags), folder FROM ok
  UNION ALL SELECT 'issuer:austrian_standards', 'issuer', issuer, folder FROM ok WHERE issuer IS NOT NULL UNION ALL SELECT 'norm:' || norm_key, 'norm', norm_id, folder FROM ok WHERE norm_key IS NOT NULL UNION ALL SELECT kind || ':' || k, kind, k, folder FROM refs JOIN ok USING (doc_id)),
  nodes AS (SELECT node_key, node_type, min(label) AS label, list_sort(list_distinct(list(folder))) AS folder_paths FROM nrows GROUP BY node_key, node_type)"""


def register_graph(versions: str, keys: str, layer: str, user_sql: str, user: A.Principal, make) -> None:
    """Queries over the first layer of the graph; ``make`` gives its nodes and edges."""
    views = (M.DOCS_SQL, versions, keys, layer, _NODE_ROWS)

    @query("SELECT node_key, node_type, label, folder_paths FROM nodes", *views)
    def graph_nodes_full(spark, d):
        return make(spark, d)[0].select("node_key", "node_type", "label", "folder_paths")

    @query("""SELECT 'node' AS kind, '{"id":"' || node_key || '","type":"' || node_type || '","label":"' || label || '"' || CASE WHEN node_type = 'document' THEN ',"folder":"' || folder_paths[1] || '"}' ELSE '}' END AS json FROM nodes
      UNION ALL SELECT 'edge', '{"source":"' || src_key || '","target":"' || tgt_key || '","relation":"' || relation || '"}' FROM edges""", *views)
    def graph_export_records(spark, d):
        return files.graph_json(*make(spark, d))

    @query("SELECT node_key AS id, node_type AS type, label, CASE WHEN node_type = 'document' THEN folder_paths[1] END AS folder FROM nodes", *views)
    def graph_json_read(spark, d):
        path = _scratch(spark, "graph")
        files.write_jsonl(files.graph_json(*make(spark, d)), path)
        return files.read_graph_json(spark, path)[0]

    @query("SELECT DISTINCT src_key AS node_key, tgt_key AS other_key, relation FROM edges UNION SELECT tgt_key, src_key, relation FROM edges", *views)
    def graph_adjacency(spark, d):
        return graph.snapshot(*make(spark, d))["adjacency"]

    @query("SELECT DISTINCT tgt_key AS ref_key, split_part(src_key, ':', 2)::BIGINT AS doc_id FROM edges WHERE relation = 'references'", *views)
    def graph_referring(spark, d):
        return graph.snapshot(*make(spark, d))["referring"]

    rank = "CASE WHEN node_type = 'document' THEN (split_part(node_key, ':', 2)::BIGINT % 100) / 1000 ELSE 0.05::DOUBLE END"
    shown = f"""seen AS (SELECT node_key FROM nodes WHERE node_type = 'document' AND {user_sql.replace("folder", "folder_paths[1]")}),
      touching AS (SELECT tgt_key AS node_key FROM edges JOIN seen ON src_key = node_key UNION SELECT src_key FROM edges JOIN seen ON tgt_key = node_key),
      may AS (SELECT node_key, {rank} AS r FROM nodes WHERE node_type IN ('document', 'tag', 'norm') AND (node_key IN (FROM seen) OR node_type <> 'document' AND node_key IN (FROM touching))),
      shown AS (SELECT node_key FROM may ORDER BY r DESC, node_key LIMIT 40)"""

    def ranked(spark, d):
        nodes, edges = make(spark, d)
        own = F.when(F.col("node_type") == "document", (F.col("doc_id") % 100) / 1000).otherwise(0.05)
        return checkpointed(nodes.withColumn("pagerank", own).withColumn("community_id", F.col("node_type"))), checkpointed(edges)

    @query("SELECT node_key FROM shown", *views, shown)
    def graph_view_top(spark, d):
        return graph.graph_view(*ranked(spark, d), user, ["document", "tag", "norm"], 40)[0].select("node_key")

    @query("""SELECT (SELECT count(*) FROM shown) AS nodes_shown, (SELECT count(DISTINCT node_type) FROM nodes JOIN shown USING (node_key)) AS communities_shown, (SELECT count(*) FROM edges WHERE src_key IN (FROM shown) AND tgt_key IN (FROM shown)) AS edges_shown,
      (SELECT count(*) FROM nodes) AS nodes_total, (SELECT count(*) FROM edges) AS edges_total, (SELECT count(*) FROM may) > (SELECT count(*) FROM shown) AS truncated""", *views, shown)
    def graph_view_totals(spark, d):
        return graph.view_totals(*ranked(spark, d), user, ["document", "tag", "norm"], 40)


@query("SELECT src_key, tgt_key, relation, layer FROM (SELECT 'a' || vec_id AS src_key, 'b' || vec_id AS tgt_key, 'new' AS relation, 'L2' AS layer FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'a' || vec_id, 'b' || vec_id, 'old', 'L1' FROM embeddings WHERE vec_id % 3 = 0)")
def layer_replaced(spark, d):
    e = M.read(spark, d, "embeddings").selectExpr("vec_id", "concat('a', vec_id) as src_key", "concat('b', vec_id) as tgt_key", "'old' as relation", "if(vec_id % 3 = 0, 'L1', 'L2') as layer")
    new = e.where("vec_id % 2 = 0").withColumn("relation", F.lit("new")).withColumn("layer", F.lit("L2"))
    return graph.replace_layer(e, "L2", new).drop("vec_id")


@query("SELECT 'n' || vec_id AS node_key, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'old' END AS label, CASE WHEN vec_id % 3 <> 0 THEN vec_id / 2 END AS pagerank FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 <> 0")
def nodes_upserted(spark, d):
    rows = M.read(spark, d, "embeddings").selectExpr("vec_id", "concat('n', vec_id) as node_key")
    old = rows.where("vec_id % 3 <> 0").selectExpr("node_key", "'old' as label", "vec_id / 2 as pagerank", "1 as community_id", "0.5D as participation")
    return graph.upsert_nodes(old, rows.where("vec_id % 2 = 0").select("node_key", F.lit("new").alias("label"))).select("node_key", "label", "pagerank")


@query("SELECT least('document:' || src, 'document:' || dst) AS src_key, greatest('document:' || src, 'document:' || dst) AS tgt_key, 'similar_to' AS relation, 'L2' AS layer, w_eff FROM (SELECT vec_id AS src, vec_id + 7 AS dst, round(vec_id / 700, 4) AS w_eff FROM embeddings)")
def second_layer_edges(spark, d):
    return graph.second_layer(M.read(spark, d, "embeddings").selectExpr("vec_id as src", "vec_id + 7 as dst", "vec_id / 700 as score"), "similar_to")


@query("SELECT chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT vec_id AS chunk_id, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 3)::DOUBLE[]), 6) AS score FROM embeddings)) WHERE rank <= 12")
def dense_only(spark, d):
    vectors = M.vectors(spark, d)
    return retrieval.hybrid(vectors, " ", vectors.where("chunk_id = 3").first()["vector"], 12)


# ---- streams -------------------------------------------------------------------------------------------
def _streamed(spark, rows, make, mode: str):
    """A stream over rows that lie in files, run until it has read them, and what it has put out."""
    path, out = _scratch(spark, "stream-in"), _scratch(spark, "stream-out")
    rows.write.parquet(path)
    made = make(spark.readStream.schema(rows.schema).parquet(path))
    started = made.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    if mode == "append":
        started.outputMode("append").format("parquet").start(out).awaitTermination()
    else:
        started.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


@query("SELECT s AS start, s + INTERVAL 24 HOUR AS end, count(*) AS queries, round(avg(value), 6) AS avg_latency_ms FROM (SELECT value, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(unnest(range(24))) AS s FROM events) GROUP BY s")
def stream_rolling_metrics(spark, d):
    log = M.query_log(spark, d).select(F.col("created_at").cast("timestamp").alias("created_at"), "latency_ms")
    out = _streamed(spark, log, jobs.rolling_metrics, "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "queries", F.round("avg_latency_ms", 6).alias("avg_latency_ms"))


@query("SELECT DISTINCT doc_hash, folder FROM docs", M.DOCS_SQL)
def stream_first_files(spark, d):
    rows = M.docs(spark, d).select("doc_hash", "folder", F.lit("2024-01-01").cast("timestamp").alias("modificationTime"))
    return _streamed(spark, rows, jobs.first_of_each, "append").select("doc_hash", "folder")


@query("""WITH RECURSIVE w AS (SELECT user_id, min(ts) AS s FROM events GROUP BY user_id UNION ALL SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.s + INTERVAL 6 HOUR GROUP BY w.user_id),
  placed AS (SELECT e.user_id, e.event_id, e.ts, max(w.s) AS s FROM events e JOIN w ON w.user_id = e.user_id AND w.s <= e.ts GROUP BY ALL)
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) <= 3 AS allowed FROM placed""")
def stream_rate_limit(spark, d):
    events = M.query_log(spark, d).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return _streamed(spark, events, lambda s: jobs.rate_limit(s.withWatermark("ts", "40 days"), 3, 6 * 3600), "append")


@query("""WITH RECURSIVE w AS (SELECT user_id, min(ts) AS s FROM events GROUP BY user_id UNION ALL SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.s + INTERVAL 6 HOUR GROUP BY w.user_id),
  placed AS (SELECT e.user_id, e.event_id, e.ts, max(w.s) AS s FROM events e JOIN w ON w.user_id = e.user_id AND w.s <= e.ts GROUP BY ALL),
  decided AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) <= 3 AS allowed FROM placed)
  SELECT user_id, event_id, allowed FROM decided WHERE (epoch_us(ts) // 21600000000 + 1) * 21600000 <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)""")
def stream_settled_limits(spark, d):
    """Requests whose slot of six hours the watermark, an hour behind the latest one, has passed."""
    events = M.query_log(spark, d).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return _streamed(spark, events, lambda s: keyed.settled_limits(s.withWatermark("ts", "1 hour"), 3, 6 * 3600), "append")


@query("""WITH latest AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id)
  SELECT user_id::VARCHAR AS session_id, ts AS started FROM latest WHERE epoch_ms(ts) + 7200000 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""")
def stream_ended_sessions(spark, d):
    """Sessions, a user's each, that have been quiet for two hours; all events come in one batch."""
    events = M.query_log(spark, d).select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("started"))
    out = _streamed(spark, events, lambda s: keyed.ended_sessions(s.withWatermark("started", "1 hour"), 7200), "append")
    return out.select("session_id", F.col("started").cast("timestamp_ntz").alias("started"))
