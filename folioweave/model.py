"""The library's tables derived from the synthetic ones, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a collection's documents."""
    return read(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat('/', lang, '/', source, '/') as folder", "concat('doc_', doc_id, '.txt') as file_name", "sha2(text, 256) as doc_hash", "n_chars as size_bytes", "lang as language",
        "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(doc_id as int)) as uploaded_at", "if(doc_id % 20 = 0, 'failed', 'indexed') as status",
        "if(doc_id % 7 = 0, null, concat(element_at(array('ÖNORM B ', 'OENORM B', 'önorm b '), cast(doc_id % 3 + 1 as int)), 1000 + doc_id % 40, '-1')) as norm_id",
        "if(doc_id % 7 = 0, null, concat('önorm_b_', 1000 + doc_id % 40, '_1')) as norm_key", "if(doc_id % 11 = 0, null, cast(2000 + doc_id % 25 as string)) as doc_version",
        "array(lang, source) as tags", "cast(doc_id % 5 as int) as chunk_count", "if(doc_id % 2 = 0, 'norm', 'bericht') as doc_type", "if(doc_id % 3 = 0, null, 'Austrian Standards') as issuer", "text",
    )


DOCS_SQL = """docs AS (SELECT doc_id, '/' || lang || '/' || source || '/' AS folder, 'doc_' || doc_id || '.txt' AS file_name, sha256(text) AS doc_hash, n_chars AS size_bytes, lang AS language,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS uploaded_at, CASE WHEN doc_id % 20 = 0 THEN 'failed' ELSE 'indexed' END AS status,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE ['ÖNORM B ', 'OENORM B', 'önorm b '][doc_id % 3 + 1] || (1000 + doc_id % 40) || '-1' END AS norm_id,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'önorm_b_' || (1000 + doc_id % 40) || '_1' END AS norm_key, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(2000 + doc_id % 25 AS VARCHAR) END AS doc_version,
  [lang, source] AS tags, CAST(doc_id % 5 AS INTEGER) AS chunk_count, CASE WHEN doc_id % 2 = 0 THEN 'norm' ELSE 'bericht' END AS doc_type, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Austrian Standards' END AS issuer, text FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as chunks."""
    parts = read(spark, sf_dir, "documents").selectExpr("doc_id", "concat('/', lang, '/', source, '/') as folder", "concat('doc_', doc_id, '.txt') as file_name", "lang as language", "posexplode(split(text, '\\n')) as (ordinal, text)")
    return parts.where("text <> ''").selectExpr("concat(doc_id, '_', ordinal) as chunk_id", "doc_id", "folder", "file_name", "language", "ordinal", "cast(ordinal div 3 as int) as page", "text")


CHUNKS_SQL = """chunks AS (SELECT doc_id || '_' || ordinal AS chunk_id, doc_id, folder, file_name, language, ordinal, CAST(ordinal // 3 AS INTEGER) AS page, text FROM (
  SELECT doc_id, '/' || lang || '/' || source || '/' AS folder, 'doc_' || doc_id || '.txt' AS file_name, lang AS language, unnest(range(len(string_split(text, chr(10))))) AS ordinal, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE text <> '')"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id as chunk_id", "vec_id div 5 as doc_id", "embedding as vector", "label")


VECTORS_SQL = "vectors AS (SELECT vec_id AS chunk_id, vec_id // 5 AS doc_id, embedding AS vector, label FROM embeddings)"


def ref_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and a document's text after a line that names its norm, the next one and a paragraph."""
    named = "'Siehe ', coalesce(norm_id, 'nichts'), ':', coalesce(doc_version, '2000'), ' und DIN EN ISO ', 9000 + doc_id % 10, ' sowie § ', doc_id % 30, 'a. Art. ', doc_id % 9 + 1, '. '"
    return docs(spark, sf_dir).selectExpr("doc_id", f"concat({named}, coalesce(text, '')) as text")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id", "ts as created_at", "ts", "user_id", "event_type", "value as latency_ms", "props")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_custkey as job_id", "element_at(map('F', 'done', 'O', 'queued', 'P', 'failed'), o_orderstatus) as status", "if(o_orderstatus = 'P', concat('error ', o_orderkey), null) as error_msg", "concat('/', o_orderpriority, '/') as folder", "o_orderdate as created_at", "if(o_orderstatus = 'F', o_orderdate, null) as finished_at")


JOBS_SQL = "jobs AS (SELECT o_custkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'error ' || o_orderkey END AS error_msg, '/' || o_orderpriority || '/' AS folder, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS finished_at FROM orders)"
