"""Filter dictionaries, access filters, list filters and result shaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioweave.functions import text as T
from folioweave.functions.folders import Principal, normalize_folder, restrict


def compile_filter(condition: dict) -> Column:
    """A column from a nested filter: ``{"operator": "AND"|"OR", "conditions": [...]}`` over leaves
    ``{"field", "operator": "=="|"in", "value"}``; a ``meta.`` prefix of fields is dropped.

    Fails closed: an empty ``in`` matches nothing and an unknown operator is an error.
    """
    operator = condition["operator"]
    if "conditions" in condition:
        parts = [compile_filter(c) for c in condition["conditions"]]
        if operator not in ("AND", "OR"):
            raise ValueError(f"unknown operator {operator}")
        return reduce((lambda a, b: a & b) if operator == "AND" else (lambda a, b: a | b), parts, F.lit(operator == "AND") if not parts else parts.pop(0))
    column = F.col(condition["field"].removeprefix("meta."))
    if operator == "==":
        return column == F.lit(condition["value"])
    if operator == "in":
        return column.isin(list(condition["value"])) if condition["value"] else F.lit(False)
    raise ValueError(f"unknown operator {operator}")


def access_filter(folders: list[str] | None, doc_type: str | None = None, language: str | None = None) -> Column:
    """None: all folders, an empty list: none. Equality drops rows without a type or language."""
    out = F.lit(True) if folders is None else F.col("folder").isin(folders) if folders else F.lit(False)
    for name, value in (("doc_type", doc_type), ("language", language)):
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def listed(docs: DataFrame, folder: str | None = None, prefix: str | None = None, status: str | None = None, name: str | None = None) -> DataFrame:
    """The documents of a list; ``name`` is a part of the file name in any case, taken literally."""
    if folder is not None:
        docs = docs.where(F.col("folder") == folder)
    if prefix is not None:
        docs = docs.where(F.startswith("folder", F.lit(prefix)))
    if status is not None:
        docs = docs.where(F.col("status") == status)
    if name is not None:
        docs = docs.where(F.contains(F.lower("file_name"), F.lit(name.lower())))
    return docs


def list_page(docs: DataFrame, folder: str | None = None, prefix: str | None = None, status: str | None = None, name: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of the documents of a list, newest first."""
    found = listed(docs, folder, prefix, status, name)
    return found.orderBy(F.desc("uploaded_at"), "doc_id").offset(max(0, offset)).limit(min(1000, max(1, limit)))


def list_page_with_total(docs: DataFrame, limit: int = 200, offset: int = 0, **conditions) -> DataFrame:
    """A page and, on each of its rows, how many documents the whole list has."""
    total = listed(docs, **conditions).agg(F.count("*").alias("total"))
    return list_page(docs, limit=limit, offset=offset, **conditions).join(F.broadcast(total))  # one row


def scan_by_meta(chunks: DataFrame, condition: dict, limit: int = 10_000) -> DataFrame:
    return chunks.where(compile_filter(condition)).orderBy("chunk_id").limit(limit)


def unexpired(rows: DataFrame, now: Column, open_ended: bool = True) -> DataFrame:
    still = F.col("expires_at") > now
    return rows.where(still | F.col("expires_at").isNull() if open_ended else still)


def accepted_files(files: DataFrame, suffixes: tuple[str, ...] = ("pdf", "docx", "xlsx", "txt", "md", "html", "htm"), max_bytes: int = 50 << 20) -> tuple[DataFrame, DataFrame]:
    """(accepted, skipped) by suffix and size."""
    good = F.lower(F.regexp_extract("file_name", r"\.([^./]+)$", 1)).isin(*suffixes) & (F.col("size_bytes") <= max_bytes)
    return files.where(good), files.where(~F.coalesce(good, F.lit(False)))


def sanitize(rows: DataFrame, principal: Principal) -> DataFrame:
    """The last barrier before results leave: rows outside the principal's folders go."""
    return restrict(rows.withColumn("folder", normalize_folder("folder")), principal)


def content_budget(rows: DataFrame, budget: int, rank: str = "rank") -> DataFrame:
    """All rows of the first ``budget`` distinct documents in result order; 0 and less: all."""
    if budget <= 0:
        return rows
    first = F.min(rank).over(W.partitionBy("doc_id"))
    # results are at most a few hundred rows: top k of a search
    return rows.withColumn("__first", first).withColumn("__nth", F.dense_rank().over(W.orderBy("__first"))).where(F.col("__nth") <= budget).drop("__first", "__nth")


def with_status(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``outdated`` and ``superseded_by`` as the documents have them now."""
    now = docs.select("doc_id", (F.col("valid_status") == "superseded").alias("outdated"), "superseded_by")
    return rows.join(now, "doc_id", "left").withColumn("outdated", F.coalesce("outdated", F.lit(False)))


def scrub_references(rows: DataFrame, visible: DataFrame) -> DataFrame:
    """``superseded_by`` becomes null where the document that it names isn't visible."""
    seen = visible.select(F.col("doc_id").alias("__seen")).distinct()
    return rows.join(seen, rows["superseded_by"] == seen["__seen"], "left").withColumn("superseded_by", F.col("__seen")).drop("__seen")


def only_current(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce("outdated", F.lit(False)))


def with_citation(rows: DataFrame) -> DataFrame:
    return rows.withColumn("citation", T.citation(F.col("file_name"), F.col("page"), F.col("section_path"), F.col("section_title")))


def chunk_payload(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The search table's rows from canonical chunks: the folder is the chunk's, tags and type the document's."""
    own = docs.select("doc_id", "file_name", "tags", "doc_type", "norm_id", "doc_version", "language")
    title = F.nullif(F.element_at(F.split("section_path", " › "), -1), F.lit(""))
    kind = F.lower(F.coalesce(F.nullif(F.regexp_extract("file_name", r"\.([^./]+)$", 1), F.lit("")), F.lit("unknown")))
    return chunks.join(own, "doc_id").withColumn("section_title", title).withColumn("source_type", kind)


def snippets(chunks: DataFrame, chars: int = 300) -> DataFrame:
    """The head of each document's first chunk, by page, then position."""
    return chunks.groupBy("doc_id").agg(F.min_by(F.substring("text", 1, chars), F.struct(F.coalesce("page", F.lit(0)), "ordinal")).alias("snippet"))
