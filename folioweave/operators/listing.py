"""Counts, overviews, metrics, duplicates and version status of a collection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioweave.functions import text as T
from folioweave.functions.folders import ancestors
from folioweave.session import checkpointed


def folder_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("folder").agg(F.count("*").alias("n"))


def folder_tree(docs: DataFrame) -> DataFrame:
    """Every folder and those above it, with the documents directly in it."""
    nodes = docs.select(F.explode(ancestors(F.col("folder"))).alias("folder")).distinct()
    return nodes.join(folder_counts(docs), "folder", "left").select("folder", F.coalesce("n", F.lit(0)).alias("n"))


def top_values(docs: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The most frequent values of a column, an array's elements each."""
    value = F.explode(column) if docs.schema[column].dataType.typeName() == "array" else F.col(column)
    return docs.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def overview(docs: DataFrame, top: int = 20) -> DataFrame:
    """One row: documents, chunks, and the folders, norms and tags by count."""
    done = docs.where("status = 'indexed'")
    pairs = lambda df, key: df.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col(key).alias("value")))).alias("x")).select(F.transform("x", lambda e: F.struct(e["value"].alias("value"), (-e["minus"]).alias("n"))))
    total = done.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))
    parts = [pairs(folder_counts(done), "folder").toDF("folders"), pairs(top_values(done, "norm_id", top), "value").toDF("norms"), pairs(top_values(done, "tags", top), "value").toDF("tags")]
    for part in parts:  # single rows
        total = total.join(part)
    return total


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Indexed documents; chunks and bytes of all documents."""
    return docs.agg(F.count_if(F.col("status") == "indexed").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def query_metrics(log: DataFrame, now) -> DataFrame:
    """Queries of the last day and week, and the week's mean latency, in one pass."""
    week = F.col("created_at") >= now - F.expr("interval 7 days")
    return log.agg(F.count_if(F.col("created_at") >= now - F.expr("interval 1 day")).alias("queries_24h"), F.count_if(week).alias("queries_7d"), F.avg(F.when(week, F.col("latency_ms"))).alias("avg_latency_ms"))


def index_metrics(docs: DataFrame) -> DataFrame:
    indexed, total = F.count_if(F.col("status") == "indexed"), F.count("*")
    return docs.agg(indexed.alias("indexed"), F.count_if(F.col("status") == "failed").alias("failed"), total.alias("total"), F.round(indexed / F.greatest(total, F.lit(1)) * 100, 1).alias("success_rate"))


def job_status(queue: DataFrame) -> DataFrame:
    """State and counts of every job: running while any file is open, else partial, failed or done.

    ``errors`` are the first 500 characters of all messages. A message and its bar take three at least, so
    that the first ``_MESSAGES`` of a job are all that is gathered.
    """
    done, failed, total = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "failed"), F.count("*")
    counted = queue.groupBy("job_id").agg(
        total.alias("total"), done.alias("done"), failed.alias("failed"), (total - done - failed).alias("pending"),
        F.min("folder").alias("folder"), F.min("created_at").alias("created_at"), F.max("finished_at").alias("finished_at"),
    )
    state = F.when(F.col("pending") > 0, "running").when((F.col("failed") > 0) & (F.col("done") > 0), "partial").when(F.col("failed") > 0, "failed").otherwise("done")
    messages = queue.where("error_msg is not null").select("job_id", "created_at", F.substring("error_msg", 1, 500).alias("error_msg"))
    first = messages.withColumn("nth", F.row_number().over(W.partitionBy("job_id").orderBy("created_at", "error_msg"))).where(F.col("nth") <= _MESSAGES)
    errors = first.groupBy("job_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "error_msg"))), lambda e: e["error_msg"]), " | "), 1, 500).alias("errors"))
    return counted.join(errors, "job_id", "left").withColumn("errors", F.coalesce("errors", F.lit(""))).withColumn("status", state)


_MESSAGES = 168


def next_in_queue(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'queued'").orderBy("created_at", "job_id").limit(1)


def duplicate_groups(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_hash").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_pairs(docs: DataFrame) -> DataFrame:
    """(keep, remove) for every copy: the oldest document of a hash stays.

    The keeper of a hash comes from an aggregate that combines before the shuffle, so a hash with
    very many copies isn't sorted in one window.
    """
    oldest = docs.groupBy("doc_hash").agg(F.min(F.struct("uploaded_at", "doc_id")).alias("first"), F.count("*").alias("n")).where("n > 1").select("doc_hash", F.col("first.doc_id").alias("keep"))
    return docs.join(oldest, "doc_hash").where("doc_id <> keep").select("keep", F.col("doc_id").alias("remove"), "doc_hash")


def new_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    return pairs.join(known.select("keep", "remove"), ["keep", "remove"], "left_anti")


def version_status(docs: DataFrame) -> DataFrame:
    """valid_status and superseded_by: the newest year of a norm is current, older ones point to it."""
    dated = docs.withColumn("year", T.version_year(F.col("doc_version")))
    known = dated.where("norm_key is not null and year is not null")
    newest = known.groupBy("norm_key").agg(F.max(F.struct("year", (-F.col("doc_id")).alias("minus"))).alias("newest")).select("norm_key", F.col("newest.year").alias("newest_year"), (-F.col("newest.minus")).alias("newest_id"))
    status = F.when(F.col("year").isNull() | F.col("newest_year").isNull(), "unknown").when(F.col("year") == F.col("newest_year"), "current").otherwise("superseded")
    joined = dated.join(newest, "norm_key", "left").withColumn("valid_status", status)
    return joined.withColumn("superseded_by", F.when(F.col("valid_status") == "superseded", F.col("newest_id"))).drop("newest_year", "newest_id")


def newest_of_norms(docs: DataFrame) -> DataFrame:
    """norm_key, newest (minus the year, doc_id of the first document of it) of documents whose norm and year are known."""
    year = T.version_year(F.col("doc_version"))
    return docs.select("norm_key", F.struct((-year).alias("minus"), "doc_id").alias("newest")).where("norm_key is not null and newest.minus is not null").groupBy("norm_key").agg(F.min("newest").alias("newest"))


def with_newest(docs: DataFrame, newest: DataFrame) -> DataFrame:
    """``version_status`` of documents from the newest one of each norm."""
    year = T.version_year(F.col("doc_version"))
    joined = docs.join(newest, "norm_key", "left").withColumn("year", year)
    status = F.when(F.col("year").isNull() | F.col("newest").isNull(), "unknown").when(F.col("year") == -F.col("newest.minus"), "current").otherwise("superseded")
    return joined.withColumn("valid_status", status).withColumn("superseded_by", F.when(F.col("valid_status") == "superseded", F.col("newest.doc_id"))).drop("newest")


def new_files(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Files that their folder doesn't have yet, one for each hash and folder."""
    return files.dropDuplicates(["doc_hash", "folder"]).join(docs.select("doc_hash", "folder"), ["doc_hash", "folder"], "left_anti")


def full_texts(parts: DataFrame, separator: str = "\n\n") -> DataFrame:
    """The parts of each document joined in order."""
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda p: p["text"]), separator).alias("text"))


def neighbour_links(parts: DataFrame) -> DataFrame:
    """The part before and after each part of a document."""
    order = W.partitionBy("doc_id").orderBy("ordinal")
    return parts.withColumn("prev_id", F.lag("chunk_id").over(order)).withColumn("next_id", F.lead("chunk_id").over(order))


def keywords(docs: DataFrame, top: int = 10) -> DataFrame:
    """doc_id, rank, word, n, score: the words of each document that occur at least twice, best first."""
    words = docs.select("doc_id", F.posexplode(T.keyword_candidates(F.col("text"))).alias("pos", "word"))
    words = words.select("doc_id", "pos", T.keyword(F.col("word")).alias("word")).where("word is not null")
    counted = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n >= 2").withColumn("score", T.keyword_score(F.col("word"), F.col("n")))
    return counted.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "first"))).where(F.col("rank") <= top).drop("first")


def auto_tags(docs: DataFrame, most: int = 7) -> DataFrame:
    """Family tags first, then keywords, at most seven, each once."""
    best = keywords(docs).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda w: F.substring(w["word"], 1, 64)).alias("words"))
    none = F.array().cast("array<string>")
    return docs.select("doc_id", T.family_tags(F.col("text")).alias("families")).join(best, "doc_id", "left").select("doc_id", F.slice(F.array_distinct(F.concat(F.coalesce("families", none), F.coalesce("words", none))), 1, most).alias("tags"))


def recent_values(log: DataFrame, value: str, at: str = "created_at", most: int = 8) -> DataFrame:
    """The values used last, each once."""
    return log.groupBy(value).agg(F.max(at).alias("last")).orderBy(F.desc("last"), value).limit(most)


def retained(log: DataFrame, now, days: int = 90) -> DataFrame:
    """The rows that a retention keeps; 0 days keep everything."""
    return log if days == 0 else log.where(F.col("created_at") >= now - F.make_interval(days=F.lit(days)))


def version_token(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row that changes when either table does."""
    stamp = lambda df, p: df.agg(F.count("*").alias(f"{p}_count"), F.max("created_at").alias(f"{p}_last"))
    return stamp(nodes, "node").join(stamp(edges, "edge"))


def ingest_report(chunks: DataFrame) -> DataFrame:
    """Chunks of each document by level, and what looks wrong with them."""
    child, parent = F.col("level") == "child", F.col("level") == "parent"
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(child).alias("children"), F.count_if(parent).alias("parents"), F.count_if(child & (F.length(F.trim("text")) < 80)).alias("short"))
    none = F.array().cast("array<string>")
    return counted.withColumn("warnings", F.concat(F.when(F.col("children") == 0, F.array(F.lit("no text"))).otherwise(none), F.when(F.col("short") > F.col("children") / 2, F.array(F.lit("mostly short chunks"))).otherwise(none)))


def rate_limit(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """user_id, event_id and ``allowed`` of each request: a window opens with a key's first request and
    again with the first one after it has passed; the first ``limit`` of a window are allowed.

    Requests stream by in order, sorted by Spark, so that a task holds the open window alone.
    streaming/jobs.py has the same rule with kept state.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, start, used = None, 0, 0
        for frame in frames:
            allowed = []
            for key, at in zip(frame["user_id"], frame["at"], strict=True):
                if key != user or at - start >= seconds * 1_000_000:
                    user, start, used = key, at, 0
                allowed.append(used < limit)
                used += 1
            yield pd.DataFrame({"user_id": frame["user_id"], "event_id": frame["event_id"], "allowed": allowed})

    rows = requests.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(run, "user_id long, event_id long, allowed boolean")


def suggestion_list(suggestions: DataFrame) -> DataFrame:
    """Suggestions with their place in a list by community, then folder, then document."""
    return _placed(suggestions, F.col("community_id").asc_nulls_last(), "suggested_folder", "doc_id")


def log_list(log: DataFrame, limit: int = 100, key: str = "event_id") -> DataFrame:
    """The latest entries of a log with their place, newest first."""
    return _placed(log.orderBy(F.desc("created_at"), key).limit(limit), F.desc("created_at"), key)


def _placed(rows: DataFrame, *order) -> DataFrame:
    """``place`` by an order of all rows: rows are counted in ranges, and each range is numbered by itself."""
    ranged = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = checkpointed(ranged)  # a range must be the same in both of the uses below
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each partition
    nth = F.row_number().over(W.partitionBy("range").orderBy(*order))
    return ranged.withColumn("nth", nth).join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.col("nth")).drop("range", "nth", "before")


def admins(users: DataFrame) -> DataFrame:
    """One row: how many administrators there are, and whether one may still be taken away."""
    return users.agg(F.count_if(F.col("role") == "admin").alias("admins")).withColumn("may_remove", F.col("admins") > 1)


def loggable(queries: DataFrame) -> DataFrame:
    """Rows of a query log: texts of at most 4,000 characters, with the day that they are filed under."""
    return queries.withColumn("query_text", F.substring("query_text", 1, 4000)).withColumn("day", F.to_date("created_at"))


def append_log(queries: DataFrame, path: str, batch: int) -> None:
    """Files a batch of queries; a batch that is written again replaces itself and nothing else."""
    loggable(queries).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def session_states(sessions: DataFrame, now, live_seconds: int = 3600, kept_seconds: int = 7200) -> DataFrame:
    """``state`` of sessions: live for an hour from their start, then expired, and gone after two."""
    age = F.unix_seconds(now) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    return sessions.withColumn("state", F.when(age < live_seconds, "live").when(age < kept_seconds, "expired").otherwise("gone"))


def next_run(now, hour: int):
    """The next time of day at a full hour after now."""
    today = F.date_trunc("day", now) + F.make_interval(hours=F.lit(hour))
    return F.when(today > now, today).otherwise(today + F.expr("interval 1 day"))
