"""Streams: watched folders, rate limits, rolling metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioweave.sources.files import parse_files


def watch_folder(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Every new file under a folder, once; later changes of a file are not seen."""
    schema = spark.read.format("binaryFile").load(path).schema
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)


def ingest(files: DataFrame, checkpoint: str, store: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Parses files as they come; good ones go to ``store``, failed ones to ``dead``, each with the batch's
    id, so that a repeated batch can be recognised."""

    def batch(df: DataFrame, number: int) -> None:
        parsed = parse_files(df).persist()
        store(parsed.where("error is null"), number)
        dead(parsed.where("error is not null"), number)
        parsed.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limit(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """user_id, event_id, allowed: the window of a key starts with its first request and is forgotten
    when it has passed. ``requests``: user_id, event_id, ts (with a watermark)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        allowed = []
        for ts in (rows["ts"].astype("int64") // 1000).tolist():
            ts = int(ts)
            if start is None or ts - start >= seconds * 1_000_000:
                start, used = ts, 0
            allowed.append(used < limit)
            used += 1
        state.update((start, used))
        state.setTimeoutTimestamp(max(start // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "allowed": allowed})

    requests = requests.select("user_id", "event_id", F.col("ts"))
    return requests.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, allowed boolean", "start long, used long", "append", GroupStateTimeout.EventTimeTimeout)


def rolling_metrics(log: DataFrame, late: str = "10 minutes", window: str = "1 day", slide: str = "1 hour") -> DataFrame:
    """Queries and mean latency in sliding windows of event time."""
    return log.withWatermark("created_at", late).groupBy(F.window("created_at", window, slide)).agg(F.count("*").alias("queries"), F.avg("latency_ms").alias("avg_latency_ms")).select("window.start", "window.end", "queries", "avg_latency_ms")


def first_of_each(files: DataFrame, at: str = "modificationTime", late: str = "1 day") -> DataFrame:
    """Each hash and folder once within the watermark."""
    return files.withWatermark(at, late).dropDuplicatesWithinWatermark(["doc_hash", "folder"])


def expired_sessions(starts: DataFrame, seconds: int = 3600) -> DataFrame:
    """session_id and started of each session once its time has passed; a session that starts again counts anew
    from then. ``starts``: session_id, started (with a watermark)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (started,) = state.get
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "started": pd.to_datetime([started], unit="us")})
            return
        latest = max(int(frame["started"].astype("int64").max()) // 1000 for frame in frames)
        if state.exists:
            latest = max(latest, state.get[0])
        state.update((latest,))
        state.setTimeoutTimestamp(max(latest // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return starts.select("session_id", "started").groupBy("session_id").applyInPandasWithState(run, "session_id string, started timestamp", "started long", "append", GroupStateTimeout.EventTimeTimeout)
