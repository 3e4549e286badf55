"""Streams with kept state: equal to the rules over all rows, and state that leaves."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioweave.operators import listing
from folioweave.streaming import keyed


def fed(spark, tmp_path, batches, schema, time, delay, transform):
    """Rows of a stream over batches that arrive one by one, and its rows of state after each."""
    left = []
    for batch in batches:
        spark.createDataFrame(batch, schema).withColumn(time, F.timestamp_micros(time)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")).withWatermark(time, delay)
        q = transform(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        left.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    return spark.read.parquet(str(tmp_path / "out")), left


def test_settled_limits_with_late_events(spark, tmp_path):
    rng, second = random.Random(4), 1_000_000
    rows = [(1 if rng.random() < 0.4 else rng.choice([None, *range(2, 7)]), i, int(rng.uniform(0, 900)) * second // 2 + 1_700_000_000 * second) for i in range(1500)]
    rows.sort(key=lambda r: r[2] + rng.uniform(0, 100) * second)  # up to 100 seconds late
    last = max(r[2] for r in rows) + 86_400 * second
    schema = "user_id long, event_id long, ts long"
    batches = [rows[:500], rows[500:1000] + [(1, None, rows[0][2]), (1, 7, None)], rows[1000:], [(99, 5000, last)]]
    got, left = fed(spark, tmp_path, batches, schema, "ts", "120 seconds", lambda s: keyed.settled_limits(s, 5, 20))
    want = listing.rate_limit(spark.createDataFrame([(-1 if u is None else u, e, t) for u, e, t in rows], schema).withColumn("ts", F.timestamp_micros("ts")), 5, 20)
    found = sorted((-1 if r["user_id"] is None else r["user_id"], r["event_id"], r["allowed"]) for r in got.collect())
    assert found == sorted(map(tuple, want.select("user_id", "event_id", "allowed").collect()))
    assert 0 < sum(allowed for _, _, allowed in found) < len(rows) == len(found)
    assert max(left[:3]) > 10 and left[3] <= 4  # what is left belongs to the last request alone


def test_settled_limits_of_one_user_in_small_batches(spark, tmp_path):
    """A hot user's slot comes in many parts, with equal times; ids decide among these."""
    second = 1_000_000
    rows = [(1, i, 1_700_000_000 * second + (i * 7919 % 40) * second) for i in range(2000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got, left = fed(spark, tmp_path, [rows, [(2, 5000, 1_800_000_000 * second)]], "user_id long, event_id long, ts long", "ts", "0 seconds", lambda s: keyed.settled_limits(s, 60, 30))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = listing.rate_limit(spark.createDataFrame(rows, "user_id long, event_id long, ts long").withColumn("ts", F.timestamp_micros("ts")), 60, 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("allowed").count() == 120


def test_settled_limits_dealt_to_slots(spark, tmp_path):
    """A user with more rows than wait in one value, and others with fewer."""
    second = 1_000_000
    rows = [(1 if i % 3 else 2 + i % 11, i, 1_700_000_000 * second + (i * 7919 % 400) * second) for i in range(1500)]
    batches = [rows[:700], rows[700:], [(99, 5000, 1_800_000_000 * second)]]
    got, _ = fed(spark, tmp_path, batches, "user_id long, event_id long, ts long", "ts", "1000 seconds", lambda s: keyed.settled_limits(s, 5, 30, few=64))
    want = listing.rate_limit(spark.createDataFrame(rows, "user_id long, event_id long, ts long").withColumn("ts", F.timestamp_micros("ts")), 5, 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


class Kept:
    """One key's state and timers; counts the calls to them."""

    def __init__(self):
        self.calls, self.timers, self.maps = 0, set(), {}

    def getValueState(self, name, schema):
        def update(value):
            self.calls, self.maps[name] = self.calls + 1, value

        def get():
            self.calls += 1
            return self.maps.get(name)

        return SimpleNamespace(get=get, update=update, exists=lambda: get() is not None, clear=lambda: update(None))

    def getMapState(self, name, key, value):
        rows = self.maps[name] = {}

        def called(what):
            def call(*args):
                self.calls += 1
                return what(*args)

            return call

        return SimpleNamespace(iterator=called(lambda: list(rows.items())), getValue=called(rows.get), updateValue=called(rows.__setitem__), removeKey=called(rows.pop))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


@pytest.mark.parametrize("few, most", [(4096, 12), (10, 10_000), (0, 10_000)])
def test_calls_to_the_state_do_not_follow_the_slots(few, most):
    """900 requests of a user in 300 slots: the same rows however they wait, and a few calls where one value holds them."""
    rng, second, limits, kept = random.Random(1), 1_000_000, keyed._Limits(2, 20, few), Kept()
    rows = [(int(rng.uniform(0, 6000)) * second, i) for i in range(900)]
    limits.init(kept)
    for part in (rows[:500], rows[500:]):
        list(limits.handleInputRows((1,), iter([pd.DataFrame({"ts": pd.to_datetime([t for t, _ in part], unit="us"), "event_id": [i for _, i in part]})]), None))
    out = []
    for now in (2_000_000, 10_000_000):
        for at in [t for t in kept.timers if t <= now]:
            expired, values = SimpleNamespace(getExpiryTimeInMs=lambda at=at: at), SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now)
            out += [tuple(r) for frame in limits.handleExpiredTimer((1,), values, expired) for r in frame[["event_id", "allowed"]].values.tolist()]
            kept.timers.discard(at)
    start, used, want = None, 0, []
    for at, i in sorted(rows):
        if start is None or at >= start + 20 * second:
            start, used = at, 0
        want.append((i, used < 2))
        used += used < 2
    assert sorted(out) == sorted(want) and kept.calls <= most
    assert not kept.maps["slots"] and not kept.maps["waiting"]


def test_ended_sessions(spark, tmp_path):
    minute = 60_000_000
    t = 1_700_000_000_000_000
    batches = [[("a", t), ("b", t), ("b", t + 30 * minute), ("c", None)], [("a", t + 50 * minute)], [("d", t + 105 * minute)], [("b", t + 200 * minute), ("e", t + 900 * minute)]]
    got, left = fed(spark, tmp_path, batches, "session_id string, started long", "started", "0 seconds", lambda s: keyed.ended_sessions(s, 3600))
    rows = sorted((r[0], (r[1] - t) // minute) for r in got.select("session_id", F.unix_micros("started")).collect())
    assert rows == [("a", 50), ("b", 30), ("b", 200), ("d", 105)] and left[-1] <= 2
