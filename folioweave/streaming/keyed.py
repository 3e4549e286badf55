"""Streams whose keys keep state until their time has passed: limits in order of events, sessions that end.

Both run on ``transformWithStateInPandas``: state lies in RocksDB beside the executor and in the
checkpoint, and an event-time timer takes it away, so that a key at rest costs nothing. A key's rows
come as Arrow batches and are never gathered.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_in_rocks(spark: SparkSession) -> None:
    """New streams of the session keep their state in RocksDB, which states with timers need; a running or
    restarted stream stays with the store that its checkpoint names."""
    if spark.conf.get(_STORE, "") != _ROCKS:
        spark.conf.set(_STORE, _ROCKS)


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


#: Rows of a key that wait in one value of its state; more are dealt to slots.
FEW = 4096
_NONE = np.empty((0, 2), np.int64)


def _of(rows: bytes) -> np.ndarray:
    """Times and ids that a state has kept."""
    return np.frombuffer(bytes(rows), np.int64).reshape(-1, 2)


class _Limits(StatefulProcessor):
    """``window``: start of the open window and what it has allowed; ``few``: the rows that wait (times and ids),
    or whether they are dealt to slots; ``slots``: how many parts of rows wait in each slot of time;
    ``waiting``: those parts, by slot and number.

    Each call to the state is a message, so that a key with few rows makes one to read and one to write,
    whatever their slots. A slot is as long as a window, so that at most two windows meet in it: the end
    of the open one and one that opens there. A slot is decided as a whole once the watermark has passed it.
    """

    def __init__(self, limit: int, seconds: int, few: int = FEW) -> None:
        self.limit, self.length, self.few = limit, seconds * 1_000_000, few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, used long")
        self.held = handle.getValueState("few", "dealt boolean, rows binary")
        self.slots = handle.getMapState("slots", "slot long", "parts long")
        self.waiting = handle.getMapState("waiting", "slot long, part long", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        dealt, held = self.held.get() or (False, b"")
        held, parts, fresh = _of(held), self._counts() if dealt else {}, set()
        waited = self._next(held, parts)
        for frame in rows:
            held = np.concatenate([held, np.column_stack([_micros(frame["ts"]), frame["event_id"].to_numpy(np.int64)])])
            if dealt or len(held) > self.few:
                fresh |= self._deal(held, parts)
                dealt, held = True, _NONE
        for slot in fresh:
            self.slots.updateValue((slot,), (parts[slot],))
        self.held.update((dealt, held.tobytes()))
        after = self._next(held, parts)
        if after is not None and (waited is None or after < waited):
            self.handle.registerTimer((after + 1) * self.length // 1000)
        yield from ()

    def _counts(self) -> dict[int, int]:
        return {slot: n for (slot,), (n,) in self.slots.iterator()}

    def _next(self, held: np.ndarray, parts: dict[int, int]) -> int | None:
        """The first slot in which rows wait."""
        return min(parts, default=None) if parts else int(held[:, 0].min()) // self.length if len(held) else None

    def _deal(self, rows: np.ndarray, parts: dict[int, int]) -> set[int]:
        """Puts rows into their slots, a part each, and counts the parts; returns the slots."""
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        slots, at = np.unique(rows[:, 0] // self.length, return_index=True)
        for slot, part in zip(slots.tolist(), np.split(rows, at[1:]), strict=True):
            self.waiting.updateValue((slot, parts.get(slot, 0)), (part.tobytes(),))
            parts[slot] = parts.get(slot, 0) + 1
        return set(slots.tolist())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Decides all slots that have passed, and sets a timer for what is left."""
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        before = window = self.window.get()
        dealt, held = self.held.get() or (False, b"")
        held, parts = _of(held), {}
        if dealt:
            parts = self._counts()
            for slot in sorted(s for s in parts if (s + 1) * self.length <= now):
                window = yield from self._decided(key[0], slot, parts.pop(slot), window)
        else:
            passed = held[:, 0] // self.length < now // self.length
            if passed.any():
                ids, allowed, window = self._few(held[passed], window)
                yield self._rows(key[0], ids, allowed)
                held = held[~passed]
        after = self._next(held, parts)
        if window and window[0] + self.length <= now and (after is None or after * self.length >= window[0] + self.length):
            window = None
        if window:
            self.window.update(window)
        elif before:
            self.window.clear()
        if after is not None:
            self.held.update((bool(parts), held.tobytes()))
        else:
            self.held.clear()
        if after is not None:
            self.handle.registerTimer((after + 1) * self.length // 1000)
        elif window:
            self.handle.registerTimer(-(-(window[0] + self.length) // 1000))

    def _few(self, rows: np.ndarray, window: tuple | None) -> tuple[np.ndarray, list[bool], tuple]:
        """The ids of rows, whether they are allowed, and the window that is open after them."""
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        (start, used), allowed = window or (-1 << 62, 0), []
        for at in rows[:, 0].tolist():
            if at >= start + self.length:
                start, used = at, 0
            allowed.append(used < self.limit)
            used += allowed[-1]
        return rows[:, 1], allowed, (start, used)

    def _parts(self, slot: int, parts: int) -> Iterator[list[list[int]]]:
        for number in range(parts):
            yield _of(self.waiting.getValue((slot, number))[0]).tolist()

    def _decided(self, user, slot: int, parts: int, window: tuple | None) -> Iterator[pd.DataFrame]:
        """The rows of a slot, part by part, and then the window that is open: one reading finds where the next
        window opens, one keeps the first rows of each window and gives out the others at once."""
        rows_of = list(self._parts(slot, 1)) if parts == 1 else None  # a single part is read once
        end = -1 << 62 if window is None else window[0] + self.length
        opens = min((at for rows in rows_of or self._parts(slot, parts) for at, _ in rows if at >= end), default=None)
        first: dict[bool, list[tuple[int, int]]] = {False: [], True: []}  # of the window before and of the one that opens; negative, the last one on top
        room = {False: self.limit - window[1] if window else 0, True: self.limit}
        for rows in rows_of or self._parts(slot, parts):
            denied = []
            for at, event in rows:
                new = at >= end
                if len(first[new]) < room[new]:
                    heapq.heappush(first[new], (-at, -event))
                else:
                    denied.append(-heapq.heappushpop(first[new], (-at, -event))[1] if room[new] > 0 else event)
            if denied:
                yield self._rows(user, denied, False)
        yield self._rows(user, [-event for kept in first.values() for _, event in kept], True)
        for number in range(parts):
            self.waiting.removeKey((slot, number))
        self.slots.removeKey((slot,))
        return (opens, len(first[True])) if opens is not None else (window[0], window[1] + len(first[False]))

    @staticmethod
    def _rows(user, ids: list[int] | np.ndarray, allowed: bool | list[bool]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": pd.Series([user] * len(ids), dtype="Int64"), "event_id": pd.Series(ids, dtype="int64"), "allowed": allowed})


def settled_limits(requests: DataFrame, limit: int = 60, seconds: int = 60, few: int = FEW) -> DataFrame:
    """user_id, event_id, allowed of every request by the rule of ``listing.rate_limit``, in order of events.

    ``requests``: user_id, event_id, ts (with a watermark). ``jobs.rate_limit`` answers at once, in the
    order of arrival; here a request waits until the watermark has passed its slot of ``seconds``, so
    that late ones take their place: the rows are those of the batch rule over all requests that
    were not too late. A task holds ``limit`` rows of two windows, ``few`` rows that wait and one Arrow batch,
    however many requests a user sends. Requests without a time or an id are left out; users without an id are one user.
    """
    keep_in_rocks(requests.sparkSession)
    rows = requests.select("user_id", "event_id", "ts").where("ts is not null and event_id is not null")
    return rows.groupBy("user_id").transformWithStateInPandas(_Limits(limit, seconds, few), "user_id long, event_id long, allowed boolean", "append", "EventTime")


class _Sessions(StatefulProcessor):
    """``last``: the latest start of the session; its timer moves with it."""

    def __init__(self, seconds: int) -> None:
        self.wait = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "started long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.last.get()[0] if self.last.exists() else None
        new = max(int(_micros(frame["started"]).max()) for frame in rows)
        if old is None or new > old:
            if old is not None:
                self.handle.deleteTimer(old // 1000 + self.wait)
            self.last.update((new,))
            self.handle.registerTimer(new // 1000 + self.wait)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (started,) = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"session_id": [key[0]], "started": pd.to_datetime([started], unit="us")})


def ended_sessions(starts: DataFrame, seconds: int = 3600) -> DataFrame:
    """session_id and started of each session once its time has passed, with state that leaves with it.

    ``starts``: session_id, started (with a watermark). A start within the time of an earlier one
    moves the end; one after the end is a new session. Starts without a time are left out.
    """
    keep_in_rocks(starts.sparkSession)
    rows = starts.select("session_id", "started").where("started is not null")
    return rows.groupBy("session_id").transformWithStateInPandas(_Sessions(seconds), "session_id string, started timestamp", "append", "EventTime")
