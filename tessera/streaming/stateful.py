"""Keyed state with event-time timers: circuits of hosts and leases of tasks as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.state import breaker_key

#: Seconds of a first rest, of the longest, of the least after a ban.
FIRST_REST, LONGEST_REST, BAN_REST = 30, 86_400, 900
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(t: pd.Series) -> list[int]:
    return pd.to_datetime(t).astype("datetime64[us]").astype("int64").tolist()


class _Circuit(StatefulProcessor):
    """Failures since the last success. Those behind the watermark are a count, since no success can come between them any more; the others stay as rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._past = handle.getValueState("past", "ok long, n long, last long, blocked boolean, version long")
        self._recent = handle.getListState("recent", "at long, blocked boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ok, n, last, blocked, version = self._past.get() if self._past.exists() else (-(2**62), 0, -(2**62), False, 0)
        recent = [tuple(r) for r in self._recent.get()] if self._recent.exists() else []
        for part in rows:
            for at, good, ban in zip(_micros(part["at"]), part["ok"].tolist(), part["blocked"].tolist()):
                if good:
                    ok = max(ok, at)
                else:
                    recent.append((at, bool(ban)))
        if last <= ok:
            n, last, blocked = 0, -(2**62), False
        recent = sorted(r for r in recent if r[0] > ok)
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        while recent and recent[0][0] < mark:
            at, ban = recent.pop(0)
            n += 1
            if at >= last:
                last, blocked = at, ban
        self._past.update((ok, n, last, blocked, version + 1))
        if recent:
            self._recent.put(recent)
        else:
            self._recent.clear()
        streak = n + len(recent)
        at, ban = recent[-1] if recent else (last, blocked)
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        until = None
        if streak:
            rest = min(LONGEST_REST, FIRST_REST * 2.0**streak)
            until = at + int((max(BAN_REST, rest) if ban else rest) * 1_000_000)
            self._handle.registerTimer(max(until // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "version": [version + 1], "streak": [streak], "rests_us": pd.array([until], dtype="Int64"), "free": [not streak]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The rest is over: the host may be asked again; its failures still count until a success."""
        ok, n, last, blocked, version = self._past.get()
        streak = n + (len(list(self._recent.get())) if self._recent.exists() else 0)
        self._past.update((ok, n, last, blocked, version + 1))
        yield pd.DataFrame({"key": [key[0]], "version": [version + 1], "streak": [streak], "rests_us": pd.array([None], dtype="Int64"), "free": [True]})

    def close(self) -> None:
        pass


def circuits(ends: DataFrame, late: str) -> DataFrame:
    """Stream of (url, at, ok, blocked) -> (key, version, streak, rests_us, free): a row for each change of a host's circuit, and one when its rest is over by event time.

    Rows may be late by `late`; of a key the row of the highest version holds. The session needs the RocksDB state store (ROCKS).
    """
    rows = ends.withWatermark("at", late).select(breaker_key("url").alias("key"), "at", "ok", F.coalesce("blocked", F.lit(False)).alias("blocked"))
    return rows.groupBy("key").transformWithStateInPandas(_Circuit(), "key string, version long, streak long, rests_us long, free boolean", "Update", "EventTime")


class _Lease(StatefulProcessor):
    """A task's lease: it ends when the task is done, or by a timer; then the task is queued again, or failed after so many tries."""

    def __init__(self, seconds: int, most: int) -> None:
        self._seconds, self._most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._task = handle.getValueState("task", "status string, tries long, until long, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, tries, until, version = self._task.get() if self._task.exists() else ("queued", 0, 0, 0)
        events = sorted(x for part in rows for x in zip(_micros(part["at"]), part["event"].tolist()))
        for at, event in events:
            if status == "leased" and until <= at:  # it ended before this, though the timer has not fired yet
                tries, status = tries + 1, "failed" if tries + 1 >= self._most else "queued"
            if event == "claim" and status == "queued":
                status, until = "leased", at + self._seconds * 1_000_000
            elif event == "done" and status == "leased":
                status = "done"
        yield self._kept(key, status, tries, until, version, timerValues)

    def _kept(self, key, status, tries, until, version, timerValues) -> pd.DataFrame:
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if status == "leased":
            self._handle.registerTimer(max(until // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        self._task.update((status, tries, until, version + 1))
        return pd.DataFrame({"id": [key[0]], "version": [version + 1], "status": [status], "attempts": [tries]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, tries, until, version = self._task.get()
        yield self._kept(key, "failed" if tries + 1 >= self._most else "queued", tries + 1, until, version, timerValues)

    def close(self) -> None:
        pass


def leases(events: DataFrame, late: str, seconds: int = 300, most: int = 3) -> DataFrame:
    """Stream of (id, at, event: claim or done) -> (id, version, status, attempts): a row for each change, also those that a lease's end makes."""
    rows = events.withWatermark("at", late).select("id", "at", "event")
    return rows.groupBy("id").transformWithStateInPandas(_Lease(seconds, most), "id long, version long, status string, attempts long", "Update", "EventTime")
