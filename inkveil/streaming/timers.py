"""Leases and retention as state with timers, one job or message a key.

A machine is a pure function of a key's events in the order of their times; a timer is an event that nobody sends. What
is due before an event happens before it, whether its timer has fired yet or not, so results do not depend on how the
stream is cut into batches. A fired timer tells at once what the next event would have shown.

`Lease`: a message that is received is hidden for the lease; renewing starts the lease anew, releasing ends it after a short
delay, acknowledging ends the message. Unacknowledged, it comes back; the receipt after the third sends it to the dead
letters; after the queue's retention it is gone.

`Retention`: a job lives for its time or until its client deletes it; the tombstone stays until its blobs are confirmed
to be gone, which is asked for again at every sweep; then the job is expired."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "status string, since long, due long, receipts int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUT = "key long, at_ms long, outcome string, receipts int"
#: Of a message: how long it is hidden, and after a release; receipts before it is dead; how long the queue keeps it.
LEASE, DELAY, RECEIPTS, QUEUE_KEPT = 1800, 30, 3, 86400
#: Of a job: how long it lives, and how often its removal is tried.
LIFE, SWEEP = 3300, 300


class State(NamedTuple):
    status: str
    #: When it began and when something happens by itself; -1 for never.
    since: int
    due: int
    receipts: int


Told = list[tuple[int, str, int]]


class Lease:
    """States visible, hidden; no state before it is sent and after its end. Times in milliseconds, limits in seconds."""

    def __init__(self, lease: int = LEASE, delay: int = DELAY, receipts: int = RECEIPTS, kept: int = QUEUE_KEPT):
        self.lease, self.delay, self.most, self.kept = lease * 1000, delay * 1000, receipts, kept * 1000

    def on(self, s: State | None, kind: str, at: int) -> tuple[State | None, Told]:
        if s is None:
            return (State("visible", at, at + self.kept, 0), [(at, "sent", 0)]) if kind == "send" else (None, [])
        end = s.since + self.kept
        if s.status == "visible" and kind == "receive":
            if s.receipts == self.most:
                return None, [(at, "dead_letter", s.receipts)]
            return State("hidden", s.since, min(at + self.lease, end), s.receipts + 1), [(at, "claimed", s.receipts + 1)]
        if s.status == "hidden":
            if kind == "receive":
                return s, [(at, "held", s.receipts)]
            if kind == "renew":
                return s._replace(due=min(at + self.lease, end)), []
            if kind == "release":
                return s._replace(due=min(at + self.delay, end)), [(at, "released", s.receipts)]
            if kind == "acknowledge":
                return None, [(at, "done", s.receipts)]
        return s, []

    def fire(self, s: State) -> tuple[State | None, Told]:
        end = s.since + self.kept
        if s.due >= end:
            return None, [(end, "gone", s.receipts)]
        return State("visible", s.since, end, s.receipts), [(s.due, "returned", s.receipts)]


class Retention:
    """States live, deleted; no state before a job is made and after it is expired. `receipts` counts the sweeps."""

    def __init__(self, life: int = LIFE, sweep: int = SWEEP):
        self.life, self.sweep = life * 1000, sweep * 1000

    def on(self, s: State | None, kind: str, at: int) -> tuple[State | None, Told]:
        if s is None:
            return (State("live", at, at + self.life, 0), []) if kind == "create" else (None, [])
        if kind == "delete" and s.status == "live":
            return State("deleted", s.since, at + self.sweep, 0), [(at, "deleted", 0)]
        if kind == "cleaned" and s.status == "deleted":
            return None, [(at, "expired", s.receipts)]
        return s, []

    def fire(self, s: State) -> tuple[State | None, Told]:
        if s.status == "live":
            return State("deleted", s.since, s.due + self.sweep, 0), [(s.due, "deleted", 0)]
        return s._replace(due=s.due + self.sweep, receipts=s.receipts + 1), [(s.due, "sweep", s.receipts + 1)]


def run_due(machine: Any, s: State | None, until: int) -> tuple[State | None, Told]:
    """What happens by itself up to a time."""
    told: Told = []
    while s is not None and 0 <= s.due <= until:
        s, more = machine.fire(s)
        told += more
    return s, told


class TimedMachine(StatefulProcessor):
    """A machine's state and its one timer, which stands where something is due."""

    def __init__(self, machine: Any):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", STATE)

    def _get(self) -> State | None:
        return State(*self.state.get()) if self.state.exists() else None

    def _set(self, before: State | None, s: State | None) -> None:
        if before is not None and (s is None or s.due != before.due):
            self.handle.deleteTimer(before.due)
        if s is None:
            self.state.clear()
            return
        self.state.update(tuple(s))
        if before is None or s.due != before.due:
            self.handle.registerTimer(s.due)

    @staticmethod
    def _rows(key: tuple, told: Told) -> Iterator[pd.DataFrame]:
        if told:
            at, outcome, receipts = zip(*told, strict=True)
            yield pd.DataFrame({"key": [key[0]] * len(told), "at_ms": at, "outcome": outcome, "receipts": pd.array(receipts, "int32")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = s = self._get()
        told: Told = []
        frames = pd.concat(list(rows)).sort_values(["at", "ord"])
        for at, kind in zip(frames["at"], frames["kind"], strict=True):
            s, due = run_due(self.machine, s, int(at))
            s, more = self.machine.on(s, kind, int(at))
            told += due + more
        self._set(before, s)
        yield from self._rows(key, told)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        before = self._get()
        if before is None:
            return
        s, told = run_due(self.machine, before, timerValues.getCurrentWatermarkInMs())
        self._set(before, s)
        yield from self._rows(key, told)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for the streams that are started within."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def timed_stream(events: DataFrame, machine: Any, late: str = "0 seconds") -> DataFrame:
    """(key, at_ms, outcome, receipts), of a stream of events (key, ts, ord, kind); ties of time go by `ord`.
    To be started within `rocksdb`."""
    rows = events.withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("at"), "ord", "kind")
    return rows.groupBy("key").transformWithStateInPandas(TimedMachine(machine), OUT, "Append", "EventTime")
