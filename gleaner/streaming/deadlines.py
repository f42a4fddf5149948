"""The frontier as a stream whose retry deadlines fire by themselves, with timers in the state store.

Needs the state store that knows timers:
``spark.sql.streaming.stateStore.providerClass`` set to :data:`PROVIDER`, as
sessions of this package have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.frontier import BACKOFF_SECONDS, MAX_ATTEMPTS
from .frontier import advance

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What made a row: a URL was added, an attempt ended, or a deadline passed.
OUT = "key string, state string, attempts int, due timestamp, cause string"
STATE = "state string, attempts int, due long"
TERMINAL = ("done", "blocked", "flagged", "failed")


class Deadlines(StatefulProcessor):
    """State of one key: its frontier state, attempts, and the deadline of a retry in milliseconds."""

    def __init__(self, max_attempts: int, backoff_seconds: float, forget_seconds: float | None):
        self.max_attempts, self.backoff, self.forget = max_attempts, round(backoff_seconds * 1000), forget_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # What ended is kept apart, so that it alone can be forgotten: a retry must outlive any time to live.
        self.now = handle.getValueState("now", STATE)
        self.ended = handle.getValueState("ended", STATE, ttlDurationMs=round(self.forget * 1000) if self.forget else None)

    def _row(self, key: tuple, state: str, attempts: int, due: int | None, cause: str) -> dict:
        return {"key": key[0], "state": state, "attempts": attempts, "due": None if due is None else pd.Timestamp(due, unit="ms"), "cause": cause}

    @staticmethod
    def _frame(rows: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["key", "state", "attempts", "due", "cause"])
        return frame.astype({"attempts": "int32", "due": "datetime64[ns]"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.ended if self.ended.exists() else self.now
        known = held.exists()
        state, attempts, due = held.get() if known else ("pending", 0, -1)
        if state in TERMINAL:
            return
        # Only attempts count against the budget, so no more rows of a batch can matter; an added URL is at most one row.
        added, first = False, []
        for pdf in rows:
            added |= bool((pdf["status"] == "added").any())
            tries = pdf[pdf["status"] != "added"]
            first = sorted(first + list(zip(tries["id"].tolist(), tries["status"].tolist(), strict=True)))[: self.max_attempts]
        out = [self._row(key, state, attempts, None, "added")] if added and not known else []
        if first:
            for _, status in first:
                state, attempts = advance(state, attempts, status, self.max_attempts)
            if due >= 0:
                self.handle.deleteTimer(due)
            due = -1
            if state == "retrying":
                due = timerValues.getCurrentProcessingTimeInMs() + self.backoff
                self.handle.registerTimer(due)
            out.append(self._row(key, state, attempts, due if due >= 0 else None, "attempt"))
        if state in TERMINAL:
            self.ended.update((state, attempts, due))
            if self.now.exists():
                self.now.clear()
        else:
            self.now.update((state, attempts, due))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.now.exists():
            state, attempts, due = self.now.get()
            if state == "retrying" and due == expiredTimerInfo.getExpiryTimeInMs():
                self.now.update((state, attempts, -1))
                yield self._frame([self._row(key, state, attempts, due, "due")])

    def close(self) -> None:
        pass


def frontier_deadlines(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, backoff_seconds: float = BACKOFF_SECONDS, forget_seconds: float | None = None) -> DataFrame:
    """What may be worked on, and what came of it, as it happens.

    ``attempts``: a stream of key, id and status; the status ``added`` enqueues
    a URL.  A row comes out when a new URL is added (cause ``added``), when an
    attempt changed a state (``attempt``), and when the deadline of a retry has
    passed (``due``), even if no more input ever arrives and the query was
    restarted from its checkpoint meanwhile.  Keys that ended are remembered
    for good, or for ``forget_seconds``: after that they count as new.
    """
    return attempts.groupBy("key").transformWithStateInPandas(Deadlines(max_attempts, backoff_seconds, forget_seconds), OUT, "Update", "ProcessingTime")
