"""Keyed state of the live feeds: processors with event-time timers, value and list state, and initial state.

A processor sees the rows of its key in each micro-batch, in order of time, and decides by their
event time alone; a timer only says aloud, or cleans up, what a later row would find as well.  So
the rows that come out do not depend on how the input falls into micro-batches.  State lives in
the RocksDB store, which keeps more keys than memory holds.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that workers need no installed package
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, timers: bool = True, initial: DataFrame | None = None) -> DataFrame:
    """``processor`` over the keys of a stream, in append mode; sets the session's state store to the one that such state needs."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    start = None if initial is None else initial.groupBy(key)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime" if timers else "None", start)


def in_order(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(pdfs)).sort_values(["ts", "event_id"])


class Expiring(StatefulProcessor):
    """A processor with one timer per key, which moves with the key's rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alarm = handle.getValueState("alarm", "at bigint")

    def ring(self, at: int) -> None:
        """Moves the timer to second ``at``."""
        old = self.alarm.get()
        if old is not None:
            if old[0] == at:
                return
            self.handle.deleteTimer(old[0] * 1000)
        self.handle.registerTimer(at * 1000)
        self.alarm.update((at,))

    def forget(self) -> None:
        """Clears all state of the key."""
        self.alarm.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.forget()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class Auction(Expiring):
    """A reverse auction per key: a bid counts only strictly below the best and before the end, which moves when a bid comes in its last moments.

    When the end has passed, the best bid is awarded: one row, told by the timer or, where it comes
    first, by the next bid.  Bids after the end are closed out for ``pause`` seconds; then a bid opens
    a new auction.
    """

    SCHEMA = "event_id bigint, user_id bigint, verdict string, best double, end bigint"

    def __init__(self, seconds: int, extension: int, pause: int):
        self.seconds, self.extension, self.pause = seconds, extension, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.auction = handle.getValueState("auction", "best double, end bigint, leader bigint, awarded boolean")

    def forget(self) -> None:
        super().forget()
        self.auction.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.auction.get()
        best, end, leader, awarded = held if held is not None else (None, 0, None, False)
        out = []
        for r in in_order(rows).itertuples():
            at = int(r.ts.timestamp())
            if best is not None and at > end and not awarded:
                out.append((leader, key[0], "awarded", best, end))
                awarded = True
            if best is None or at > end + self.pause:
                best, end, leader, awarded, verdict = r.value, at + self.seconds, r.event_id, False, "accepted"
            elif at > end:
                verdict = "closed"
            elif r.value < best:
                best, leader, verdict = r.value, r.event_id, "accepted"
                if end - at < self.extension:
                    end += self.extension
            else:
                verdict = "not lower"
            out.append((r.event_id, key[0], verdict, best, end))
        self.auction.update((best, end, leader, awarded))
        self.ring(end + self.pause if awarded else end)
        yield pd.DataFrame(out, columns=["event_id", "user_id", "verdict", "best", "end"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.auction.get()
        self.alarm.clear()
        if held is None or held[3]:
            self.forget()
            yield pd.DataFrame()
            return
        best, end, leader, _ = held
        self.auction.update((best, end, leader, True))
        self.ring(end + self.pause)
        yield pd.DataFrame([(leader, key[0], "awarded", best, end)], columns=["event_id", "user_id", "verdict", "best", "end"])


class Ewma(Expiring):
    """EWMA of value, and an alert where the residual exceeds the mean + 2 sd of the residuals before it; a key silent for ``ttl`` seconds starts anew."""

    SCHEMA = "event_id bigint, user_id bigint, ewma double, alert boolean"

    def __init__(self, span: int, ttl: int):
        self.alpha, self.ttl = 2.0 / (span + 1), ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.series = handle.getValueState("series", "m double, n bigint, mean double, square double, last bigint")

    def forget(self) -> None:
        super().forget()
        self.series.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.series.get()
        m, n, mean, square, last = held if held is not None else (0.0, 0, 0.0, 0.0, 0)
        out = []
        for r in in_order(rows).itertuples():
            at = int(r.ts.timestamp())
            if n and at > last + self.ttl:
                m, n, mean, square = 0.0, 0, 0.0, 0.0
            m = r.value if n == 0 else self.alpha * r.value + (1 - self.alpha) * m
            residual = abs(r.value - m)
            bar = mean + 2 * (square / n) ** 0.5 if n else 0.0
            out.append((r.event_id, key[0], m, bool(n > 2 and residual > bar)))
            n, d, last = n + 1, residual - mean, at
            mean += d / n
            square += d * (residual - mean)
        self.series.update((m, n, mean, square, last))
        self.ring(last + self.ttl)
        yield pd.DataFrame(out, columns=["event_id", "user_id", "ewma", "alert"])


class Rate(Expiring):
    """Rows at which a key has more than ``limit`` in the trailing window; the list state holds the times of that window."""

    SCHEMA = "event_id bigint, user_id bigint, n bigint"

    def __init__(self, seconds: int, limit: int):
        self.seconds, self.limit = seconds, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "at bigint")

    def forget(self) -> None:
        super().forget()
        self.recent.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        recent = [x[0] for x in self.recent.get()]
        out = []
        for r in in_order(rows).itertuples():
            at = r.ts.value // 1000
            recent = [x for x in recent if x > at - self.seconds * 1_000_000] + [at]
            if len(recent) > self.limit:
                out.append((r.event_id, key[0], len(recent)))
        self.recent.put([(x,) for x in recent])
        self.ring(recent[-1] // 1_000_000 + self.seconds + 1)
        yield pd.DataFrame(out, columns=["event_id", "user_id", "n"])


class Seal(StatefulProcessor):
    """A hash chain per key, with the last hash in state; chains sealed before go on from their last hash (initial state: key, last)."""

    SCHEMA = "event_id bigint, user_id bigint, prev_hash string, hash string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.last.update((initialState["last"].iloc[0],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.last.get()
        before, out = "0" * 64 if held is None else held[0], []
        for r in pd.concat(list(rows)).sort_values("event_id").itertuples():
            digest = hashlib.sha256(f"{before}|{r.content}".encode()).hexdigest()
            out.append((r.event_id, key[0], before, digest))
            before = digest
        self.last.update((before,))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "prev_hash", "hash"])

    def close(self) -> None:
        pass


class RunningMean(StatefulProcessor):
    """Count and mean of a key's points so far, one row per micro-batch that has rows of it."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n bigint, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.sums.get()
        n, total = held if held is not None else (0, 0.0)
        for pdf in rows:
            n, total = n + len(pdf), total + float(pdf["esg"].sum())
        self.sums.update((n, total))
        yield pd.DataFrame([(key[0], n, total / n)], columns=[self.key, "n", "mean_esg"])

    def close(self) -> None:
        pass
