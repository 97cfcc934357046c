"""Flows of captures that still grow, folded exactly: reassembly and trailing throughput with state that is kept for each flow.

Rows wait until the watermark has passed them, and are folded in their order, so that a stream gives what a table gives. A flow
that was idle for some time is told and forgotten; what comes for it later is a flow of its own. State holds what waits
(bounded by the watermark's delay), a few numbers, and for throughput the rows of the trailing window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The session's setting that stateful processors ask for, and its value.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_ROW = "time_us long, ord long, seq long, size long"


class InOrder(StatefulProcessor):
    """Hands the rows of a key on in order of (time_us, ord), when the watermark has passed them, and tells the key when it was idle."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.last = handle.getValueState("last", "ms long")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, ms: int) -> None:
        """One timer for a key at a time."""
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = [tuple(map(int, r)) for pdf in rows for r in pdf[["time_us", "ord", "seq", "size"]].itertuples(index=False)]
        if told:
            self.waiting.appendList(told)
            self._wake(max(r[0] for r in told) // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ripe = [r for r in rows if r[0] // 1000 < now]
        rest = rows[len(ripe) :]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        for stretch in self._stretches(ripe):
            if self.last.exists() and stretch[0][0] // 1000 > self.last.get()[0] + self.idle_ms:
                yield self._end(key)
            self.fold(stretch)
            self.last.update((stretch[-1][0] // 1000,))
        if rest:
            self._wake(rest[-1][0] // 1000 + 1)
        elif self.last.exists():
            end = self.last.get()[0] + self.idle_ms
            if end < now:
                yield self._end(key)
            else:
                self._wake(end + 1)

    def _stretches(self, rows: list[tuple]) -> Iterator[list[tuple]]:
        """Rows between which nothing was idle."""
        begin = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][0] // 1000 > rows[i - 1][0] // 1000 + self.idle_ms:
                yield rows[begin:i]
                begin = i

    def _end(self, key) -> pd.DataFrame:
        told = pd.DataFrame([[*key, *self.result()]], columns=self.columns)
        self.last.clear()
        self.clear()
        return told

    def close(self) -> None:
        pass


class Reassembly(InOrder):
    """As sequences.reassembly(): packets, duplicates, holes, new and repeated bytes."""

    columns = ("flow", "packets", "duplicates", "holes", "new_bytes", "repeated_bytes")
    schema = "flow string, packets long, duplicates long, holes long, new_bytes long, repeated_bytes long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sums = handle.getValueState("sums", "top long, packets long, duplicates long, holes long, new_bytes long, repeated_bytes long")

    def fold(self, rows: list[tuple]) -> None:
        known = self.sums.exists()
        top, packets, duplicates, holes, new, repeated = self.sums.get() if known else (0, 0, 0, 0, 0, 0)
        for _, _, seq, size in rows:
            end = seq + size
            fresh = max(0, end - max(top, seq)) if known else size
            packets, duplicates, holes = packets + 1, duplicates + (known and end <= top), holes + (known and seq > top)
            new, repeated = new + fresh, repeated + size - fresh
            top, known = max(top, end) if known else end, True
        self.sums.update((top, packets, duplicates, holes, new, repeated))

    def result(self) -> tuple:
        return self.sums.get()[1:]

    def clear(self) -> None:
        self.sums.clear()


class Throughput(InOrder):
    """As sequences.throughput(): the greatest bytes over elapsed time of the trailing windows that took longer than ``least_us``."""

    columns, schema = ("flow", "peak_kbps"), "flow string, peak_kbps long"

    def __init__(self, idle_ms: int, trail_us: int, least_us: int):
        super().__init__(idle_ms)
        self.trail_us, self.least_us = trail_us, least_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.peak = handle.getValueState("peak", "kbps long")
        self.recent = handle.getListState("recent", "time_us long, bytes long")

    def fold(self, rows: list[tuple]) -> None:
        peak = self.peak.get()[0] if self.peak.exists() else -1
        recent = list(self.recent.get()) if self.recent.exists() else []
        held, first = sum(n for _, n in recent), 0
        for i, (at, _, _, size) in enumerate(rows):
            recent.append((at, size))
            held += size
            if i + 1 < len(rows) and rows[i + 1][0] == at:
                continue  # rows of one time share a window
            while recent[first][0] < at - self.trail_us:
                held -= recent[first][1]
                first += 1
            took = at - recent[first][0]
            if took > self.least_us:
                peak = max(peak, (held * 8000 * 2 + took) // (2 * took))
        self.peak.update((peak,))
        self.recent.put(recent[first:])

    def result(self) -> tuple:
        peak = self.peak.get()[0]
        return (None if peak < 0 else peak,)

    def clear(self) -> None:
        self.peak.clear()
        self.recent.clear()


def _folded(rows: DataFrame, ts: str, late: str, processor: InOrder) -> DataFrame:
    name, value = STORE
    if rows.sparkSession.conf.get(name, None) != value:
        raise ValueError(f"{name} must be {value}")
    known = rows.filter("flow is not null and time_us is not null").withWatermark(ts, late)
    return known.groupBy("flow").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.schema, outputMode="Append", timeMode="EventTime")


def reassembled(rows: DataFrame, ts: str = "ts", late: str = "10 seconds", idle_ms: int = 30_000) -> DataFrame:
    """flow, packets, duplicates, holes, new_bytes, repeated_bytes of each flow of a stream, once it was idle for ``idle_ms``.

    rows: flow (text), time_us, ord, seq, size, and ``ts``, the time as a timestamp. Rows that come after the watermark has passed them are left out, as are null flows.
    """
    return _folded(rows, ts, late, Reassembly(idle_ms))


def peaks(rows: DataFrame, ts: str = "ts", late: str = "10 seconds", idle_ms: int = 30_000, trail_us: int = 100_000, least_us: int = 1000) -> DataFrame:
    """flow, peak_kbps of each flow of a stream, once it was idle; rows as reassembled() has them (seq is not read, but must be there). Null where no window took long enough."""
    return _folded(rows, ts, late, Throughput(idle_ms, trail_us, least_us))
