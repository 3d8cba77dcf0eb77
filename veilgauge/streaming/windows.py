"""Streams of packets cut into bounded windows, and links whose silence is told by a timer.

Both processors keep one small row of state per key and set event-time timers,
so a window whose time is over, or a link that has gone quiet, is emitted and
forgotten although no packet of its own arrives any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from .monitor import event_time


def packet_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 64, bytes_per_batch: str | None = None, pattern: str | None = None) -> DataFrame:
    """Packets as files arrive below `path`, oldest first. A micro-batch takes `files_per_batch` files, or files up to
    `bytes_per_batch`, at most: what has piled up while a job was down is read in many batches, not in one."""
    r = spark.readStream.schema(schema)
    r = r.option("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else r.option("maxFilesPerTrigger", files_per_batch)
    return event_time((r.option("pathGlobFilter", pattern) if pattern else r).parquet(path))


def _columns(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """(times, lengths) of a key's packets in a batch, in order of time and frame."""
    parts = [(b["ts_us"].to_numpy(np.int64), b["frame"].to_numpy(np.int64), b["length"].fillna(0).to_numpy(np.int64)) for b in rows]
    ts, frame, length = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((frame, ts))
    return ts[order], length[order]


class WindowProcessor(StatefulProcessor):
    """One open window per key: number, first time, packets and bytes so far."""

    COLUMNS = ["window", "start_us", "packets", "bytes", "truncated", "closed_by"]

    def __init__(self, key: str, max_packets: int, max_bytes: int, max_seconds: float):
        self.key, self.max_packets, self.max_bytes, self.span = key, max_packets, max_bytes, int(max_seconds * 10 ** 6)

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "number bigint, start_us bigint, packets bigint, bytes bigint")

    def _frame(self, key, rows: list) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=self.COLUMNS)
        frame.insert(0, self.key, key[0])
        return frame

    def _row(self, number: int, start: int, packets: int, held: int) -> tuple:
        by = "packets" if packets >= self.max_packets else "bytes" if held >= self.max_bytes else "seconds"
        return number, start, packets, held, by == "bytes", by

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ts, length = _columns(rows)
        total = np.concatenate([[0], np.cumsum(length)])
        number, start, packets, held = self.open.get() if self.open.exists() else (0, 0, 0, 0)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        at, out = 0, []
        while at < len(ts):
            start = start if packets else int(ts[at])
            # the first packet outside, as far as each bound goes
            end = min(at + self.max_packets - packets, int(np.searchsorted(total, total[at] + self.max_bytes - held)), int(np.searchsorted(ts, start + self.span)), len(ts))
            packets, held = packets + end - at, held + int(total[end] - total[at])
            full = packets >= self.max_packets or held >= self.max_bytes
            if full or end < len(ts):
                out.append(self._row(number, start, packets, held))
                number, packets, held = number + 1, 0, 0
            at = end
        self.open.update((number, start, packets, held))
        if packets:
            self.handle.registerTimer(-(-(start + self.span) // 1000))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, start, packets, held = self.open.get()
        self.open.update((number + 1, 0, 0, 0))
        yield self._frame(key, [self._row(number, start, packets, held)] if packets else [])

    def close(self) -> None:
        pass


def bounded_windows(packets: DataFrame, max_packets: int, max_bytes: int, max_seconds: float, key: str = "sensor", watermark: str = "1 second") -> DataFrame:
    """Closed windows of a stream of packets: operators.windows.chained_windows, each window once it is closed.

    Packets must arrive in order of time up to `watermark`; within that delay a
    packet that comes in a later batch than its successors is counted where the stream then stands.
    """
    kind = packets.schema[key].dataType.simpleString()
    p = packets.select(key, "frame", "ts_us", "length", "ts").withWatermark("ts", watermark)
    out = f"`{key}` {kind}, window bigint, start_us bigint, packets bigint, bytes bigint, truncated boolean, closed_by string"
    return p.groupBy(key).transformWithStateInPandas(WindowProcessor(key, max_packets, max_bytes, max_seconds), out, "Append", "EventTime")


class QuietProcessor(StatefulProcessor):
    """First and last time, packets and bytes of a link since it last fell silent."""

    def __init__(self, key: str, ttl_seconds: float):
        self.key, self.ttl = key, int(ttl_seconds * 10 ** 6)

    def init(self, handle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "first_us bigint, last_us bigint, packets bigint, bytes bigint")

    def _frame(self, key, rows: list) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["first_us", "last_us", "packets", "bytes"])
        frame.insert(0, self.key, key[0])
        return frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ts, length = _columns(rows)
        total = np.concatenate([[0], np.cumsum(length)])
        gaps = np.flatnonzero(np.diff(ts) >= self.ttl) + 1
        edges = [0, *gaps.tolist(), len(ts)]
        runs = [(int(ts[a]), int(ts[b - 1]), b - a, int(total[b] - total[a])) for a, b in zip(edges[:-1], edges[1:])]
        if self.live.exists():
            first, last, packets, held = self.live.get()
            if runs[0][0] - last < self.ttl:
                runs[0] = min(first, runs[0][0]), max(last, runs[0][1]), packets + runs[0][2], held + runs[0][3]
            else:
                runs.insert(0, (first, last, packets, held))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.live.update(runs[-1])
        self.handle.registerTimer(-(-(runs[-1][1] + self.ttl) // 1000))
        yield self._frame(key, runs[:-1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        quiet = self.live.get()
        self.live.clear()
        yield self._frame(key, [quiet])

    def close(self) -> None:
        pass


def quiet_links(packets: DataFrame, ttl_seconds: float, key: str = "spi", watermark: str = "1 second") -> DataFrame:
    """A row for every stretch of activity of a link, emitted when the link has been silent for `ttl_seconds`; its state is then gone.

    State is one row per link that is active now, however many links have come and gone.
    """
    kind = packets.schema[key].dataType.simpleString()
    p = packets.select(key, "frame", "ts_us", "length", "ts").withWatermark("ts", watermark)
    return p.groupBy(key).transformWithStateInPandas(QuietProcessor(key, ttl_seconds), f"`{key}` {kind}, first_us bigint, last_us bigint, packets bigint, bytes bigint", "Append", "EventTime")
