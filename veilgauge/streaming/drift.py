"""Keyed stream state: downgrade verdicts per link, and a bounded buffer of recent events.

State lives in RocksDB per key. Memory per task is one key's micro-batch rows;
bound micro-batches at the source (maxFilesPerTrigger, maxOffsetsPerTrigger).
Links and sensors are many and small, so a key passes as plain rows, not as a frame of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

KNOWN = "bits int, qbits int, strengths array<int>, seen array<bigint>"
OUT = ("peer_key string, id string, observed_us bigint, classical_bits int, quantum_bits int, verdict string, baseline_bits int")


class DriftProcessor(StatefulProcessor):
    """Best confirmed strength per link and how often each strength was seen, as one value: a link is read and written once a batch."""

    def __init__(self, min_observations: int = 2, ttl_ms: int | None = None):
        self.min_observations, self.ttl_ms = min_observations, ttl_ms

    def init(self, handle) -> None:
        # strength and counts expire together, else a link that returns would be promoted on old counts
        self.known = handle.getValueState("known", KNOWN, self.ttl_ms) if self.ttl_ms else handle.getValueState("known", KNOWN)

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        known = self.known.get()
        best, counts = (None, {}) if known is None else ((known[0], known[1]), dict(zip(known[2], known[3])))
        out = []
        for r in sorted(rows, key=lambda r: (r.observed_us, r.id)):
            bits, q = r.classical_bits, r.quantum_bits
            counts[bits] = counts.get(bits, 0) + 1
            base = None if best is None else best[0]
            if best is None:
                verdict, best = "new", (bits, q)
            elif bits == base:
                verdict = "downgrade-quantum" if q < best[1] else "steady"
            elif bits < base:
                verdict = "downgrade"
            elif sum(n for b, n in counts.items() if b >= bits) >= self.min_observations:
                verdict, best = "improvement", (bits, q)
            else:
                verdict = "unconfirmed"
            out.append(Row(peer_key=key[0], id=r.id, observed_us=r.observed_us, classical_bits=bits, quantum_bits=q, verdict=verdict, baseline_bits=base))
        self.known.update((*best, list(counts), list(counts.values())))
        yield from out

    def close(self) -> None:
        pass


def drift_stream(observations: DataFrame, min_observations: int = 2, ttl_ms: int | None = None) -> DataFrame:
    """A verdict for every observation of a stream; equals fleet.verdicts on the same rows in order."""
    return observations.select("peer_key", "id", "observed_us", "classical_bits", "quantum_bits").groupBy("peer_key").transformWithState(
        DriftProcessor(min_observations, ttl_ms), OUT, "Append", "ProcessingTime" if ttl_ms else "None")


class RecentProcessor(StatefulProcessor):
    """The last `size` events per key; emits the newest `shown` after each batch."""

    def __init__(self, size: int = 50, shown: int = 15):
        self.size, self.shown = size, shown

    def init(self, handle) -> None:
        self.events = handle.getListState("events", "frame bigint, ts_us bigint, kind string")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        kept = [tuple(e) for e in self.events.get()]
        kept = heapq.nlargest(self.size, chain(kept, ((r.frame, r.ts_us, r.kind) for r in rows)))[::-1]
        self.events.put(kept)
        for f, t, k in kept[-self.shown:]:
            yield Row(sensor=key[0], frame=f, ts_us=t, kind=k)

    def close(self) -> None:
        pass


def recent_stream(events: DataFrame, size: int = 50, shown: int = 15) -> DataFrame:
    return events.select("sensor", "frame", "ts_us", "kind").groupBy("sensor").transformWithState(
        RecentProcessor(size, shown), "sensor string, frame bigint, ts_us bigint, kind string", "Update", "None")
