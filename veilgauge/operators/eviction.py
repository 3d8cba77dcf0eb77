"""The busiest flows under a bound: a table of fixed size per task, evicted in batches, then an exact recount.

The table is a space-saving summary. When it is full, the least active tenth
goes in one pass, and what has gone sets a floor: a flow that is not in the
table has been seen `floor` times at most, so a new one starts with that many,
all of them in doubt. Summaries of tasks add up, floors too. Flows that may be
among the busiest are then counted exactly; where the floors leave room for a
flow outside the tables, the capture is counted in full instead, so the
result is exact whatever the traffic.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .flows import KEYS, busiest

_SUMMARY = "capture string, src string, dst string, spi bigint, n bigint, doubt bigint, floor bigint"


class FlowTable:
    """At most `max_flows` flows: [packets, of these in doubt, last seen] by key."""

    def __init__(self, max_flows: int, evict_fraction: float = 0.1):
        self.max_flows, self.batch = max_flows, max(1, int(max_flows * evict_fraction))
        self.flows: dict[tuple, list[int]] = {}
        self.floor = 0
        self.evicted = 0

    def add(self, key: tuple, packets: int, last: int) -> None:
        held = self.flows.get(key)
        if held is None:
            if len(self.flows) >= self.max_flows:
                self._evict()
            self.flows[key] = [self.floor + packets, self.floor, last]
        else:
            held[0] += packets
            held[2] = max(held[2], last)

    def _evict(self) -> None:
        """Drop the least active flows, the longest unseen first among equals; one scan for many insertions."""
        gone = heapq.nsmallest(self.batch, self.flows.items(), key=lambda kv: (kv[1][0], kv[1][2]))
        for key, held in gone:
            del self.flows[key]
            self.floor = max(self.floor, held[0])
        self.evicted += len(gone)


def summaries(packets: DataFrame, max_flows: int) -> DataFrame:
    """One row per flow of each task's table: n (never less than its packets in the task), doubt, and the task's floor (in a row without a flow)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FlowTable(max_flows)
        for batch in batches:
            few = pa.Table.from_batches([batch]).group_by(KEYS).aggregate([([], "count_all"), ("ts_us", "max")])
            for *key, n, last in zip(*[few.column(c).to_pylist() for c in (*KEYS, "count_all", "ts_us_max")]):
                table.add(tuple(key), n, last or 0)
        rows = [(*key, n, doubt, None) for key, (n, doubt, _) in table.flows.items()] + [(None, None, None, None, None, None, table.floor)]
        kinds = [pa.string()] * 3 + [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*KEYS, "n", "doubt", "floor"])

    return packets.select(*KEYS, "ts_us").mapInArrow(run, _SUMMARY)


def busiest_bounded(packets: DataFrame, n: int, root: str, max_flows: int = 8192) -> DataFrame:
    """capture, src, dst, spi, packets, last_us of the n flows of each capture with most packets, latest seen first among equals.

    Exact. A task holds `max_flows` flows at most, however many a flood makes
    up, and hands on no more; a flow with more packets than the floors of all
    tasks together is never missed. `root` is a folder that all executors reach.
    """
    path = f"{root}/{uuid.uuid4().hex}"
    summaries(packets, max_flows).write.parquet(path)
    held = packets.sparkSession.read.schema(_SUMMARY).parquet(path)
    floors = held.where("floor IS NOT NULL").agg(F.coalesce(F.sum("floor"), F.lit(0))).first()[0]
    # what a flow has at most: its counts, and the floor of every task that does not know it
    known = held.where("floor IS NULL").groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.col("doubt")).alias("sure"))
    top = known.withColumn("rank", F.row_number().over(W.partitionBy("capture").orderBy(F.desc("sure")))).where(F.col("rank") <= n)
    sure = top.groupBy("capture").agg(F.min("sure").alias("least"), F.count(F.lit(1)).alias("flows")).where(F.col("flows") == n).select(F.col("capture").alias("c"), "least")
    able = known.join(sure, F.col("capture").eqNullSafe(F.col("c")), "left").where(F.col("least").isNull() | (F.col("n") + floors >= F.col("least"))).select(*[F.col(k).alias(f"_{k}") for k in KEYS])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    counted = packets.join(able, same, "left_semi").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("packets"), F.max("ts_us").alias("last_us"))
    best = busiest(counted, n)
    if not floors:  # no table was ever full
        return best
    kept = f"{path}-best"
    best.write.parquet(kept)
    best = packets.sparkSession.read.schema(best.schema).parquet(kept)
    # a capture is settled when its n-th flow has more packets than any flow outside the tables can have
    least = best.groupBy("capture").agg(F.count(F.lit(1)).alias("flows"), F.min("packets").alias("packets")).where((F.col("flows") == n) & (F.col("packets") > floors)).select(F.col("capture").alias("c"))
    alike = F.col("capture").eqNullSafe(F.col("c"))
    rest = packets.join(least, alike, "left_anti").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("packets"), F.max("ts_us").alias("last_us"))
    return best.join(least, alike, "left_semi").unionByName(busiest(rest, n))
