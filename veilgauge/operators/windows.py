"""Capture windows one behind the other, each closed by the first of three bounds, on tables of any length.

A window starts with a packet and is over when it holds `max_packets` packets
or `max_bytes` bytes, or at the first packet `max_seconds` or more behind its
first. The next window starts there, so where a window begins depends on all
before it. Instead of walking the packets in order, every packet gets a pointer
to where a window that started with it would end; chunks of consecutive packets
are followed inside a task, and pointer doubling joins the few places where
chains cross from chunk to chunk.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scan import counted_below, ordered

#: Packets of a sensor that one task follows.
CHUNK = 65536
#: Width of the chunks in which times (microseconds) and byte totals are ordered.
TIME_CHUNK, BYTE_CHUNK = 60 * 10 ** 6, 1 << 25


def with_next(packets: DataFrame, key: str, max_packets: int, max_bytes: int, max_seconds: float) -> DataFrame:
    """key, nth, ts_us, before (bytes of earlier packets), length, next: the place behind a window that starts at nth."""
    slim = packets.select(key, "frame", "ts_us", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"))
    o = ordered(slim, [key], [F.col("ts_us"), F.col("frame")], F.floor(F.col("ts_us") / TIME_CHUNK), rank="nth", sum_to={"total": "length"})
    o = o.select(key, "nth", "ts_us", (F.col("total") - F.col("length")).alias("before"), "length")
    o = counted_below(o, [key], "ts_us", F.col("ts_us") + F.lit(int(max_seconds * 10 ** 6)), "in_time", TIME_CHUNK)
    o = counted_below(o, [key], "before", F.col("before") + F.lit(int(max_bytes)), "in_bytes", BYTE_CHUNK)
    return o.withColumn("next", F.least(F.col("nth") + max_packets, F.col("in_time") + 1, F.col("in_bytes") + 1)).drop("in_time", "in_bytes")


def _written(df: DataFrame, root: str) -> DataFrame:
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _exits(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, at, to): the first place outside its chunk that the chain from `at` reaches, for every packet."""

    def follow(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("nth").to_numpy(), kind="stable")
        nth, to = (table.column(c).to_numpy()[order] for c in ("nth", "next"))
        first, end = int(nth[0]), int(nth[-1])
        to = to.copy()
        while (inside := to <= end).any():  # twice as far in every round
            to[inside] = to[to[inside] - first]
        return pa.table([table.column(key).take(pa.array(order)), pa.array(nth), pa.array(to)], names=[key, "at", "to"])

    return rows.select(key, "nth", "next", "part").groupBy(key, "part").applyInArrow(follow, f"`{key}` {kind}, at bigint, to bigint")


def _entries(exits: DataFrame, key: str, root: str) -> DataFrame:
    """(key, at): where the chain from the first packet of each key enters a chunk, by pointer doubling."""
    borders = exits.select(key, F.col("to").alias("at")).distinct()
    jumps = exits.join(borders, [key, "at"], "left_semi").union(exits.where("at = 1"))
    jumps = _written(jumps.distinct(), root)
    reached = _written(jumps.where("at = 1").select(key, "at"), root)
    while True:
        ahead = reached.join(jumps, [key, "at"]).select(key, F.col("to").alias("at"))
        # a place behind the last packet is no entry
        fresh = _written(ahead.join(jumps.select(key, "at"), [key, "at"], "left_semi").join(reached, [key, "at"], "left_anti").distinct(), root)
        if not fresh.limit(1).count():
            return reached
        reached = _written(reached.union(fresh), root)
        onward = jumps.select(key, F.col("at").alias("to"), F.col("to").alias("onward"))
        jumps = _written(jumps.join(onward, [key, "to"], "left").select(key, "at", F.coalesce("onward", "to").alias("to")), root)


def chained_windows(packets: DataFrame, key: str, max_packets: int, max_bytes: int, max_seconds: float, root: str, chunk: int = CHUNK) -> DataFrame:
    """Every window of every key: window (from 0), start_us, packets, bytes, truncated, closed_by.

    Packets are ordered by (ts_us, frame). A window is truncated when its bytes
    reach the bound while its packets do not. closed_by names the bound, packets
    before bytes before seconds; the last window of a key that no bound has
    closed is `open`. `root` is a folder that all executors reach, for the
    tables between the steps. Null keys are left out; a null length is 0 bytes;
    packets without a time belong to no window.
    """
    if min(max_packets, max_bytes, max_seconds) <= 0:
        raise ValueError("bounds must be positive")
    timed = packets.where(F.col(key).isNotNull() & F.col("ts_us").isNotNull())
    rows = _written(with_next(timed, key, max_packets, max_bytes, max_seconds).withColumn("part", F.floor((F.col("nth") - 1) / chunk)), root)
    kind = rows.schema[key].dataType.simpleString()
    entries = _entries(_written(_exits(rows, key, kind), root), key, root)

    def mark(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("nth").to_numpy(), kind="stable")
        nth, to = (table.column(c).to_numpy()[order].tolist() for c in ("nth", "next"))
        at, starts = table.column("at")[0].as_py() - nth[0], []
        while at < len(nth):
            starts.append(at)
            at = to[at] - nth[0]
        return table.select([key, "nth", "next", "ts_us", "before"]).take(pa.array(order[starts]))

    entered = rows.join(entries.withColumn("part", F.floor((F.col("at") - 1) / chunk)), [key, "part"])
    starts = _written(entered.select(key, "part", "nth", "next", "ts_us", "before", "at").groupBy(key, "part").applyInArrow(
        mark, f"`{key}` {kind}, nth bigint, next bigint, ts_us bigint, before bigint"), root)
    totals = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("all_bytes"))
    behind = starts.select(key, F.col("nth").alias("next"), F.col("before").alias("until"))
    full = starts.join(behind, [key, "next"], "left").join(totals, key)
    size, held = F.least("next", F.col("n") + 1) - F.col("nth"), F.coalesce("until", "all_bytes") - F.col("before")
    out = full.select(key, "nth", F.col("ts_us").alias("start_us"), size.alias("packets"), held.alias("bytes"), (F.col("next") <= F.col("n")).alias("followed"))
    out = ordered(out, [key], [F.col("nth")], F.floor(F.col("nth") / chunk), rank="number")
    by = F.when(F.col("packets") >= max_packets, "packets").when(F.col("bytes") >= max_bytes, "bytes").when(F.col("followed"), "seconds").otherwise("open")
    return out.select(key, (F.col("number") - 1).alias("window"), "start_us", "packets", "bytes", (by == "bytes").alias("truncated"), by.alias("closed_by"))
