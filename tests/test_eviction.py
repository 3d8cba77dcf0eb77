"""Bounded flow tables under floods; results stay exact."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilgauge.operators.eviction import FlowTable, busiest_bounded, summaries

PACKETS = "capture string, src string, dst string, spi bigint, ts_us bigint"


def exact(rows, n):
    packets, last = Counter(r[:4] for r in rows), {}
    for r in rows:
        last[r[:4]] = max(last.get(r[:4], 0), r[4] or 0)
    out = []
    for c in {r[0] for r in rows}:
        own = sorted((-k, -last[f], f[1], f[2], f[3]) for f, k in packets.items() if f[0] == c)[:n]
        out += [(c, s, d, spi, -k, -t) for k, t, s, d, spi in own]
    return sorted(out)


def flood(seed, singles, tunnels):
    r = random.Random(seed)
    rows = [("c", "10.0.0.1", "203.0.113.9", r.getrandbits(32), i) for i in range(singles)]
    rows += [("c", f"10.0.0.{t}", "203.0.113.1", 4096 + t, r.randrange(singles)) for t in range(tunnels) for _ in range(60 + 20 * t)]
    rows.sort(key=lambda x: x[4])
    return rows


def test_established_tunnels_survive_a_flood():
    rows = flood(1, 20_000, 5)
    table = FlowTable(100)
    for r in rows:
        table.add(r[:4], 1, r[4])
        assert len(table.flows) <= 100
    assert table.evicted > 10_000
    # twice the share of a full table at most, which is what a tunnel must exceed to be kept for certain
    assert table.floor <= len(rows) / 90 + 1
    counts = Counter(r[:4] for r in rows)
    for key, (n, doubt, _) in table.flows.items():
        assert n - doubt <= counts[key] <= n
    assert all(counts[k] <= table.floor for k in counts if k not in table.flows)


@pytest.mark.parametrize("tunnels", [5, 0, 40])
def test_busiest_flows_are_exact_under_a_flood(spark, tmp_path, tunnels):
    rows = flood(2, 3000, tunnels) + [("small", "a", "b", i % 4, i) for i in range(30)] + [("few", "a", "b", 1, 7)]
    df = spark.createDataFrame(rows, PACKETS).repartition(6)
    got = sorted(map(tuple, busiest_bounded(df, 3, str(tmp_path), max_flows=60).collect()))
    assert got == exact(rows, 3)


def test_a_task_hands_on_a_bounded_table(spark):
    df = spark.createDataFrame(flood(3, 2000, 2), PACKETS).repartition(4)
    per_task = summaries(df, 50).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == 4 and max(r["count"] for r in per_task) <= 51


def test_no_packets_and_nulls(spark, tmp_path):
    assert busiest_bounded(spark.createDataFrame([], PACKETS), 3, str(tmp_path)).count() == 0
    rows = [(None, "a", None, 1, 5), (None, "a", None, 1, None), ("c", None, "b", None, 2)]
    got = busiest_bounded(spark.createDataFrame(rows, PACKETS), 1, str(tmp_path), max_flows=1).collect()
    assert sorted(((r.capture or "", r.packets) for r in got)) == [("", 2), ("c", 1)]
