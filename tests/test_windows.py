"""Chained windows, ranks at a target, windows and quiet links of streams."""

import random

import pytest
from pyspark.sql import functions as F

from veilgauge.operators import operations as OP, scan
from veilgauge.operators.windows import chained_windows
from veilgauge.streaming import monitor as MO, windows as WI

PACKETS = "sensor string, frame bigint, ts_us bigint, length bigint"


def walk(rows, max_packets, max_bytes, max_seconds):
    """The definition, packet by packet."""
    out = []
    for s in sorted({r[0] for r in rows if r[0] is not None}):
        window, current = 0, None
        for _, _, ts, length in sorted((r for r in rows if r[0] == s and r[2] is not None), key=lambda r: (r[2], r[1])):
            if current and (current[1] >= max_packets or current[2] >= max_bytes or ts >= current[0] + max_seconds * 10 ** 6):
                by = "packets" if current[1] >= max_packets else "bytes" if current[2] >= max_bytes else "seconds"
                out.append((s, window, *current, by == "bytes", by))
                window, current = window + 1, None
            current = current or [ts, 0, 0]
            current[1] += 1
            current[2] += length or 0
        if current:
            by = "packets" if current[1] >= max_packets else "bytes" if current[2] >= max_bytes else "open"
            out.append((s, window, *current, by == "bytes", by))
    return sorted(out)


def traffic(seed, n, sensors=("a", "b", "quiet"), share=0.8):
    r = random.Random(seed)
    ts, rows = 0, []
    for i in range(n):
        ts += r.choice([0, 1, 10, 1000, 30_000, 2_000_000, 90_000_000])
        rows.append((sensors[0] if r.random() < share else r.choice(sensors[1:]), i, ts, r.choice([0, 40, 60, 1500, None])))
    return rows


@pytest.mark.parametrize("bounds,chunk", [((7, 3000, 60), 16), ((10 ** 9, 10 ** 9, 30), 5), ((3, 10 ** 9, 10 ** 6), 64), ((10 ** 9, 5000, 10 ** 6), 3), ((10 ** 9, 10 ** 9, 10 ** 6), 7), ((1, 1, 1), 65536)])
def test_windows_follow_each_other(spark, tmp_path, bounds, chunk):
    rows = traffic(1, 600) + [(None, 900, 5, 5), ("b", 901, None, 5)]
    got = chained_windows(spark.createDataFrame(rows, PACKETS), "sensor", *bounds, root=str(tmp_path), chunk=chunk)
    assert sorted(map(tuple, got.collect())) == walk(rows, *bounds)


def test_no_packets_and_bad_bounds(spark, tmp_path):
    empty = spark.createDataFrame([], PACKETS)
    assert chained_windows(empty, "sensor", 1, 1, 1, root=str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        chained_windows(empty, "sensor", 1, 0, 1, root=str(tmp_path))


def test_counts_below_a_target(spark):
    r = random.Random(2)
    rows = [(r.choice(["x", "x", "x", None, "y"]), i, r.choice([None, *range(50)]), r.choice([None, *range(-10, 70)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int, t int")
    got = {x.i: x.n for x in scan.counted_below(df, ["k"], "v", F.col("t"), "n", 8).collect()}
    assert got == {i: None if t is None else sum(k2 == k and v2 is not None and v2 < t for k2, _, v2, _ in rows) for k, i, _, t in rows}


def test_rate_guard_of_a_key_that_is_half_of_all_events(spark):
    r = random.Random(3)
    rows = [(i, "hot" if i % 2 else f"k{r.randrange(20)}", r.randrange(600) * 10 ** 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, k string, ts bigint")
    got = {x.i: (x.recent, x.allowed) for x in OP.rate_guard(df, "k", "ts", 40, 5, chunk_us=10 ** 6).collect()}
    for i, k, ts in rows[::7]:
        n = sum(k2 == k and ts - 5 * 10 ** 6 < t2 <= ts for _, k2, t2 in rows)
        assert got[i] == (n, n <= 40)
    # what one task orders: the events, asked and counted, of one key and second
    largest = max(sum(1 for _, k, ts in rows if k == "hot" and ts // 10 ** 6 == s) for s in range(60))
    assert 2 * largest < len(rows) / 20


def drained(spark, tmp_path, parts, make):
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = make(WI.packet_stream(spark, str(tmp_path / "in"), part.schema, files_per_batch=1))
        q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        q.awaitTermination(180)
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")), q


def test_stream_restarted_in_the_middle_gives_the_same_windows(spark, tmp_path):
    rows = traffic(4, 400)
    df = spark.createDataFrame(rows, PACKETS)
    edge = rows[150][2], rows[290][2]
    parts = [df.where(f"ts_us <= {edge[0]}"), df.where(f"ts_us > {edge[0]} AND ts_us <= {edge[1]}"), df.where(f"ts_us > {edge[1]}")]
    out, _ = drained(spark, tmp_path, parts, lambda s: WI.bounded_windows(s, 7, 3000, 60))
    newest = max(r[2] for r in rows) // 1000 - 1000
    # an open window is closed by its timer once the watermark has passed its end
    want = [w[:-1] + ("seconds",) if w[-1] == "open" else w for w in walk(rows, 7, 3000, 60) if w[-1] != "open" or -(-(w[2] + 60 * 10 ** 6) // 1000) < newest]
    assert sorted(map(tuple, out.collect())) == want


def test_state_of_quiet_links_is_gone(spark, tmp_path):
    rows = [(f"s{i}", i, (i + 1) * 10 ** 6, 100) for i in range(40)] + [("late", 100, 10 ** 10, 1), ("late", 101, 10 ** 10 + 2 * 10 ** 6, 1)]
    df = spark.createDataFrame(rows, PACKETS)
    out, q = drained(spark, tmp_path, [df.where("ts_us < 1000000000"), df.where("ts_us >= 1000000000")], lambda s: WI.quiet_links(s, 300, key="sensor"))
    assert sorted((r.sensor, r.first_us, r.last_us, r.packets, r.bytes) for r in out.collect()) == sorted((f"s{i}", (i + 1) * 10 ** 6, (i + 1) * 10 ** 6, 1, 100) for i in range(40))
    state = spark.read.format("statestore").option("stateVarName", "live").load(str(tmp_path / "cp"))
    assert [r.key[0] for r in state.select("key").collect()] == ["late"]
