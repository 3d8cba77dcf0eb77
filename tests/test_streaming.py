"""Streams give the batch results; state is bounded."""

from pyspark.sql import functions as F

from tests.test_fleet import table
from veilgauge.operators import fleet as FT
from veilgauge.streaming import drift as DR, monitor as MO


def run_memory(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_drift_stream_equals_batch(spark, tmp_path):
    import random

    r = random.Random(3)
    rows = [(r.choice(["a|b", "c|d", "e|f"]), i, "c", r.choice([80, 112, 128, 192]), r.choice([0, 64])) for i in range(90)]
    batch = table(spark, rows)
    for part in range(3):  # three files in time order, one per micro-batch
        batch.where(f"observed_us >= {part * 30} AND observed_us < {part * 30 + 30}").drop("at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.drop("at").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {x.id: (x.verdict, x.baseline_bits) for x in run_memory(DR.drift_stream(stream), "drift_out", "append").collect()}
    want = {x.id: (x.verdict, x.baseline_bits) for x in FT.verdicts(batch).collect()}
    assert got == want


def packets(spark, n=200):
    return spark.range(n).selectExpr("'c' AS capture", "id AS frame", "id * 1000000 AS ts_us", "'a' AS src", "'b' AS dst", "id % 3 AS spi", "100 + id % 7 AS length")


def test_monitor_windows(spark, tmp_path):
    p = packets(spark)
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    # one late-running file moves the watermark past every window of the first
    packets(spark, 1).selectExpr("capture", "frame", "9000000000 AS ts_us", "src", "dst", "spi", "length").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = MO.event_time(spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = MO.start_monitor(stream, str(tmp_path / "out"), str(tmp_path / "cp"), window="60 seconds", watermark="1 second", available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/windows")).drop("batch").where("window_us < 1000000000")
    want = MO.window_columns(MO.window_flows(MO.event_time(p), "60 seconds"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(str(tmp_path / "out/window_log")).count() >= 1


def test_recent_buffer_is_capped(spark, tmp_path):
    e = spark.range(500).selectExpr("'s' AS sensor", "id AS frame", "id AS ts_us", "'ESP' AS kind")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    rows = run_memory(DR.recent_stream(stream, 50, 15), "recent_out", "update").collect()
    assert sorted(x.frame for x in rows) == list(range(485, 500))


def test_cap_new_peers(spark):
    b = table(spark, [(f"p{i:02d}", i, "c", 128, 0) for i in range(10)])
    known = b.where("peer_key = 'p09'").select("peer_key")
    out = MO.cap_new_peers(b, known, 3)
    assert sorted(x.peer_key for x in out.where("NOT withheld").collect()) == ["p00", "p01", "p02", "p09"]
    assert out.count() == 10  # the others are recorded as withheld


def test_running_totals(spark, tmp_path):
    p = packets(spark, 50)
    p.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    got = run_memory(MO.spi_stats(stream), "spi_out", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, MO.spi_stats(p).collect()))


def test_alert_codes(spark):
    v = FT.verdicts(table(spark, [("p", 1, "a", 128, 64), ("p", 2, "b", 128, 0), ("p", 3, "c", 80, 0)]))
    assert {r.capture: (r.exit_code, r.quantum_downgrades) for r in MO.alerts(v).collect()} == {"a": (0, 0), "b": (0, 1), "c": (3, 0)}
    assert v.select(F.max("delta_bits")).first()[0] == 0


def test_late_rows_are_dropped(spark, tmp_path):
    schema = packets(spark).schema
    # minute 0, then far ahead twice (late rows are judged by the watermark of the batch before), a row for the closed minute, further ahead
    for frames in ("0", "5000", "6000", "1", "9000"):
        spark.sql(f"SELECT 'c' capture, {frames}L frame, {frames}L * 1000000 ts_us, 'a' src, 'b' dst, 1L spi, 100L length").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    stream = MO.event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = MO.start_monitor(stream, str(tmp_path / "out"), str(tmp_path / "cp"), window="60 seconds", watermark="1 second", available_now=True)
    q.awaitTermination(120)
    first = spark.read.parquet(str(tmp_path / "out/windows")).where("window_us = 0").collect()
    assert [x.packets for x in first] == [1]


def test_quiet_links_are_forgotten(spark, tmp_path):
    o = table(spark, [("p", 1, "c", 128, 0), ("p", 2, "c", 80, 0)]).drop("at")
    for i in (1, 2):
        o.where(f"observed_us = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = run_memory(DR.drift_stream(stream, ttl_ms=1), "ttl_out", "append").collect()
    assert sorted(x.verdict for x in rows) == ["new", "new"]


def test_model_of_other_features_is_refused(spark, tmp_path, monkeypatch):
    import pytest

    from veilgauge.operators import ml as ML

    spark.createDataFrame([("0" * 64,)], "features string").write.json(str(tmp_path / "m/schema_guard"))
    with pytest.raises(ValueError):
        ML.load_model(str(tmp_path / "m"))
