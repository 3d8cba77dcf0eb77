"""Windowed monitoring of live packet tables. Every aggregate works on batch and stream inputs alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def event_time(df: DataFrame, ts_us: str = "ts_us") -> DataFrame:
    """Add `ts`, a TIMESTAMP; watermarks do not take zoneless timestamps."""
    return df.withColumn("ts", F.timestamp_micros(ts_us))


def window_flows(packets: DataFrame, window: str = "60 seconds", watermark: str | None = None) -> DataFrame:
    """Flow statistics per tumbling window."""
    p = packets.withWatermark("ts", watermark) if watermark else packets
    return p.groupBy(F.window("ts", window).alias("w"), "capture", "src", "dst", "spi").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.min("length").alias("min_length"), F.max("length").alias("max_length"))


def spi_stats(packets: DataFrame, window: str | None = None, watermark: str | None = None) -> DataFrame:
    """Running totals per SPI with first and last sight.

    On a stream give a window and a watermark: totals are then kept per window
    and forgotten behind the watermark, however many SPIs are made up.
    """
    p = packets.withWatermark("ts", watermark) if watermark else packets
    keys = [F.window("ts", window).alias("w"), "spi"] if window else ["spi"]
    return p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def rates(packets: DataFrame, seconds: int, watermark: str | None = None) -> DataFrame:
    """Packets and kilobits per second of each window."""
    p = packets.withWatermark("ts", watermark) if watermark else packets
    return p.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(
        (F.count(F.lit(1)) / seconds).alias("pps"), (F.sum("length") * 8 / 1000 / seconds).alias("kbps"))


def activity_sessions(packets: DataFrame, gap: str, key: str = "spi", watermark: str | None = None) -> DataFrame:
    """Bursts of one key: a new session starts after a silence of `gap`."""
    p = packets.withWatermark("ts", watermark) if watermark else packets
    return p.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"))


def recent(events: DataFrame, n: int = 50) -> DataFrame:
    """The newest n events; a top-k, each task keeps n rows."""
    return events.orderBy(F.desc("ts_us"), F.desc("frame")).limit(n)


def window_columns(df: DataFrame) -> DataFrame:
    start: Column = F.unix_micros(F.col("w.start"))
    return df.select(start.alias("window_us"), *[c for c in df.columns if c != "w"])


def alerts(judged: DataFrame, scores: DataFrame | None = None, fail_under: int | None = None) -> DataFrame:
    """Exit code per capture: 3 when a link fell below its baseline in classical bits, else 2 when the posture score is below `fail_under`, else 0.

    Loss of quantum strength is counted beside it and does not change the code.
    With `scores` (capture, score) every capture that has either has a row; no
    limit, or one of 0, means that no score fails. A capture without a score does not fail by it.
    """
    down = F.col("verdict") == "downgrade"
    drift = judged.groupBy("capture").agg(F.sum(down.cast("bigint")).alias("downgrades"), F.sum((F.col("verdict") == "downgrade-quantum").cast("bigint")).alias("quantum_downgrades"))
    worst = F.when(F.col("downgrades") > 0, 3)
    if scores is None:
        return drift.select("capture", worst.otherwise(0).alias("exit_code"), "downgrades", "quantum_downgrades")
    both = drift.join(scores.select("capture", "score"), "capture", "full_outer").fillna(0, ["downgrades", "quantum_downgrades"])
    failed = worst.when(F.col("score") < fail_under, 2) if fail_under else worst
    return both.select("capture", failed.otherwise(0).alias("exit_code"), "downgrades", "quantum_downgrades", "score")


def start_monitor(packets: DataFrame, out: str, checkpoint: str, window: str = "60 seconds", watermark: str = "2 minutes",
                  available_now: bool = False) -> StreamingQuery:
    """Flow windows of a packet stream appended to `out`, with one log row per completed batch.

    Append mode with a watermark: a window is written once, when it can no
    longer change; later rows for it are dropped. Batch id folders make a
    replayed batch overwrite itself, so a restarted job writes each window once.
    """
    stats = window_columns(window_flows(packets, window, watermark))

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{out}/windows/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)
        batch.sparkSession.read.schema(batch.schema).parquet(target).agg(F.count(F.lit(1)).alias("flows"), F.max("window_us").alias("last_window_us"), F.sum("packets").alias("packets")).write.mode(
            "overwrite").parquet(f"{out}/window_log/batch={batch_id}")

    w = stats.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def cap_new_peers(batch: DataFrame, known: DataFrame, max_new_peers: int = 64) -> DataFrame:
    """For foreachBatch: all rows, `withheld` where a new link of this batch is past the cap of its capture.

    A withheld row is recorded like any other; only a baseline is not opened from it.
    """
    from ..operators.fleet import new_peers

    past = new_peers(batch, known, max_new_peers).where("withheld").select("capture", "peer_key", "withheld")
    return batch.join(past, ["capture", "peer_key"], "left").withColumn("withheld", F.coalesce("withheld", F.lit(False)))
