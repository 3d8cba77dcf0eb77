"""Registered queries: batch twins of the streaming aggregates, and model based ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import flows as FL, framing as FR, evaluate as EV
from ..streaming import monitor as MO
from .catalog import query
from .flow_queries import _trace
from .session_queries import messages
from .stage import fingerprint, fresh, staged


def _packets(spark, d):
    return MO.event_time(A.esp_packets(spark, d))


def _keyed_state(spark):
    """Keyed processors hold several column families, which Spark's default state store has not."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("st_window_flows", """
SELECT ts_us // 86400000000 * 86400000000 AS window_us, capture, src, dst, spi, count(*) AS packets, sum(length)::BIGINT AS bytes, min(length) AS min_length, max(length) AS max_length FROM v_packets GROUP BY ALL""")
def _(spark, d):
    return MO.window_columns(MO.window_flows(_packets(spark, d), "1 day"))


@query("st_spi_stats", "SELECT spi, count(*) AS packets, sum(length)::BIGINT AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us FROM v_packets GROUP BY spi")
def _(spark, d):
    return MO.spi_stats(A.esp_packets(spark, d))


@query("st_rates", """
SELECT ts_us // 3600000000 * 3600000000 AS window_us, round(count(*) / 3600e0, 9) AS pps, round(sum(length) * 8 / 1000e0 / 3600, 9) AS kbps FROM v_packets GROUP BY 1""")
def _(spark, d):
    r = MO.window_columns(MO.rates(_packets(spark, d), 3600))
    return r.select("window_us", F.round("pps", 9).alias("pps"), F.round("kbps", 9).alias("kbps"))


@query("st_sessions", """
SELECT spi, min(ts_us) AS window_us, count(*) AS packets, sum(length)::BIGINT AS bytes FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY spi ORDER BY ts_us) AS sess FROM (
  SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY spi ORDER BY ts_us) < 14400000000 THEN 0 ELSE 1 END AS fresh FROM v_packets)) GROUP BY spi, sess""")
def _(spark, d):
    return MO.window_columns(MO.activity_sessions(_packets(spark, d), "4 hours"))


@query("st_recent", "SELECT frame, ts_us, spi, length FROM v_packets ORDER BY ts_us DESC, frame DESC LIMIT 50")
def _(spark, d):
    return MO.recent(A.esp_packets(spark, d)).select("frame", "ts_us", "spi", "length")


@query("st_recent_buffer", "SELECT sensor, frame, ts_us FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY frame DESC) AS rn FROM v_sensor) WHERE rn <= 15")
def _(spark, d):
    """The newest events of each sensor as a restarted stream's bounded state holds them after its last batch."""
    from ..streaming import drift as DR

    _keyed_state(spark)
    path = fresh(spark, "recent")
    p = A.sensor_packets(spark, d).select(F.col("sensor").cast("string").alias("sensor"), "frame", "ts_us", F.lit("ESP").alias("kind"))
    for part in _thirds(p):
        part.write.mode("append").parquet(f"{path}/in")
        stream = DR.recent_stream(spark.readStream.schema(part.schema).parquet(f"{path}/in"))
        q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(
            lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/out/{i}")).start()
        q.awaitTermination()
    shown = spark.read.parquet(f"{path}/out/*")
    last = shown.groupBy("sensor").agg(F.max("batch").alias("batch"))
    return shown.join(last, ["sensor", "batch"]).select(F.col("sensor").cast("int").alias("sensor"), "frame", "ts_us")


@query("st_ike_sessions", """
SELECT initiator_spi, min(ts_us) AS window_us, count(*) AS messages FROM (SELECT sid AS initiator_spi, ts_us FROM v_msg) GROUP BY initiator_spi""")
def _(spark, d):
    m = MO.event_time(messages(spark, d)).withColumn("length", F.lit(1))
    s = MO.window_columns(MO.activity_sessions(m, "1 hour", key="initiator_spi"))
    return s.select("initiator_spi", "window_us", F.col("packets").alias("messages"))


# --- drained streams: what a stream has written when its source is empty ---------------------
def _drained(spark, name, parts, stream_of, mode="append"):
    """Feed `parts` one after another to a file stream that is stopped and restarted between them; the rows it wrote."""
    _keyed_state(spark)
    path = fresh(spark, name)
    out = None
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        out = stream_of(spark.readStream.schema(part.schema).parquet(f"{path}/in"))
        q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{path}/out")
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("st_drift", "SELECT id, peer_key, verdict, base.bits AS baseline_bits FROM v_verdict")
def _(spark, d):
    """Verdicts of a restarted keyed stream over two halves of the observations equal the batch verdicts."""
    from .state_queries import obs

    from ..streaming import drift as DR

    o = obs(spark, d).drop("at")
    middle = o.agg(F.percentile_approx("observed_us", 0.5).alias("m")).first()["m"] or 0
    rows = _drained(spark, "drift", [o.where(F.col("observed_us") <= middle), o.where(F.col("observed_us") > middle)], DR.drift_stream)
    return rows.select("id", "peer_key", "verdict", "baseline_bits")


LATE_DAYS, DELAY_DAYS = 10, 2


@query("st_late", f"""
WITH b AS (SELECT max(ts_us) AS top FROM v_packets)
SELECT ts_us // 86400000000 * 86400000000 AS window_us, capture, src, dst, spi, count(*) AS packets, sum(length)::BIGINT AS bytes FROM v_packets, b
WHERE ts_us >= top - {LATE_DAYS} * 86400000000 AND ts_us // 86400000000 * 86400000000 + 86400000000 <= top - {DELAY_DAYS} * 86400000000 GROUP BY ALL""")
def _(spark, d):
    """Windows of a stream whose older packets arrive behind the watermark: closed windows only, late rows left out."""
    p = _packets(spark, d).select("ts", "ts_us", "capture", "src", "dst", "spi", "length")
    top = p.agg(F.max("ts_us").alias("m")).first()["m"] or 0
    on_time = F.col("ts_us") >= top - LATE_DAYS * 86400 * 10 ** 6
    rows = _drained(spark, "late", [p.where(on_time), p.where(~on_time)], lambda s: MO.window_flows(s, "1 day", f"{DELAY_DAYS} days"))
    return MO.window_columns(rows).select("window_us", "capture", "src", "dst", "spi", "packets", "bytes")


def _thirds(p):
    """Packets in three parts, one after the other in time; where they are cut does not matter to a stream."""
    at = p.agg(F.percentile_approx("ts_us", [0.34, 0.67]).alias("at")).first()["at"] or [0, 0]
    return [p.where(F.col("ts_us") <= at[0]), p.where((F.col("ts_us") > at[0]) & (F.col("ts_us") <= at[1])), p.where(F.col("ts_us") > at[1])]


# A timer is over when the watermark, in milliseconds and a second behind the newest packet, has passed it.
_PASSED = "({due} + 999) // 1000 < (SELECT max(ts_us) FROM {table}) // 1000 - 1000"


@query("src_packet_stream", f"""
SELECT sensor, "window", start_us, packets, bytes, truncated, CASE WHEN closed_by = 'open' THEN 'seconds' ELSE closed_by END AS closed_by
FROM v_chain WHERE closed_by <> 'open' OR {_PASSED.format(due='start_us + 21600000000', table='v_sensor')}""")
def _(spark, d):
    """Windows that a twice restarted stream of packets has closed by its three bounds, the last ones by timers."""
    from ..streaming import windows as WI
    from .ops_queries import CHAIN

    p = MO.event_time(A.sensor_packets(spark, d).select("sensor", "frame", "ts_us", "length"))
    return _drained(spark, "windows", _thirds(p), lambda s: WI.bounded_windows(s, *CHAIN))


@query("st_state_ttl", f"""
SELECT spi, first_us, last_us, packets, bytes FROM (SELECT *, max(last_us) OVER (PARTITION BY spi) AS newest FROM (
 SELECT spi, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS packets, sum(length)::BIGINT AS bytes FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY spi ORDER BY ts_us, frame) AS stretch FROM (
   SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY spi ORDER BY ts_us, frame) < 14400000000 THEN 0 ELSE 1 END AS fresh FROM v_packets)) GROUP BY spi, stretch))
WHERE last_us < newest OR {_PASSED.format(due='last_us + 14400000000', table='v_packets')}""")
def _(spark, d):
    """Stretches of activity that a twice restarted stream has emitted, each when its link had been silent for four hours."""
    from ..streaming import windows as WI

    p = _packets(spark, d).select("ts", "ts_us", "frame", "spi", "length")
    return _drained(spark, "quiet", _thirds(p), lambda s: WI.quiet_links(s, 14400))


# --- models (rows only: no SQL twin for a fitted model) ------------------------------------
def _training(spark, d):
    from ..operators import ml as ML

    def build():
        return ML.with_label(FL.flow_features(A.esp_packets(spark, d), fresh(spark, "gaps")), A.flow_truth(spark, d))

    return staged(spark, d, "training", build)


_MODELS: dict = {}


def _model(spark, d):
    from ..operators import ml as ML

    key = (spark.sparkContext.applicationId, d, fingerprint(spark, d))
    if key not in _MODELS:
        _MODELS[key] = ML.fit_ranker(ML.stratified(_training(spark, d))[0])
    return _MODELS[key]


def _held_out(spark, d):
    from ..operators import ml as ML

    return ML.stratified(_training(spark, d))[1]


@query("ml_forest")
def _(spark, d):
    return _model(spark, d).transform(_held_out(spark, d)).select(*FL.KEYS, "truth", F.col("c_forest").cast("int").alias("suite_index"))


@query("ml_second")
def _(spark, d):
    return _model(spark, d).transform(_held_out(spark, d)).select(*FL.KEYS, "truth", F.col("c_second").cast("int").alias("suite_index"))


@query("ml_convolution")
def _(spark, d):
    """Most likely suite of held-out flows by the convolution over their profiles."""
    from ..operators import convolution as CO, ml as ML

    train, test = ML.stratified(_training(spark, d))
    net, _losses = CO.fit_profile_net(train, len(ML.SUITE_INDEX), fresh(spark, "profiles"))
    best = F.expr("array_position(p_net, array_max(p_net)) - 1").cast("int")
    return CO.score_profiles(net, test).join(test.select(*FL.KEYS, "truth"), FL.KEYS).select(*FL.KEYS, "truth", best.alias("suite_index"))


@query("ml_blend")
def _(spark, d):
    from ..operators import ml as ML

    return ML.suite_probabilities(_model(spark, d), _held_out(spark, d)).withColumn("prob", F.round("prob", 6))


@query("holdout")
def _(spark, d):
    """Class and exact accuracy of blend and mask on flows the model has not seen."""
    from ..operators import ml as ML

    test = _held_out(spark, d)
    trace = _trace(spark, d).join(test.select(*FL.KEYS), FL.KEYS, "left_semi")
    p = FR.mask_probabilities(trace, ML.suite_probabilities(_model(spark, d), test))
    s = EV.scored(FR.ranked_suites(p, 1), FR.classify_flows(p), test.select(*FL.KEYS, "truth"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("class_accuracy"), F.avg(F.col("exact").cast("double")).alias("exact_accuracy"))


@query("eval_loco")
def _(spark, d):
    """Leave one of four capture groups out, arithmetic and model together."""
    from ..operators import ml as ML

    s = _training(spark, d).withColumn("fold", F.concat(F.lit("g"), F.expr("(spi - 4096) div 8 % 4")))

    def predict(train, test):
        model = ML.fit_ranker(train)
        trace = _trace(spark, d).join(test.select(*FL.KEYS), FL.KEYS, "left_semi")
        return FR.classify_flows(FR.mask_probabilities(trace, ML.suite_probabilities(model, test))).select(*FL.KEYS, "class")

    return ML.leave_one_capture_out(s, ["g0", "g1", "g2", "g3"], predict)


@query("eval_loco_captures")
def _(spark, d):
    """One row per capture: its flows, and those whose class trees that never saw the capture name right."""
    from ..operators import labels as LB, ml as ML

    s = _training(spark, d)
    p = FR.mask_probabilities(_trace(spark, d), ML.grouped_forests(s))
    judged = FR.classify_flows(p).select(*FL.KEYS, "class").join(s.select(*FL.KEYS, "truth"), FL.KEYS)
    hit = F.col("class") == LB.class_of(F.col("truth"))
    return judged.groupBy("capture").agg(F.count(F.lit(1)).alias("flows"), F.sum(hit.cast("bigint")).alias("hits"))


@query("eval_loco_split", """
SELECT capture, (g - i + 6) % 6 AS forest, flows, seen FROM (SELECT capture, count(*) AS flows, (('0x' || substr(md5(capture), 1, 8))::BIGINT % 6)::INT AS g, 0::BIGINT AS seen FROM v_flows GROUP BY capture), (SELECT unnest([0, 1])::INT AS i)""")
def _(spark, d):
    """Which trees score each capture, and how many of its flows these trees were grown on: none."""
    from ..operators import ml as ML

    s = FL.esp_flows(A.esp_packets(spark, d)).select(*FL.KEYS)
    scored = ML.unseen_by(s).groupBy("capture", "forest").agg(F.count(F.lit(1)).alias("flows"))
    forests = spark.range(6).select(F.col("id").cast("int").alias("forest"))
    grown = s.withColumn("group", ML.forest_group()).join(forests, F.pmod(F.col("group") - F.col("forest"), F.lit(6)) >= 2).groupBy("capture", "forest").agg(F.count(F.lit(1)).alias("seen"))
    return scored.join(grown, ["capture", "forest"], "left").select("capture", "forest", "flows", F.coalesce("seen", F.lit(0)).alias("seen"))


@query("corpus_union", """
SELECT CASE WHEN len_mean < 250 THEN 'short' ELSE 'long' END AS origin, truth, count(*) AS n FROM (
 SELECT capture, src, dst, spi, any_value(truth) AS truth, avg(length) AS len_mean FROM v_packets GROUP BY ALL HAVING count(*) >= 1) GROUP BY ALL""")
def _(spark, d):
    t = _training(spark, d)
    a, b = t.where("len_mean < 250"), t.where("len_mean >= 250 OR len_mean IS NULL")
    return a.withColumn("origin", F.lit("short")).unionByName(b.withColumn("origin", F.lit("long"))).groupBy("origin", "truth").agg(F.count(F.lit(1)).alias("n"))
