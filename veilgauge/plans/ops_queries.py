"""Registered queries: labels, validation, sensor operations, plans, policy, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A, registries as R
from ..operators import evaluate as EV, flows as FL, framing as FR, labels as LB, operations as OP, posture as PO
from .catalog import query
from .flow_queries import _flows, _trace, flow_classes
from .session_queries import findings, sess, strong


# --- labels -----------------------------------------------------------------------
@query("src_labels", """
SELECT idx, CASE WHEN p IS NULL AND idx > min(CASE WHEN p IS NULL THEN idx END) OVER (PARTITION BY cap, spi) AND spi IS NOT NULL THEN 'spi labelled twice' ELSE p END AS problem FROM (
 SELECT *, CASE WHEN idx % 13 = 0 THEN 'unknown suite' WHEN idx % 17 = 0 THEN 'no source' WHEN has_spi = has_peers THEN 'one of spi or peers' WHEN has_spi AND bad THEN 'spi is not hex'
   WHEN has_spi AND spi = 0 THEN 'spi out of range' WHEN has_peers AND idx % 31 = 0 THEN 'peers are not two addresses' END AS p FROM (
  SELECT o_orderkey AS idx, o_orderkey % 50 AS cap, o_orderkey % 3 <> 1 OR o_orderkey % 19 = 0 AS has_spi, o_orderkey % 3 = 1 AS has_peers, o_orderkey % 29 = 0 AS bad,
   CASE WHEN NOT (o_orderkey % 3 <> 1 OR o_orderkey % 19 = 0) OR o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 0 WHEN o_orderkey % 5 = 0 THEN o_custkey % 40 + 1 ELSE o_orderkey + 1000 END AS spi FROM orders))""")
def _(spark, d):
    return LB.validate(A.raw_labels(spark, d)).select("idx", "problem")


@query("fn_spi_parse", "SELECT DISTINCT idx, CASE WHEN o % 29 <> 0 THEN CASE WHEN o % 23 = 0 THEN 0 WHEN o % 5 = 0 THEN c % 40 + 1 ELSE o + 1000 END END AS spi FROM (SELECT o_orderkey AS idx, o_orderkey AS o, o_custkey AS c FROM orders WHERE o_orderkey % 3 <> 1 OR o_orderkey % 19 = 0)")
def _(spark, d):
    return A.raw_labels(spark, d).where("spi_text IS NOT NULL").select("idx", LB.parse_spi(F.col("spi_text")).alias("spi"))


def _matched(spark, d):
    return LB.match(_flows(spark, d).select("capture", "src", "dst", "spi", "flow", "packets"), A.flow_labels(spark, d))


@query("label_match", "SELECT flow, label_idx, label_suite FROM v_matched")
def _(spark, d):
    return _matched(spark, d).select("flow", "label_idx", "label_suite")


@query("label_unmatched", "SELECT capture, 2 AS idx, spi + 100000 AS spi FROM v_truth WHERE host % 4 = 2 UNION ALL SELECT capture, 1, NULL FROM v_truth WHERE host % 4 = 1")
def _(spark, d):
    labels = A.flow_labels(spark, d)
    return LB.unmatched(labels, _matched(spark, d)).select("capture", "idx", "spi")


def _label_scored(spark, d):
    c = flow_classes(spark, d).select(*FL.KEYS, F.col("class").alias("pred_class"))
    m = _matched(spark, d).join(c, FL.KEYS)
    return m.withColumn("hit", LB.class_of(F.col("label_suite")) == F.col("pred_class"))


@query("label_rollup", """
SELECT m.capture, count(label_suite) AS labelled, sum((s.class = t.class)::INT)::BIGINT AS hits, count(label_suite) - coalesce(sum((s.class = t.class)::INT), 0)::BIGINT AS misses,
 coalesce(bool_and(s.class = t.class), false) AS passed FROM v_matched m JOIN v_top t ON t.flow = m.flow LEFT JOIN d_suite s ON s.suite = m.label_suite GROUP BY m.capture""")
def _(spark, d):
    return LB.rollup(_label_scored(spark, d))


@query("miss_diagnosis", """
SELECT m.flow, s.class, CASE WHEN count(t.failed) = count(*) THEN 'all excluded' WHEN count(t.failed) > 0 THEN 'some excluded' ELSE 'outranked' END AS diagnosis
FROM v_matched m JOIN d_suite s ON s.suite = m.label_suite JOIN v_trace t ON t.flow = m.flow AND t.class = s.class GROUP BY m.flow, s.class""")
def _(spark, d):
    m = _matched(spark, d)
    return LB.miss_diagnosis(_trace(spark, d), m).join(m.select(*FL.KEYS, "flow"), FL.KEYS).select("flow", "class", "diagnosis")


# --- validation ---------------------------------------------------------------------
def _scored(spark, d, masked=True, prior=None):
    t = _trace(spark, d)
    p = FR.mask_probabilities(t if masked else t.withColumn("eliminated_by", F.lit(None).cast("string")), prior(t) if prior else None)
    return EV.scored(FR.ranked_suites(p, 1), FR.classify_flows(p), A.flow_truth(spark, d))


@query("eval_confusion", "SELECT true_class, pred_class, count(*) AS n, sum(exact::INT)::BIGINT AS exact FROM v_scored GROUP BY ALL")
def _(spark, d):
    return EV.confusion(_scored(spark, d))


@query("eval_by_condition", """
SELECT condition, count(*) AS n, round(avg(hit::INT), 6) AS accuracy FROM (SELECT 'tfc=' || tfc AS condition, hit FROM v_scored UNION ALL SELECT 'mode=' || mode, hit FROM v_scored UNION ALL SELECT 'loss=' || loss, hit FROM v_scored) GROUP BY condition""")
def _(spark, d):
    return EV.by_condition(_scored(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query("eval_mask_alone", """
SELECT count(*) AS n, round(avg((c = 1)::INT), 6) AS resolved, round(avg((c = 1 AND sole = true_class)::INT), 6) AS correct, sum((c = 1 AND sole <> true_class)::INT)::BIGINT AS wrong_when_resolved, round(avg(n), 6) AS mean_survivors FROM (
 SELECT t.flow, any_value(s.class) AS true_class, count(DISTINCT CASE WHEN failed IS NULL THEN t.class END) AS c, max(CASE WHEN failed IS NULL THEN t.class END) AS sole, sum((failed IS NULL)::INT) AS n
 FROM v_trace t JOIN d_suite s ON s.suite = t.truth GROUP BY t.flow)""")
def _(spark, d):
    m = EV.mask_alone(_trace(spark, d), A.flow_truth(spark, d))
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("resolved", "correct", "mean_survivors")], "wrong_when_resolved")


@query("eval_calibration", """
SELECT bin, n, round(c, 6) AS mean_confidence, round(a, 6) AS accuracy, round(sum(n * abs(a - c)) OVER () / sum(n) OVER (), 6) AS ece FROM (
 SELECT least(floor(round(confidence * 10, 9)), 9)::BIGINT AS bin, count(*) AS n, avg(confidence) AS c, avg(hit::INT) AS a FROM v_scored GROUP BY 1)""")
def _(spark, d):
    c = EV.calibration(_scored(spark, d))
    return c.select(F.col("bin").cast("bigint").alias("bin"), "n", *[F.round(x, 6).alias(x) for x in ("mean_confidence", "accuracy", "ece")])


@query("eval_ablation", """
SELECT n, round(mc, 6) AS masked_class, round(me, 6) AS masked_exact, round(rc, 6) AS raw_class, round(re, 6) AS raw_exact, round(mc - rc, 6) AS mask_contribution FROM (
 SELECT count(*) AS n, avg((s.class = m.class)::INT) AS mc, avg((m.suite = t.truth)::INT) AS me, avg((s.class = 'AEAD or counter mode')::INT) AS rc, avg((t.truth = 'NULL encryption / HMAC-SHA1-96')::INT) AS re
 FROM v_truth t JOIN d_suite s ON s.suite = t.truth JOIN (
  SELECT b.flow, b.suite, c.class FROM (SELECT flow, arg_max(suite, struct_pack(x := (failed IS NULL)::INT, o := ord)) AS suite FROM v_trace GROUP BY flow) b JOIN (
   SELECT flow, arg_max(class, mass) AS class FROM (SELECT flow, class, sum(CASE WHEN failed IS NULL THEN ord + 1 ELSE 0 END) + sum(ord + 1) * 0.001e0 * (sum((failed IS NULL)::INT) OVER (PARTITION BY flow, class) = -1)::INT AS mass FROM v_trace GROUP BY flow, class, failed) GROUP BY flow) c ON c.flow = b.flow) m ON m.flow = t.flow)""".replace(
    "SELECT flow, class, sum(CASE WHEN failed IS NULL THEN ord + 1 ELSE 0 END) + sum(ord + 1) * 0.001e0 * (sum((failed IS NULL)::INT) OVER (PARTITION BY flow, class) = -1)::INT AS mass FROM v_trace GROUP BY flow, class, failed",
    "SELECT flow, class, sum(CASE WHEN failed IS NULL THEN ord + 1 ELSE 0 END) AS mass FROM v_trace GROUP BY flow, class"))
def _(spark, d):
    def prior(t):
        return t.select(*FL.KEYS, "suite", ((F.col("ord") + 1) / 45.0).alias("prob"))

    a = EV.ablation(_scored(spark, d, True, prior), _scored(spark, d, False, prior))
    return a.select("n", *[F.round(c, 6).alias(c) for c in ("masked_class", "masked_exact", "raw_class", "raw_exact", "mask_contribution")])


@query("corpus_mix", """
SELECT sum((mode <> 'tunnel')::INT)::BIGINT AS synthetic_flows, sum((mode = 'tunnel')::INT)::BIGINT AS real_flows, count(DISTINCT CASE WHEN mode = 'tunnel' THEN capture END) AS real_captures,
 round(avg((mode = 'tunnel')::INT), 4) AS real_fraction FROM v_truth""")
def _(spark, d):
    return EV.corpus_mix(A.flow_truth(spark, d).withColumn("real", F.col("mode") == "tunnel"))


@query("fold_leakage", "SELECT flow, count(DISTINCT capture) AS folds FROM v_truth GROUP BY flow HAVING count(DISTINCT capture) > 1 UNION ALL SELECT 'total', count(*) FROM v_truth")
def _(spark, d):
    f = _flows(spark, d).select("flow", "capture")
    per = f.distinct().groupBy("flow").agg(F.count(F.lit(1)).alias("folds"))
    return per.where("folds > 1").unionByName(f.agg(F.count(F.lit(1)).alias("folds")).select(F.lit("total").alias("flow"), "folds"))


# --- sensors ------------------------------------------------------------------------
NOW_US = 1706659200000000  # 2024-01-31


@query("window_health", f"""
SELECT sensor, age AS age_seconds, CASE WHEN age < -60 THEN 'degraded' WHEN age > 3 * 7320 THEN 'failed' WHEN age > 7320 THEN 'degraded' ELSE 'healthy' END AS status FROM (
 SELECT sensor, ({NOW_US} - max(completed_us)) / 1e6 AS age FROM v_log GROUP BY sensor)""")
def _(spark, d):
    return OP.window_health(A.window_log(spark, d), NOW_US).select("sensor", "age_seconds", "status")


@query("window_loss", 'SELECT sensor, "window", packets, dropped, round(dropped / greatest(packets + dropped, 1) * 100, 6) AS loss_pct FROM v_log')
def _(spark, d):
    return OP.window_loss(A.window_log(spark, d)).select("sensor", "window", "packets", "dropped", F.round("loss_pct", 6).alias("loss_pct"))


@query("win_close", """
SELECT sensor, "window", count(*) AS packets, sum(length)::BIGINT AS bytes, sum(length) >= 600 AND count(*) < 4 AS truncated FROM (
 SELECT *, min(CASE WHEN nth >= 4 OR total >= 600 THEN nth END) OVER (PARTITION BY sensor, "window") AS stop FROM (
  SELECT *, row_number() OVER w AS nth, sum(length) OVER w AS total FROM v_sensor WINDOW w AS (PARTITION BY sensor, "window" ORDER BY frame))) WHERE stop IS NULL OR nth <= stop GROUP BY ALL""")
def _(spark, d):
    return OP.close_windows(A.sensor_packets(spark, d), ["sensor", "window"], 4, 600)


CHAIN = (4, 600, 21600)  # packets, bytes, seconds of a window


@query("win_chain", 'SELECT sensor, "window", start_us, packets, bytes, truncated, closed_by FROM v_chain')
def _(spark, d):
    """All windows of all sensors, each behind the one before, by packet, byte and time bounds."""
    from ..operators.windows import chained_windows
    from .stage import fresh

    return chained_windows(A.sensor_packets(spark, d), "sensor", *CHAIN, root=fresh(spark, "windows"))


@query("rate_guard", """
SELECT frame, recent, recent <= 3 AS allowed FROM (SELECT frame, count(*) OVER (PARTITION BY sensor ORDER BY ts_us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS recent FROM v_sensor)""")
def _(spark, d):
    return OP.rate_guard(A.sensor_packets(spark, d), "sensor", "ts_us", 3, 21600).select("frame", "recent", "allowed")


@query("ev_retention", """
SELECT sensor AS dir, 'window-' || "window" || '.pcap' AS name, packets AS bytes FROM (
 SELECT *, row_number() OVER w AS nth, sum(packets) OVER w AS total, (SELECT count(*) FROM v_log p WHERE p.sensor = f.sensor AND p."window" % 11 = 0) AS pn,
  (SELECT coalesce(sum(packets), 0) FROM v_log p WHERE p.sensor = f.sensor AND p."window" % 11 = 0) AS pb FROM v_log f WHERE "window" % 11 <> 0
  WINDOW w AS (PARTITION BY sensor ORDER BY completed_us DESC, 'window-' || "window" || '.pcap')) WHERE nth > greatest(12 - pn, 0) OR total + pb > 30""")
def _(spark, d):
    log = A.window_log(spark, d).select(
        F.col("sensor").alias("dir"), F.concat(F.lit("window-"), F.col("window"), F.lit(".pcap")).alias("name"), F.col("completed_us").alias("mtime_us"),
        F.col("packets").alias("bytes"), (F.col("window") % 11 == 0).alias("protected"))
    return OP.evidence_to_delete(log, keep=12, max_bytes=30)


@query("bench_summary", """
SELECT sensor, any_value(CASE WHEN rn = n // 2 + 1 THEN r END) FILTER (rn = n // 2 + 1) AS median, min(r) AS low, max(r) AS high, any_value(n) AS runs FROM (
 SELECT user_id AS sensor, value AS r, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY sensor""")
def _(spark, d):
    runs = A.table(spark, d, "events").select(F.col("user_id").alias("sensor"), F.col("value").alias("rate"), F.col("event_id").alias("run"))
    return OP.bench_summary(runs, "sensor", "rate")


# --- plans ---------------------------------------------------------------------------
PLANS = """
SELECT t.capture, coalesce(p.platform, 'strongswan') AS platform, t.findings, t.critical FROM (
 SELECT capture, count(*) AS findings, sum((severity = 'critical')::INT)::BIGINT AS critical FROM v_findings WHERE severity <> 'info' GROUP BY capture) t
LEFT JOIN (SELECT DISTINCT capture, vendor_family AS platform FROM v_family WHERE vendor_family IN ('cisco', 'strongswan', 'fortinet', 'juniper')) p ON p.capture = t.capture"""


@query("plan_register", PLANS)
def _(spark, d):
    return OP.plans(findings(spark, d), strong(spark, d)).select("capture", "platform", "findings", "critical")


@query("plan_merge", f"""
SELECT n.capture, n.platform, coalesce(e.status, 'PENDING_REVIEW') AS status, e.approver FROM ({PLANS}) n
LEFT JOIN (SELECT DISTINCT capture, 'cisco' AS platform, 'APPROVED' AS status, 'ops' AS approver FROM v_sa WHERE k % 100 < 50) e ON e.capture = n.capture AND e.platform = n.platform""")
def _(spark, d):
    old = sess(spark, d).where(F.substring("capture", 9, 2).cast("int") < 50).select("capture").distinct().selectExpr(
        "capture", "'cisco' AS platform", "concat('p-', capture) AS plan_id", "'APPROVED' AS status", "'ops' AS approver")
    return OP.merge_plans(OP.plans(findings(spark, d), strong(spark, d)), old).select("capture", "platform", "status", "approver")


def _transitions(spark, d):
    return A.table(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS plan_id", "CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'STAGED' ELSE 'REJECTED' END AS to_state", "o_orderpriority AS actor")


@query("plan_status", """
SELECT o_custkey AS plan_id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'STAGED' ELSE 'REJECTED' END, o_orderkey) AS status,
 arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS approver, max(o_orderkey) AS last_id, count(*) AS transitions FROM orders GROUP BY o_custkey""")
def _(spark, d):
    return OP.plan_status(_transitions(spark, d))


@query("plans_sort", "SELECT plan_id, row_number() OVER (ORDER BY last_id DESC) AS pos FROM (SELECT o_custkey AS plan_id, max(o_orderkey) AS last_id FROM orders GROUP BY o_custkey)")
def _(spark, d):
    p = OP.plan_status(_transitions(spark, d)).withColumn("all", F.lit(1))
    return PO.positioned(p, ["all"], [F.desc("last_id")], [-F.floor(F.col("last_id") / 1024)]).select("plan_id", "pos")


# --- policy -----------------------------------------------------------------------------
OVERLAY = """SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'DH_PROHIBITED' WHEN 1 THEN 'ENCR_PROHIBITED' ELSE 'MIN_KEY_BITS' END AS setting,
 CASE p_partkey % 3 WHEN 0 THEN cast(p_size AS {text}) WHEN 1 THEN p_brand ELSE '256' END AS key FROM part"""


@query("policy_merge", f"""
SELECT setting, key, max(origin) AS origin FROM (SELECT setting, key, 'base' AS origin FROM d_overlayable WHERE setting <> 'MIN_KEY_BITS' UNION ALL SELECT setting, key, 'overlay' FROM ({OVERLAY.format(text='VARCHAR')})) GROUP BY setting, key""")
def _(spark, d):
    A.table(spark, d, "part").createOrReplaceTempView("part")
    return OP.merge_policy(OP.policy_table(spark), spark.sql(OVERLAY.format(text="string")))


@query("src_policy", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'unknown setting' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'not an integer' END WHEN 2 THEN CASE WHEN p_partkey % 4 = 0 THEN 'group is not a number' END END AS problem FROM part""")
def _(spark, d):
    raw = A.table(spark, d, "part").selectExpr(
        "p_partkey", "CASE p_partkey % 5 WHEN 0 THEN 'ENCR_FORBIDDEN' WHEN 1 THEN 'MIN_KEY_BITS' WHEN 2 THEN 'DH_LEGACY' ELSE 'WEAK_AUTH' END AS setting",
        "CASE p_partkey % 5 WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'many' ELSE '192' END WHEN 2 THEN CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE '14' END ELSE 'name' END AS value")
    return OP.check_overlay(raw).select("p_partkey", "problem")


# --- text functions ------------------------------------------------------------------------
@query("fn_safe_text", r"""
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE substr(t, 1, 119) || '…' END AS safe FROM (
 SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)""")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", OP.safe_text(F.col("text")).alias("safe"))


@query("fn_iso_ts", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS stamp FROM events")
def _(spark, d):
    return A.table(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("stamp"))


@query("fn_json", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def _(spark, d):
    return A.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("fn_kex_name", "SELECT o_orderkey, coalesce(d.gname, 'GROUP_' || (o_orderkey % 45)) AS name FROM orders LEFT JOIN d_dh d ON d.gid = o_orderkey % 45")
def _(spark, d):
    from ..functions.vendor import kex_name

    return A.table(spark, d, "orders").select("o_orderkey", kex_name(F.expr("o_orderkey % 45")).alias("name"))


@query("fn_exchange_name", """
SELECT o_orderkey, CASE o_orderkey % 12 + 34 WHEN 34 THEN 'IKE_SA_INIT' WHEN 35 THEN 'IKE_AUTH' WHEN 36 THEN 'CREATE_CHILD_SA' WHEN 37 THEN 'INFORMATIONAL' WHEN 43 THEN 'IKE_INTERMEDIATE' WHEN 44 THEN 'IKE_FOLLOWUP_KE'
 ELSE 'EXCHANGE_' || (o_orderkey % 12 + 34) END AS name FROM orders""")
def _(spark, d):
    from ..functions.vendor import exchange_name

    return A.table(spark, d, "orders").select("o_orderkey", exchange_name(F.expr("o_orderkey % 12 + 34")).alias("name"))


@query("fn_vendor", """
SELECT id, CASE kind WHEN 0 THEN 'strongSwan' WHEN 1 THEN 'Cisco Unity' WHEN 2 THEN 'vendor text ' || (id % 100) ELSE 'unknown:' || substr(lower(lpad(to_hex(id), 16, '0')), 1, 16) END AS vendor
FROM (SELECT event_id AS id, event_id % 4 AS kind FROM events)""")
def _(spark, d):
    from ..functions.vendor import vendor_name

    e = A.table(spark, d, "events").selectExpr("event_id AS id", "CASE event_id % 4 WHEN 0 THEN unhex('882fe56d6fd20dbc2251613b2ebe5bebff') WHEN 1 THEN unhex('12f5f28c457168a9702d9fe274cc0100')"
                                               " WHEN 2 THEN cast(concat('vendor text ', event_id % 100) AS binary) ELSE unhex(concat(lpad(hex(event_id), 16, '0'), 'FF')) END AS payload")
    return e.select("id", vendor_name(F.col("payload")).alias("vendor"))
