"""Registered queries: what the sinks write, stored verdicts, remaining functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import exposure as EX, fleet as FT, inventory as IN
from ..sources import sinks as SK
from ..streaming import monitor as MO
from .catalog import query
from .flow_queries import _trace, flow_classes
from .stage import fresh, small_tasks
from .session_queries import captures, findings, sess, strong
from .state_queries import obs


@query("sink_fleet_log", """
SELECT v.id, v.peer_key, v.verdict, b.best_classical_bits, b.observations FROM v_verdict v LEFT JOIN v_base b ON b.peer_key = v.peer_key""")
def _(spark, d):
    """A store of two interleaved writers, one of which commits twice, and a snapshot that one of them overtakes."""
    from ..sources.commit_log import CommitLog

    path = fresh(spark, "fleet-log")
    judged = FT.verdicts(obs(spark, d)).drop("at")
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    first, second = CommitLog(spark, path), CommitLog(spark, path)
    seen, folders = first.latest(), first.write({"observations": judged.where(half)})
    late = judged.where(~half)

    def snapshot(rows):
        if not second.committed("second"):  # rows that arrive while the snapshot is made
            second.append("second", {"observations": late})
        return FT.baselines(rows.withColumn("at", F.struct(F.col("observed_us").alias("first_us"), "id"))).drop("best_transforms")

    for _ in range(2):
        first.commit("first", folders, seen)
    first.derive("baselines", "observations", snapshot, judged.schema)
    schema = "peer_key string, id string, verdict string"
    base = first.read("baselines", "peer_key string, best_classical_bits int, observations bigint")
    return second.read("observations", schema).join(base, "peer_key", "left").select("id", "peer_key", "verdict", "best_classical_bits", "observations")


@query("st_peer_cap", """
SELECT capture, peer_key, count(*) AS rows, any_value(known IS NULL AND pos > 4) AS withheld FROM v_obs o JOIN (
 SELECT capture, peer_key, CASE WHEN peer_key LIKE '10.1.0.%' THEN 1 END AS known, row_number() OVER (PARTITION BY capture, peer_key LIKE '10.1.0.%' ORDER BY observed_us, id) AS pos FROM (
  SELECT capture, peer_key, min(observed_us) AS observed_us, arg_min(id, (observed_us, id)) AS id FROM v_obs GROUP BY capture, peer_key)) w USING (capture, peer_key) GROUP BY ALL""")
def _(spark, d):
    """The cap on new links inside a stream of two parts, the first of which is delivered twice."""
    from ..sources.commit_log import CommitLog
    from ..streaming import peers as PE

    o, path = obs(spark, d), fresh(spark, "peer-cap")
    known = o.where("peer_key LIKE '10.1.0.%'").select("peer_key").distinct()
    middle = o.agg(F.percentile_approx("observed_us", 0.5).alias("m")).first()["m"] or 0
    for i, part in enumerate([o.where(F.col("observed_us") <= middle), o.where(F.col("observed_us") > middle)]):
        part.write.parquet(f"{path}/in/part={i}")
        stream = spark.readStream.schema(o.schema).parquet(f"{path}/in/part=*")
        # the checkpoint of the first run is lost: its batch comes again
        for checkpoint in (["lost", "kept"] if i == 0 else ["kept"]):
            PE.start_peer_cap(stream, f"{path}/store", f"{path}/{checkpoint}", known, 4, available_now=True).awaitTermination()
    rows = CommitLog(spark, f"{path}/store").read("rows", "capture string, peer_key string, withheld boolean")
    return rows.groupBy("capture", "peer_key").agg(F.count(F.lit(1)).alias("rows"), F.bool_or("withheld").alias("withheld"))


@query("sink_audit_log", """
SELECT 'assessment' AS event, p.capture, p.score, p.grade, p.critical, p.high, p.medium, p.low, p.info, d.digest FROM v_posture p LEFT JOIN (
 SELECT capture, substr(sha256(string_agg(rule_id || ':' || subject, '|' ORDER BY rule_id || ':' || subject)), 1, 16) AS digest FROM v_findings GROUP BY capture) d ON d.capture = p.capture""")
def _(spark, d):
    """A log written, appended to and read back: one record per assessment."""
    path, all_captures, f = fresh(spark, "audit"), captures(spark, d), findings(spark, d)
    early = F.pmod(F.xxhash64("capture"), F.lit(2)) == 0
    with small_tasks(spark, d):
        for part in (early, ~early):
            SK.append_audit_log(path, all_captures.where(part), f.where(part))
    return SK.read_audit_log(spark, path)


def field(path):
    return F.get_json_object("body", path)


@query("sink_report", """
SELECT capture, part, item, count(*) AS lines FROM (SELECT capture, 'finding' AS part, rule_id || ' ' || subject AS item FROM v_findings
 UNION ALL SELECT capture, 'session', sid FROM v_sa UNION ALL SELECT capture, 'flow', flow || ' ' || class FROM v_top) GROUP BY ALL""")
def _(spark, d):
    """Written and read back: what each line says."""
    path = fresh(spark, "report")
    parts = {"finding": findings(spark, d), "session": strong(spark, d), "flow": flow_classes(spark, d)}
    with small_tasks(spark, d, times=2):  # six lines an order, each sorted by capture before it is written
        SK.write_report(path, parts)
    lines = spark.read.schema("part string, body string, capture string").json(path)
    item = F.when(F.col("part") == "finding", F.concat_ws(" ", field("$.rule_id"), field("$.subject"))).when(
        F.col("part") == "session", field("$.sid")).otherwise(F.concat_ws(" ", field("$.flow"), field("$.class")))
    return lines.groupBy("capture", "part", item.alias("item")).agg(F.count(F.lit(1)).alias("lines"))


@query("sink_inventory", """
SELECT part, item, count(*) AS lines FROM (SELECT 'component' AS part, 'protocol' AS item FROM v_str UNION ALL SELECT 'component', 'algorithm' FROM v_algs UNION ALL SELECT 'component', 'algorithm' FROM v_top
 UNION ALL SELECT 'vulnerability', severity FROM v_findings WHERE severity IN ('critical', 'high')
 UNION ALL SELECT 'document', capture || ' ' || score || ' ' || grade FROM v_posture) GROUP BY ALL""")
def _(spark, d):
    """Written and read back: documents with posture, components by kind, vulnerabilities by severity."""
    s, path = strong(spark, d), fresh(spark, "inventory")
    lines = SK.component_lines(IN.protocols(s), IN.algorithms(s), IN.esp_assets(flow_classes(spark, d)), IN.vulnerabilities(findings(spark, d)))
    SK.write_inventory(path, lines.unionByName(SK.inventory_header(captures(spark, d), findings(spark, d))))
    read = spark.read.schema("body string, capture string, part string").json(path)
    item = F.when(F.col("part") == "document", F.concat_ws(" ", field("$.metadata.component.name"), field("$.metadata.properties[0].value"), field("$.metadata.properties[1].value"))).when(
        F.col("part") == "component", field("$.cryptoProperties.assetType")).otherwise(field("$.ratings[0].severity"))
    whole = F.when(F.col("part") == "document", field("$.specVersion") == "1.6").otherwise(F.startswith(field("$.bom-ref"), F.lit("crypto:")))
    return read.where(whole).groupBy("part", item.alias("item")).agg(F.count(F.lit(1)).alias("lines"))


@query("sink_dataset_export", """
SELECT p.capture, CASE WHEN p.findings > 0 THEN 'documents/capture=' || p.capture END AS file, p.findings, p.score, p.grade, p.findings AS lines, true AS sized FROM v_posture p""")
def _(spark, d):
    """Manifest and documents as they were written; `sized`: the stated bytes are those of the lines."""
    path = fresh(spark, "dataset")
    SK.export_dataset(path, captures(spark, d), findings(spark, d))
    manifest = spark.read.schema("capture string, file string, bytes bigint, findings bigint, score int, grade string").json(f"{path}/manifest")
    stored = spark.read.schema("body string, capture string").json(f"{path}/documents").groupBy("capture").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("body")).alias("stored"))
    return manifest.join(stored, "capture", "left").select(
        "capture", "file", "findings", "score", "grade", F.coalesce("lines", F.lit(0)).alias("lines"), (F.coalesce("stored", F.lit(0)) == F.col("bytes")).alias("sized"))


@query("st_newpeer_cap", """
SELECT capture, count(*) AS admitted FROM (SELECT capture, peer_key, row_number() OVER (PARTITION BY capture ORDER BY observed_us, id) AS pos FROM (
 SELECT capture, peer_key, min(observed_us) AS observed_us, min(id) AS id FROM v_obs WHERE peer_key NOT LIKE '10.1.0.%' GROUP BY capture, peer_key)) WHERE pos <= 4 GROUP BY capture""")
def _(spark, d):
    o = obs(spark, d)
    known = o.where("peer_key LIKE '10.1.0.%'").select("peer_key").distinct()
    admitted = MO.cap_new_peers(o, known, 4).where("peer_key NOT LIKE '10.1.0.%' AND NOT withheld")
    return admitted.select("capture", "peer_key").distinct().groupBy("capture").agg(F.count(F.lit(1)).alias("admitted"))


@query("st_window_log", """
SELECT ts_us // 86400000000 * 86400000000 AS window_us, count(DISTINCT capture || src || dst || spi) AS flows, count(*) AS packets FROM v_packets GROUP BY 1""")
def _(spark, d):
    w = MO.window_columns(MO.window_flows(MO.event_time(A.esp_packets(spark, d)), "1 day"))
    return w.groupBy("window_us").agg(F.count(F.lit(1)).alias("flows"), F.sum("packets").alias("packets"))


@query("fn_link_id", "SELECT DISTINCT capture, pa || '~' || pb AS link FROM v_sa")
def _(spark, d):
    from ..functions.net import add_link

    s = sess(spark, d).select("capture", "peer_a", "peer_b")
    return add_link(s, F.col("peer_a"), F.col("peer_b")).select("capture", "link").distinct()


@query("fn_residue", "SELECT flow, suite, expected_residue, min_length % boundary = expected_residue AS shortest_fits FROM v_trace")
def _(spark, d):
    return _trace(spark, d).select("flow", "suite", "expected_residue", (F.col("min_length") % F.col("boundary") == F.col("expected_residue")).alias("shortest_fits"))


@query("fn_deadline", """
SELECT o_orderkey, CASE WHEN m = 0 THEN 'under 1 month' ELSE printf('%d yr %02d mo', m // 12, m % 12) END AS deadline FROM (
 SELECT o_orderkey, round(abs((o_orderkey % 700) / 100e0 - 3) * 12)::INT AS m FROM orders)""")
def _(spark, d):
    o = A.table(spark, d, "orders").selectExpr("o_orderkey", "(o_orderkey % 700) / 100D - 3 AS gap")
    return o.select("o_orderkey", EX.deadline(F.col("gap")).alias("deadline"))


@query("sink_fleet_store", """
SELECT v.id, v.peer_key, v.verdict, b.best_classical_bits, b.observations FROM v_verdict v LEFT JOIN v_base b ON b.peer_key = v.peer_key""")
def _(spark, d):
    """A store written twice under one version and read back: every verdict once, with the newest snapshot."""
    o, path = obs(spark, d), fresh(spark, "fleet")
    judged, base = FT.verdicts(o), FT.baselines(o).drop("best_transforms")
    for _ in range(2):
        SK.write_fleet(path, 1, judged, base)
    schema = "peer_key string, id string, verdict string"
    snapshot = SK.read_baselines(spark, path, "peer_key string, best_classical_bits int, observations bigint")
    return SK.read_fleet(spark, path, schema).join(snapshot, "peer_key", "left").select("id", "peer_key", "verdict", "best_classical_bits", "observations")


@query("base_withheld", """
SELECT v.id, v.capture, CASE WHEN w.pos > 2 THEN 'withheld' ELSE v.verdict END AS verdict FROM v_verdict v LEFT JOIN (
 SELECT capture, peer_key, row_number() OVER (PARTITION BY capture ORDER BY observed_us, id) AS pos FROM (
  SELECT capture, peer_key, min(observed_us) AS observed_us, min(id) AS id FROM v_obs GROUP BY capture, peer_key)) w ON w.capture = v.capture AND w.peer_key = v.peer_key""")
def _(spark, d):
    """Observations of new links past the cap of their capture stay, as withheld."""
    o = obs(spark, d)
    return FT.withhold(FT.verdicts(o), o, None, 2).select("id", "capture", "verdict")
