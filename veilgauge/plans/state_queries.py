"""Registered queries: fleet state, exposure, inventory, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import compare as CO, exposure as EX, fleet as FT, inventory as IN, posture as PO, sessions as S, strength as ST
from .catalog import query
from .flow_queries import flow_classes
from .stage import fresh, staged
from .session_queries import findings, flow_volumes, link_rows, sess, strong


def obs(spark, d):
    return staged(spark, d, "observations", lambda: FT.observations(strong(spark, d)))


joined = lambda c: F.array_join(c, ",")


@query("base_verdict", """
SELECT id, peer_key, observed_us, classical_bits, quantum_bits, verdict, base.bits AS baseline_bits, base.t AS baseline_transforms FROM v_verdict""")
def _(spark, d):
    v = FT.verdicts(obs(spark, d))
    return v.select("id", "peer_key", "observed_us", "classical_bits", "quantum_bits", "verdict", "baseline_bits",
                    joined("baseline_transforms").alias("baseline_transforms"))


@query("base_lookup", "SELECT id, base.bits AS baseline_bits, classical_bits - base.bits AS delta_bits FROM v_verdict WHERE base IS NOT NULL")
def _(spark, d):
    return FT.verdicts(obs(spark, d)).where("baseline_bits IS NOT NULL").select("id", "baseline_bits", "delta_bits")


@query("src_baseline", """
SELECT peer_key, best_classical_bits, best_quantum_bits, best_transforms, best_observation_id, observations, first_seen_us FROM v_base""")
def _(spark, d):
    return FT.baselines(obs(spark, d)).select(
        "peer_key", "best_classical_bits", "best_quantum_bits", joined("best_transforms").alias("best_transforms"),
        "best_observation_id", "observations", "first_seen_us")


@query("base_new_peer_cap", """
SELECT capture, peer_key, pos, pos > 5 AS withheld FROM (SELECT capture, peer_key, row_number() OVER (PARTITION BY capture ORDER BY observed_us, id) AS pos FROM v_obs WHERE rn = 1)""")
def _(spark, d):
    o = obs(spark, d)
    opened = FT.thresholds(o, 1).groupBy("peer_key").agg(F.min("due").alias("at"))
    return FT.new_peers(o.join(opened, ["peer_key", "at"], "left_semi"), None, 5).select("capture", "peer_key", "pos", "withheld")


@query("fleet_view", "SELECT * FROM v_fleet")
def _(spark, d):
    o = obs(spark, d)
    return FT.fleet(o, FT.baselines(o)).withColumn("current_transforms", joined("current_transforms"))


@query("fleet_summary", """
SELECT count(*) AS links, sum(observations)::BIGINT AS observations, sum(degraded::INT)::BIGINT AS degraded, sum((current_bits < 112)::INT)::BIGINT AS below_112_bits,
  sum((current_quantum >= 128)::INT)::BIGINT AS quantum_safe, sum((current_quantum < 128)::INT)::BIGINT AS quantum_exposed, min(current_bits) AS weakest_bits FROM v_fleet""")
def _(spark, d):
    o = obs(spark, d)
    return FT.fleet_summary(FT.fleet(o, FT.baselines(o)))


@query("fleet_sort", "SELECT peer_key, current_bits, row_number() OVER (ORDER BY current_bits, peer_key) AS pos FROM v_fleet")
def _(spark, d):
    o = obs(spark, d)
    f = FT.fleet(o, FT.baselines(o)).withColumn("all", F.lit(1))
    return PO.positioned_by_range(f, ["all"], [F.asc("current_bits"), F.asc("peer_key")], fresh(spark, "fleet-sort")).select(
        "peer_key", "current_bits", "pos")


NOW_US = 1_000_000_000_000_000  # 2001-09-09


@query("base_retention", f"""
SELECT o.id, o.peer_key, o.observed_us FROM v_obs o JOIN v_base b ON b.peer_key = o.peer_key WHERE (o.observed_us >= {NOW_US} - 900 * 86400000000 AND b.observations - o.rn < 3)
  OR o.id = b.best_observation_id OR o.rn = b.observations OR o.capture = (SELECT arg_max(capture, (observed_us, capture)) FROM v_obs)""")
def _(spark, d):
    o = obs(spark, d)
    return FT.prune(o, FT.baselines(o), NOW_US, keep=3, days=900).select("id", "peer_key", "observed_us")


@query("retention_keep", f"""
SELECT o.peer_key, count(*) AS removed FROM v_obs o JOIN v_base b ON b.peer_key = o.peer_key WHERE NOT ((o.observed_us >= {NOW_US} - 900 * 86400000000 AND b.observations - o.rn < 3)
  OR o.id = b.best_observation_id OR o.rn = b.observations OR o.capture = (SELECT arg_max(capture, (observed_us, capture)) FROM v_obs)) GROUP BY o.peer_key""")
def _(spark, d):
    o = obs(spark, d)
    kept = FT.prune(o, FT.baselines(o), NOW_US, keep=3, days=900)
    return o.join(kept.select("capture", "id"), ["capture", "id"], "left_anti").groupBy("peer_key").agg(F.count(F.lit(1)).alias("removed"))


@query("base_history", "SELECT peer_key, id, n - rn + 1 AS pos, classical_bits FROM (SELECT *, max(rn) OVER (PARTITION BY peer_key) AS n FROM v_obs) WHERE n - rn < 50")
def _(spark, d):
    return FT.history(obs(spark, d)).select("peer_key", "id", "pos", "classical_bits")


@query("base_replay", """
SELECT peer_key, id, rn - greatest(n - 4, 0) AS pos, n > 4 AS truncated, verdict, classical_bits - base.bits AS delta_bits FROM (
 SELECT *, max(rn) OVER (PARTITION BY peer_key) AS n FROM v_verdict) WHERE n - rn < 4""")
def _(spark, d):
    o = obs(spark, d)
    return FT.replay(FT.verdicts(o), FT.baselines(o), limit=4).select("peer_key", "id", F.col("pos").cast("bigint").alias("pos"), "truncated", "verdict", "delta_bits")


@query("tx_diff", """
SELECT id, array_to_string(list_filter(string_split(base.t, ','), lambda x: NOT list_contains(string_split(transforms, ','), x)), ',') AS removed,
  array_to_string(list_filter(string_split(transforms, ','), lambda x: NOT list_contains(string_split(base.t, ','), x)), ',') AS added FROM v_verdict WHERE base IS NOT NULL""")
def _(spark, d):
    o = obs(spark, d)
    return FT.changes(FT.verdicts(o)).where("baseline_bits IS NOT NULL").select(
        "id", joined("removed").alias("removed"), joined("added").alias("added"))


@query("fn_peer_key", "SELECT DISTINCT peer_key FROM v_obs")
def _(spark, d):
    return obs(spark, d).select("peer_key").distinct()


FAIL_UNDER = 60


@query("st_alert", f"""
SELECT capture, CASE WHEN coalesce(downgrades, 0) > 0 THEN 3 WHEN score < {FAIL_UNDER} THEN 2 ELSE 0 END AS exit_code, coalesce(downgrades, 0) AS downgrades,
  coalesce(quantum_downgrades, 0) AS quantum_downgrades, score FROM (
 SELECT o.capture, sum((verdict = 'downgrade')::INT)::BIGINT AS downgrades, sum((verdict = 'downgrade-quantum')::INT)::BIGINT AS quantum_downgrades FROM v_verdict o GROUP BY o.capture)
FULL JOIN (SELECT capture, score FROM v_posture) USING (capture)""")
def _(spark, d):
    """Exit codes of captures: 3 on a downgrade, 2 below the required score."""
    from ..operators.posture import posture
    from ..streaming.monitor import alerts
    from .session_queries import captures

    o = obs(spark, d)
    scores = posture(captures(spark, d), findings(spark, d)).select("capture", "score")
    return alerts(FT.verdicts(o), scores, FAIL_UNDER)


# --- exposure --------------------------------------------------------------------
def exposed(spark, d):
    return staged(spark, d, "exposure", lambda: EX.exposure(ST.attribute_volume(strong(spark, d), flow_volumes(spark, d))))


@query("pq_exposure", "SELECT capture, sid, subject, classical_bits, quantum_bits, kex_family, quantum_safe, observed_bytes, harvest_rate_mbps, exposure_index, why FROM v_exposure")
def _(spark, d):
    return exposed(spark, d).select("capture", "sid", "subject", "classical_bits", "quantum_bits", "kex_family", "quantum_safe",
                                    "observed_bytes", "harvest_rate_mbps", "exposure_index", "why")


@query("pq_priority", "SELECT capture, sid, row_number() OVER (PARTITION BY capture ORDER BY exposure_index DESC, classical_bits, sid) AS priority FROM v_exposure")
def _(spark, d):
    return EX.prioritised(exposed(spark, d)).select("capture", "sid", "priority")


@query("pq_summary", """
SELECT capture, count(*) AS links_assessed, sum((NOT quantum_safe)::INT)::BIGINT AS quantum_exposed, sum(quantum_safe::INT)::BIGINT AS quantum_safe,
  sum(CASE WHEN quantum_safe THEN 0 ELSE observed_bytes END)::BIGINT AS bytes_harvestable, round(sum(CASE WHEN quantum_safe THEN 0e0 ELSE harvest_rate_mbps END), 2) AS harvest_rate_mbps
FROM v_exposure GROUP BY capture""")
def _(spark, d):
    return EX.summary(exposed(spark, d))


@query("pq_phases", """
SELECT capture, CASE WHEN classical_bits < 112 THEN 1 WHEN kex_quantum_bits >= 128 THEN 4 WHEN classical_bits < 128 THEN 2 ELSE 3 END AS phase,
  count(*) AS sessions, count(DISTINCT subject) AS links, sum(observed_bytes)::BIGINT AS bytes FROM v_exposure WHERE NOT quantum_safe GROUP BY 1, 2""")
def _(spark, d):
    return EX.phases(exposed(spark, d))


@query("harvest_clock", """
SELECT capture, round(b + r * 1e6 / 8 * (k * 1000 / 1000e0), 3) AS harvested_bytes FROM (
 SELECT capture, sum(CASE WHEN quantum_safe THEN 0 ELSE observed_bytes END)::DOUBLE AS b, round(sum(CASE WHEN quantum_safe THEN 0e0 ELSE harvest_rate_mbps END), 2) AS r, count(*) AS k FROM v_exposure GROUP BY capture)""")
def _(spark, d):
    s = EX.summary(exposed(spark, d))
    return s.select("capture", F.round(EX.harvested(F.col("bytes_harvestable"), F.col("harvest_rate_mbps"), F.col("links_assessed") * 1000), 3).alias("harvested_bytes"))


@query("fn_mosca", """
SELECT o_orderkey, round(s + m - q, 6) AS gap, CASE WHEN round(abs(s + m - q) * 12)::INT = 0 THEN 'under 1 month' ELSE printf('%d yr %02d mo', round(abs(s + m - q) * 12)::INT // 12, round(abs(s + m - q) * 12)::INT % 12) END AS deadline
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 3e0 WHEN 1 THEN 10e0 WHEN 2 THEN 25e0 ELSE 50e0 END AS s, (o_orderkey % 9) / 2e0 AS m, 8e0 + o_orderkey % 20 AS q FROM orders)""")
def _(spark, d):
    o = A.table(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 3D WHEN 1 THEN 10D WHEN 2 THEN 25D ELSE 50D END AS s",
        "(o_orderkey % 9) / 2D AS m", "8D + o_orderkey % 20 AS q")
    gap = EX.mosca_gap(F.col("s"), F.col("m"), F.col("q"))
    return o.select("o_orderkey", F.round(gap, 6).alias("gap"), EX.deadline(gap).alias("deadline"))


# --- inventory ---------------------------------------------------------------------
@query("inv_protocols", """
SELECT s.capture, 'crypto:' || substr(sha256('proto|' || s.peer || '|' || s.version), 1, 16) AS bom_ref, CASE WHEN s.v1 THEN '1.0' ELSE '2.0' END AS protocol_version,
  f.vendor_family, s.classical_bits, s.quantum_bits, s.confirmed, CASE WHEN s.parts > 1 THEN s.kex_names END AS hybrid_names FROM v_str s JOIN v_family f ON f.sid = s.sid""")
def _(spark, d):
    return IN.protocols(strong(spark, d)).select("capture", "bom_ref", "protocol_version", "vendor_family", "classical_bits", "quantum_bits", "confirmed", "hybrid_names")


@query("inv_algorithms", """
SELECT a.capture, 'crypto:' || substr(sha256('alg|' || a.label || '|' || a.subject), 1, 16) AS bom_ref, a.label AS name, a.x.tn AS transform_type,
  CASE WHEN a.x.t >= 4 THEN CASE WHEN d.family = 'ml-kem' THEN 'kem' ELSE 'key-agree' END WHEN a.x.t = 1 THEN 'block-cipher' WHEN a.x.t = 2 THEN 'prf' ELSE 'mac' END AS primitive,
  CASE WHEN a.x.f IN ('cisco', 'juniper', 'fortinet') THEN 'hardware' ELSE 'software' END AS environment,
  CASE WHEN a.x.t >= 4 THEN CASE WHEN d.qbits >= 256 THEN 5 WHEN d.qbits >= 192 THEN 3 WHEN d.qbits >= 128 THEN 1 ELSE 0 END END AS nist_level
FROM v_algs a LEFT JOIN d_dh d ON d.gid = a.x.v AND a.x.t >= 4""")
def _(spark, d):
    return IN.algorithms(strong(spark, d)).select("capture", "bom_ref", "name", "transform_type", "primitive", "environment", "nist_level")


@query("inv_in_use", "SELECT capture, sid, count(*) AS used FROM v_neg WHERE NOT (type_id >= 6 AND value_id = 0) GROUP BY capture, sid")
def _(spark, d):
    return IN.in_use(S.exploded(sess(spark, d))).groupBy("capture", "sid").agg(F.count(F.lit(1)).alias("used"))


@query("inv_esp", """
SELECT t.capture, 'crypto:' || substr(sha256('esp|' || t.flow), 1, 16) AS bom_ref, t.flow, t.class, c.signature, t.packets, 'inferred' AS provenance FROM v_top t JOIN d_class c ON c.class = t.class""")
def _(spark, d):
    return IN.esp_assets(flow_classes(spark, d)).select("capture", "bom_ref", "flow", "class", "signature", "packets", "provenance")


@query("inv_vulns", """
SELECT capture, 'crypto:' || substr(sha256('vuln|' || rule_id || '|' || subject), 1, 16) AS bom_ref, rule_id AS id, severity, title AS description,
  CASE WHEN inferred THEN 'inferred' ELSE 'observed' END AS provenance FROM v_findings WHERE severity IN ('critical', 'high')""")
def _(spark, d):
    return IN.vulnerabilities(findings(spark, d))


@query("sev_filter", "SELECT rule_id, severity, count(*) AS findings FROM v_findings WHERE severity IN ('critical', 'high') GROUP BY ALL")
def _(spark, d):
    return findings(spark, d).where(F.col("severity").isin("critical", "high")).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query("inv_counts", """
SELECT capture, sum(n)::BIGINT AS observed, sum(i)::BIGINT AS inferred FROM (SELECT capture, 1 AS n, 0 AS i FROM v_str UNION ALL SELECT capture, 1, 0 FROM v_algs UNION ALL SELECT capture, 0, 1 FROM v_top) GROUP BY capture""")
def _(spark, d):
    s = strong(spark, d)
    return IN.asset_counts(IN.protocols(s), IN.algorithms(s), IN.esp_assets(flow_classes(spark, d)))


@query("inv_search", """
SELECT capture, label AS name, subject FROM v_algs WHERE contains(lower(label), 'sha1')""")
def _(spark, d):
    return IN.search(IN.algorithms(strong(spark, d)).select("capture", "name", "subject"), "SHA1")


@query("fn_oid", """
SELECT a.label AS name, max(CASE a.label WHEN 'ENCR_3DES' THEN '1.2.840.113549.3.7' WHEN 'ENCR_DES' THEN '1.3.14.3.2.7' WHEN 'PRF_HMAC_SHA2_256' THEN '1.2.840.113549.2.9'
 WHEN 'PRF_HMAC_SHA1' THEN '1.2.840.113549.2.7' WHEN 'AUTH_HMAC_SHA2_256_128' THEN '1.2.840.113549.2.9' WHEN 'AUTH_HMAC_SHA1_96' THEN '1.2.840.113549.2.7' WHEN 'AUTH_HMAC_MD5_96' THEN '1.2.840.113549.2.6' END) AS oid,
 count(*) AS assets FROM v_algs a GROUP BY a.label""")
def _(spark, d):
    return IN.algorithms(strong(spark, d)).groupBy("name").agg(F.max("oid").alias("oid"), F.count(F.lit(1)).alias("assets"))


@query("fn_nist_level", "SELECT capture, sid, CASE WHEN kex_quantum_bits >= 256 THEN 5 WHEN kex_quantum_bits >= 192 THEN 3 WHEN kex_quantum_bits >= 128 THEN 1 ELSE 0 END AS level FROM v_str")
def _(spark, d):
    return strong(spark, d).select("capture", "sid", EX.nist_level(F.col("kex_quantum_bits")).alias("level"))


@query("fn_bom_ref", "SELECT capture, 'crypto:' || substr(sha256('capture|' || capture), 1, 16) AS bom_ref FROM v_captures")
def _(spark, d):
    from .session_queries import captures

    return captures(spark, d).select("capture", IN.bom_ref("capture", F.col("capture")).alias("bom_ref"))


# --- comparison -----------------------------------------------------------------------
def paired(df):
    n = F.substring("capture", 9, 2).cast("int")
    return df.withColumn("pair", F.concat(F.substring("capture", 1, 8), F.floor(n / 2))).withColumn("is_a", n % 2 == 0)


def split(df):
    p = paired(df)
    return p.where("is_a"), p.where("NOT is_a")


COMPARE = """
SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.link, b.link) AS link, b.classical_bits - a.classical_bits AS classical_change, b.quantum_bits - a.quantum_bits AS quantum_change,
 CASE WHEN a.link IS NULL THEN 'only-b' WHEN b.link IS NULL THEN 'only-a' WHEN b.classical_bits > a.classical_bits THEN 'stronger' WHEN b.classical_bits < a.classical_bits THEN 'weaker'
  WHEN b.quantum_bits > a.quantum_bits THEN 'stronger' WHEN b.quantum_bits < a.quantum_bits THEN 'weaker' WHEN a.worst_severity IS DISTINCT FROM b.worst_severity THEN 'severity' ELSE 'same' END AS kind
FROM (SELECT p.pair, l.* FROM v_link_view l JOIN v_pairs p ON p.capture = l.capture WHERE p.is_a) a
FULL JOIN (SELECT p.pair, l.* FROM v_link_view l JOIN v_pairs p ON p.capture = l.capture WHERE NOT p.is_a) b ON a.pair = b.pair AND a.link = b.link"""


@query("cap_compare", COMPARE)
def _(spark, d):
    return CO.compare_links(*split(link_rows(spark, d)))


@query("compare_sort", f"SELECT pair, link, kind, row_number() OVER (PARTITION BY pair ORDER BY kind = 'same', link) AS pos FROM ({COMPARE})")
def _(spark, d):
    c = CO.compare_links(*split(link_rows(spark, d))).withColumn("same", F.col("kind") == "same")
    return PO.positioned_by_range(c, ["pair"], [F.asc("same"), F.asc("link")], fresh(spark, "compare-sort")).select("pair", "link", "kind", "pos")


FINDING_COMPARE = """
SELECT f.pair, f.rule_id, f.title, f.severity, f.subject, CASE WHEN f.is_a THEN 'resolved' WHEN f.known THEN 'persisting' ELSE 'new' END AS state FROM (
 SELECT x.*, EXISTS (SELECT 1 FROM v_pf y WHERE y.pair = x.pair AND y.is_a <> x.is_a AND y.rule_id = x.rule_id)
   OR EXISTS (SELECT 1 FROM v_pf y WHERE y.pair = x.pair AND y.is_a <> x.is_a AND y.title = x.title) AS known FROM v_pf x) f WHERE NOT (f.is_a AND f.known)"""


@query("cap_compare_findings", "WITH v_pf AS (SELECT p.pair, p.is_a, f.* FROM v_findings f JOIN v_pairs p ON p.capture = f.capture)" + FINDING_COMPARE)
def _(spark, d):
    return CO.compare_findings(*split(findings(spark, d)))


@query("cap_findings_intersect", """
SELECT p.pair, f.rule_id FROM v_findings f JOIN v_pairs p ON p.capture = f.capture WHERE p.is_a INTERSECT SELECT p.pair, f.rule_id FROM v_findings f JOIN v_pairs p ON p.capture = f.capture WHERE NOT p.is_a""")
def _(spark, d):
    a, b = split(findings(spark, d).select("capture", "rule_id"))
    return a.select("pair", "rule_id").intersect(b.select("pair", "rule_id"))


@query("fn_suite_info", "SELECT capture, version, cipher, prf, dh_group, dh_id, esp, exposed FROM v_suite_info")
def _(spark, d):
    return CO.suite_info(strong(spark, d), flow_classes(spark, d), exposed(spark, d)).select("capture", "version", "cipher", "prf", "dh_group", "dh_id", "esp", "exposed")


@query("cap_compare_suite", """
SELECT pair, parameter, status FROM (SELECT a.pair, unnest(['IKE version', 'IKE cipher', 'Integrity and PRF', 'Diffie-Hellman group', 'ESP suite', 'Quantum-exposed links']) AS parameter,
 unnest([CASE WHEN a.version = b.version THEN 'Same' WHEN a.version = 'IKEv1' THEN 'Improved' ELSE 'Worse' END,
  CASE WHEN a.cipher = b.cipher THEN 'Same' WHEN wa AND NOT wb THEN 'Improved' WHEN wb AND NOT wa THEN 'Worse' ELSE 'Changed' END,
  CASE WHEN a.prf = b.prf THEN 'Same' WHEN ha AND NOT hb THEN 'Improved' WHEN hb AND NOT ha THEN 'Worse' ELSE 'Changed' END,
  CASE WHEN a.dh_group = b.dh_group THEN 'Same' WHEN ga AND NOT gb THEN 'Improved' WHEN gb AND NOT ga THEN 'Worse' ELSE 'Changed' END,
  CASE WHEN a.esp = b.esp THEN 'Same' WHEN ea AND NOT eb THEN 'Improved' WHEN eb AND NOT ea THEN 'Worse' ELSE 'Changed' END,
  CASE WHEN a.exposed = b.exposed THEN 'Same' WHEN b.exposed < a.exposed THEN 'Fewer' ELSE 'More' END]) AS status
 FROM (SELECT *, cipher LIKE '%DES%' AS wa, prf LIKE '%MD5%' OR prf LIKE '%SHA1%' AS ha, dh_id IN (1, 2, 5, 22, 25) AS ga, esp LIKE '%64-bit%' OR esp LIKE 'unencrypted%' AS ea FROM v_suite_info WHERE is_a) a
 JOIN (SELECT *, cipher LIKE '%DES%' AS wb, prf LIKE '%MD5%' OR prf LIKE '%SHA1%' AS hb, dh_id IN (1, 2, 5, 22, 25) AS gb, esp LIKE '%64-bit%' OR esp LIKE 'unencrypted%' AS eb FROM v_suite_info WHERE NOT is_a) b ON a.pair = b.pair)""")
def _(spark, d):
    return CO.compare_suites(*split(CO.suite_info(strong(spark, d), flow_classes(spark, d), exposed(spark, d)))).select("pair", "parameter", "status")


@query("fn_alg_badge", """
SELECT type_id, value_id, name, any_value(CASE WHEN type_id >= 4 THEN CASE WHEN value_id = 0 THEN '' WHEN value_id IN (1, 2, 22, 25) THEN 'bad' WHEN value_id IN (5, 26) THEN 'warn' ELSE 'good' END
  WHEN name LIKE '%DES%' OR name LIKE '%MD5%' THEN 'bad' WHEN name LIKE '%SHA1%' THEN 'warn' WHEN name LIKE '%GCM%' OR name LIKE '%CHACHA%' OR name LIKE '%SHA2%' THEN 'good' ELSE '' END) AS badge,
  count(*) AS uses FROM v_neg GROUP BY type_id, value_id, name""")
def _(spark, d):
    t = S.exploded(sess(spark, d)).groupBy("type_id", "value_id", "name").agg(F.count(F.lit(1)).alias("uses"))
    return t.withColumn("badge", CO.alg_badge(F.col("type_id"), F.col("value_id"), F.col("name")))


@query("fn_suite_badge", """
SELECT flow, CASE class WHEN '64-bit block cipher' THEN 'bad' WHEN 'unencrypted payload' THEN 'bad' WHEN 'AEAD or counter mode' THEN 'good' ELSE 'warn' END AS badge FROM v_top""")
def _(spark, d):
    return flow_classes(spark, d).select("flow", CO.suite_badge(F.col("class")).alias("badge"))
