"""Registered queries: sessions, strength, rules, findings, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A, registries as R
from ..operators import flows as FL, posture as PO, rules as RU, sessions as S, strength as ST
from .catalog import query
from .ctes import EVIDENCE_NUMBERS, RULE_SQL
from .stage import fresh, small_tasks, staged


def messages(spark, d):
    """Rows of the orders, made anew by arithmetic: each reader makes the few columns it asks for, which is less than writing and reading all."""
    return A.ike_messages(spark, d)


def sess(spark, d):
    return S.sessions(messages(spark, d))


def strong(spark, d):
    return staged(spark, d, "sessions", lambda: ST.session_strength(sess(spark, d)))


def flow_volumes(spark, d):
    return staged(spark, d, "flows", lambda: FL.esp_flows(A.esp_packets(spark, d)))


def kept(spark, d):
    """Writes a table of the given name once and reads it back."""
    return lambda name, df: staged(spark, d, name, lambda: df)


def findings(spark, d, **kw):
    from .flow_queries import flow_classes

    def build():
        packets = A.esp_packets_seq(spark, d)
        return RU.audit(messages(spark, d), flow_volumes(spark, d), flow_classes(spark, d), FL.sequence_gaps(packets), strong=strong(spark, d), keep=kept(spark, d), **kw)

    return build() if kw else staged(spark, d, "findings", build)


# --- sessions -------------------------------------------------------------------
@query("ike_sessions", """
SELECT s.capture, s.sid, any_value(m.version) AS version, s.a AS peer_a, s.b AS peer_b,
  coalesce(max(CASE WHEN slot IN (2, 4, 5) THEN responder_spi END), repeat('0', 16)) AS responder_spi, count(*) AS messages,
  any_value(s.confirmed) AS confirmed, any_value(f.vendor_family) AS vendor_family,
  max(CASE WHEN s.k % 29 = 0 THEN 1 ELSE 0 END)::BIGINT AS parse_errors
FROM v_sa s JOIN v_msg m ON m.sid = s.sid JOIN v_family f ON f.sid = s.sid GROUP BY s.capture, s.sid, s.a, s.b""")
def _(spark, d):
    return sess(spark, d).select("capture", "sid", "version", "peer_a", "peer_b", "responder_spi", "messages", "confirmed",
                                 "vendor_family", "parse_errors")


@query("sa_retransmissions", """
SELECT capture, sid, count(*) - count(DISTINCT (message_id, is_response, exchange)) AS retransmissions FROM v_msg GROUP BY capture, sid""")
def _(spark, d):
    return sess(spark, d).select("capture", "sid", "retransmissions")


@query("sa_exchanges", """
SELECT capture, sid, count(DISTINCT CASE WHEN exchange = 'IKE_INTERMEDIATE' THEN message_id END) AS intermediate_exchanges,
  count(DISTINCT CASE WHEN exchange = 'IKE_FOLLOWUP_KE' THEN message_id END) AS followup_exchanges FROM v_msg GROUP BY capture, sid""")
def _(spark, d):
    return sess(spark, d).select("capture", "sid", "intermediate_exchanges", "followup_exchanges")


@query("sa_confirmed", "SELECT capture, count(*) AS sessions, sum(confirmed::INT)::BIGINT AS confirmed FROM v_sa GROUP BY capture")
def _(spark, d):
    return sess(spark, d).groupBy("capture").agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.col("confirmed").cast("bigint")).alias("confirmed"))


@query("sa_lists", """
SELECT capture, sid, kind, value, row_number() OVER (PARTITION BY sid, kind ORDER BY frame, ord) AS pos FROM (
 SELECT capture, sid, 'vendor_id' AS kind, vendor AS value, min(frame) AS frame, min(ord) AS ord FROM v_vendor GROUP BY ALL
 UNION ALL SELECT capture, sid, 'notify', notify, min(frame), min(ord) FROM v_notify GROUP BY capture, sid, notify)""")
def _(spark, d):
    return S.session_lists(messages(spark, d))


@query("sa_key_exchange", """
SELECT s.capture, s.sid, s.confirmed, max(CASE WHEN s.confirmed AND n.type_id = 4 AND n.ord < 10 THEN n.name END) AS method,
  CASE WHEN s.confirmed THEN coalesce(string_agg(CASE WHEN n.type_id >= 6 AND n.value_id <> 0 THEN n.name END, ',' ORDER BY n.ord), '') END AS additional,
  s.confirmed AND count(CASE WHEN n.type_id >= 6 AND n.value_id <> 0 THEN 1 END) > 0 AS hybrid
FROM v_sa s JOIN v_neg n ON n.sid = s.sid GROUP BY s.capture, s.sid, s.confirmed""")
def _(spark, d):
    return S.key_exchange(sess(spark, d)).select("capture", "sid", "confirmed", "method", "additional", "hybrid")


@query("fn_kex_label", """
SELECT s.capture, s.sid, coalesce(string_agg(CASE WHEN n.type_id = 4 OR (n.type_id >= 6 AND n.value_id <> 0) THEN n.name END, ' + ' ORDER BY n.ord), '') AS kex_label
FROM v_sa s JOIN v_neg n ON n.sid = s.sid WHERE s.confirmed GROUP BY s.capture, s.sid""")
def _(spark, d):
    return S.key_exchange(sess(spark, d)).where("confirmed").select("capture", "sid", "kex_label")


@query("fn_label", "SELECT capture, sid, ord, label FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ord) - 1 AS o FROM v_neg) n".replace("ord, label", "o AS ord, label"))
def _(spark, d):
    return S.exploded(sess(spark, d)).select("capture", "sid", F.col("ord").cast("bigint").alias("ord"), "label")


@query("reg_lookup", """
SELECT n.type_id, n.name, n.value_id, any_value(coalesce(p.verdict, '')) AS verdict,
  any_value(CASE WHEN n.type_id = 4 OR n.type_id >= 6 THEN coalesce(d.cbits, 112) WHEN n.type_id = 1 THEN coalesce(e.bits, 128)
   WHEN n.type_id = 2 THEN coalesce(r.bits, 128) ELSE coalesce(i.bits, 128) END) AS bits, count(*) AS uses
FROM v_neg n LEFT JOIN d_dh d ON d.gid = n.value_id AND (n.type_id = 4 OR n.type_id >= 6) LEFT JOIN d_encr e ON e.name = n.name LEFT JOIN d_prf r ON r.name = n.name LEFT JOIN d_integ i ON i.name = n.name
LEFT JOIN d_policy p ON (p.kind = 'ENCR' AND n.type_id = 1 AND p.name = n.name) OR (p.kind = 'PRF' AND n.type_id = 2 AND p.name = n.name) OR (p.kind = 'INTEG' AND n.type_id = 3 AND p.name = n.name)
  OR (p.kind = 'DH' AND n.type_id = 4 AND p.name = n.value_id::VARCHAR) GROUP BY n.type_id, n.name, n.value_id""")
def _(spark, d):
    t = S.exploded(sess(spark, d)).groupBy("type_id", "name", "value_id").agg(F.count(F.lit(1)).alias("uses"))
    return S.looked_up(t).select("type_id", "name", "value_id", "verdict", "bits", "uses")


# --- strength --------------------------------------------------------------------
@query("strength_fold", "SELECT capture, sid, classical_bits, quantum_bits, block_bits, enc AS enc_bits, prf AS prf_bits, integ AS integ_bits FROM v_str")
def _(spark, d):
    return strong(spark, d).select("capture", "sid", "classical_bits", "quantum_bits", "block_bits", "enc_bits", "prf_bits", "integ_bits")


@query("kex_hybrid", "SELECT capture, sid, kex_bits, kex_quantum_bits, kex_family, kex_names, parts > 1 AS hybrid FROM v_str")
def _(spark, d):
    return strong(spark, d).select("capture", "sid", "kex_bits", "kex_quantum_bits", "kex_family", "kex_names", "hybrid")


@query("offer_credit", "SELECT confirmed, count(*) AS sessions, sum((raw_kex_q > kex_quantum_bits)::INT)::BIGINT AS uncredited, sum((quantum_bits >= 128)::INT)::BIGINT AS quantum_safe FROM v_str GROUP BY confirmed")
def _(spark, d):
    return strong(spark, d).groupBy("confirmed").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(F.col("uncredited").cast("bigint")).alias("uncredited"),
        F.sum(F.col("quantum_safe").cast("bigint")).alias("quantum_safe"))


@query("fn_grade_bits", """
SELECT capture, sid, CASE WHEN classical_bits >= 192 THEN 'excellent' WHEN classical_bits >= 128 THEN 'adequate' WHEN classical_bits >= 112 THEN 'minimum'
 WHEN classical_bits >= 80 THEN 'deprecated' ELSE 'broken' END AS grade FROM v_str""")
def _(spark, d):
    return strong(spark, d).select("capture", "sid", "grade")


@query("vol_attribution", "SELECT capture, sid, observed_bytes, round(observed_seconds, 6) AS observed_seconds FROM v_volume")
def _(spark, d):
    return ST.attribute_volume(sess(spark, d), flow_volumes(spark, d)).select(
        "capture", "sid", "observed_bytes", F.round("observed_seconds", 6).alias("observed_seconds"))


@query("sweet32", """
SELECT capture, sid, round(lim / 1e9, 1) AS threshold_gb, round(rate * 8 / 1e6, 2) AS rate_mbps, round(rate * rekey / 1e9, 2) AS per_rekey_gb,
  ratio, seconds_to_limit, exceeds FROM v_sweet""")
def _(spark, d):
    s = ST.attribute_volume(strong(spark, d), flow_volumes(spark, d))
    s = ST.sweet32(s.withColumn("rekey_seconds", F.coalesce("lifetime", F.lit(86400)))).where(F.col("exceeds").isNotNull())
    return s.select("capture", "sid", "threshold_gb", "rate_mbps", "per_rekey_gb", "ratio", "seconds_to_limit", "exceeds")


# --- rules -----------------------------------------------------------------------
def _rule(rule_id):
    name = "r_" + rule_id.lower().replace("-", "_")

    @query(name, f"SELECT capture, subject, title, severity FROM ({RULE_SQL[rule_id]})")
    def run(spark, d):
        if rule_id.startswith("ESP"):
            from .flow_queries import flow_classes

            gaps = FL.sequence_gaps(A.esp_packets_seq(spark, d))
            out = RU.audit(None, None, flow_classes(spark, d), gaps, only=[rule_id])
        else:
            flows = flow_volumes(spark, d) if rule_id == "IKE-013" else None
            out = RU.audit(messages(spark, d), flows, only=[rule_id], strong=strong(spark, d), keep=kept(spark, d))
        return out.select("capture", "subject", "title", "severity")


for _id in RULE_SQL:
    _rule(_id)


@query("ke_reuse", """
SELECT capture, src AS sender, ke_digest, count(DISTINCT sid) AS sas FROM v_msg WHERE ke_digest IS NOT NULL GROUP BY capture, src, ke_digest HAVING count(DISTINCT sid) >= 2""")
def _(spark, d):
    reused = RU.reused_values(RU.carried_values(messages(spark, d))).where("kind = 'ke'")
    return reused.select("capture", F.col("who").alias("sender"), F.col("digest").alias("ke_digest"), "sas")


@query("nonce_reuse", """
SELECT capture, nonce_digest, count(DISTINCT sid) AS sas, count(DISTINCT src) AS senders FROM v_msg WHERE nonce_digest IS NOT NULL GROUP BY capture, nonce_digest HAVING count(DISTINCT sid) >= 2""")
def _(spark, d):
    reused = RU.reused_values(RU.carried_values(messages(spark, d))).where("kind = 'nonce'")
    return reused.select("capture", F.col("digest").alias("nonce_digest"), "sas", "senders")


@query("weak_residual", """
SELECT DISTINCT o.capture, o.sid, o.name FROM v_offer o JOIN d_policy p ON p.verdict = 'prohibited' AND ((p.kind = 'ENCR' AND o.type_id = 1) OR (p.kind = 'INTEG' AND o.type_id = 3)) AND p.name = o.name
WHERE NOT EXISTS (SELECT 1 FROM v_neg n WHERE n.sid = o.sid AND n.name = o.name)""")
def _(spark, d):
    return S.weak_residual(messages(spark, d))


@query("first_per_link", """
SELECT capture, pa || '~' || pb AS link, arg_min(sid, k) AS sid, count(*) AS sessions FROM v_sa GROUP BY capture, pa, pb""")
def _(spark, d):
    from ..functions.net import link_id

    return sess(spark, d).groupBy("capture", link_id(F.col("peer_a"), F.col("peer_b")).alias("link")).agg(
        F.min_by("sid", "sid").alias("sid"), F.count(F.lit(1)).alias("sessions"))


@query("first_value_msg", """
SELECT capture, sid, max(lifetime_seconds) AS lifetime, max(CASE WHEN auth_method = 'PRE_SHARED_KEY' THEN auth_method END) AS weak_auth,
  max(CASE WHEN lifetime_seconds > 86400 THEN lifetime_seconds END) AS long_life FROM v_msg GROUP BY capture, sid""")
def _(spark, d):
    return sess(spark, d).select("capture", "sid", "lifetime", "weak_auth", "long_life")


# --- findings ---------------------------------------------------------------------
@query("rule_union", "SELECT capture, rule_id, title, severity, subject, inferred FROM v_findings")
def _(spark, d):
    return findings(spark, d).select("capture", "rule_id", "title", "severity", "subject", "inferred")


@query("rule_switch", "SELECT rule_id, count(*) AS findings FROM v_findings WHERE rule_id NOT IN ('IKE-007', 'IKE-011', 'ESP-004') GROUP BY rule_id")
def _(spark, d):
    return findings(spark, d, disabled=["IKE-007", "IKE-011", "ESP-004"]).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))


@query("rule_catalogue", """
SELECT rule_id, CASE WHEN rule_id LIKE 'ESP%' THEN 'esp' ELSE 'ike' END AS scope,
  CASE WHEN rule_id LIKE 'ESP%' THEN 'flow' WHEN rule_id IN ('IKE-015', 'IKE-016') THEN 'capture' ELSE 'session' END AS per,
  count(*) AS findings, count(DISTINCT capture) AS captures FROM v_findings GROUP BY rule_id""")
def _(spark, d):
    dim = spark.createDataFrame([(r, s, p) for r, (s, p, _t) in R.RULES.items()], "rule_id string, scope string, per string")
    seen = findings(spark, d).groupBy("rule_id", "capture").agg(F.count(F.lit(1)).alias("n"))
    seen = seen.groupBy("rule_id").agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("captures"))
    return seen.join(F.broadcast(dim), "rule_id").select("rule_id", "scope", "per", "findings", "captures")


def _why_rows() -> str:
    return ", ".join("('%s', '%s')" % (r, text.replace("'", "''")) for r, text in RU.reasons().items())


@query("fn_why", f"""
SELECT f.rule_id, count(*) AS findings, any_value(why) AS why FROM v_findings f JOIN (VALUES {_why_rows()}) w(rule_id, why) ON w.rule_id = f.rule_id GROUP BY f.rule_id""")
def _(spark, d):
    why = F.create_map(*[F.lit(x) for kv in RU.reasons().items() for x in kv])
    return findings(spark, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings")).withColumn("why", why[F.col("rule_id")])


@query("finding_evidence", "SELECT capture, rule_id, subject, field, said, number FROM v_evidence")
def _(spark, d):
    told = PO.evidence_fields(findings(spark, d))
    number = F.col("field").isin(*EVIDENCE_NUMBERS)
    return told.select("capture", "rule_id", "subject", "field", F.when(~number, F.col("value")).alias("said"), F.when(number, F.col("value").cast("double")).alias("number"))


@query("conf_floor", """
SELECT t.class, t.confidence >= 0.35e0 AS kept, count(*) AS flows FROM v_top t GROUP BY 1, 2""")
def _(spark, d):
    from .flow_queries import flow_classes

    return flow_classes(spark, d).groupBy("class", (F.round("confidence", 9) >= RU.CONFIDENCE_FLOOR).alias("kept")).agg(F.count(F.lit(1)).alias("flows"))


def captures(spark, d):
    return staged(spark, d, "captures", lambda: messages(spark, d).select("capture").union(A.esp_packets(spark, d).select("capture")).distinct())


@query("posture_score", "SELECT capture, critical, high, medium, low, info, score, grade FROM v_posture")
def _(spark, d):
    return PO.posture(captures(spark, d), findings(spark, d)).select("capture", *R.SEVERITY, "score", "grade")


@query("sev_counts", "SELECT capture, critical, high, medium, low, info FROM v_posture WHERE findings > 0")
def _(spark, d):
    return PO.severity_counts(findings(spark, d)).select("capture", *R.SEVERITY)


@query("report_digest", "SELECT capture, substr(sha256(string_agg(rule_id || ':' || subject, '|' ORDER BY rule_id || ':' || subject)), 1, 16) AS digest FROM v_findings GROUP BY capture")
def _(spark, d):
    return PO.report_digest(findings(spark, d))


@query("finding_groups", """
SELECT capture, rule_id, title, count(*) AS "count", min(rnk) AS rank, count(DISTINCT subject) AS subjects, bool_or(inferred) AS inferred, arg_min(severity, rnk) AS severity
FROM v_findings JOIN d_severity USING (severity) GROUP BY capture, rule_id, title""")
def _(spark, d):
    return PO.finding_groups(findings(spark, d))


@query("dedupe_subjects", "SELECT DISTINCT capture, rule_id || ':' || subject AS k FROM v_findings")
def _(spark, d):
    return findings(spark, d).select("capture", F.concat_ws(":", "rule_id", "subject").alias("k")).distinct()


@query("findings_sort", """
SELECT capture, rule_id, title, severity, subject, row_number() OVER (PARTITION BY capture ORDER BY rnk, rule_id, subject, title) AS pos FROM (
  SELECT DISTINCT capture, rule_id, title, severity, subject, rnk FROM v_findings JOIN d_severity USING (severity))""")
def _(spark, d):
    f = findings(spark, d).select("capture", "rule_id", "title", "severity", "subject").withColumn("rank", PO.rank_of(F.col("severity")))
    with small_tasks(spark, d):
        return PO.positioned_by_range(f, ["capture"], [F.asc("rank"), F.asc("rule_id"), F.asc("subject"), F.asc("title")], fresh(spark, "findings-sort"), distinct=True).drop("rank")


@query("groups_sort", """
SELECT capture, rule_id, title, "count", row_number() OVER (PARTITION BY capture ORDER BY rnk, "count" DESC, rule_id, title) AS pos FROM (
 SELECT capture, rule_id, title, count(*) AS "count", min(rnk) AS rnk FROM v_findings JOIN d_severity USING (severity) GROUP BY capture, rule_id, title)""")
def _(spark, d):
    g = PO.finding_groups(findings(spark, d))
    return PO.positioned(g, ["capture"], [F.asc("rank"), F.desc("count"), F.asc("rule_id"), F.asc("title")], [F.col("rank")]).select(
        "capture", "rule_id", "title", "count", "pos")


def link_rows(spark, d):
    return staged(spark, d, "links", lambda: PO.links(strong(spark, d), flow_volumes(spark, d), findings(spark, d)))


@query("link_build", "SELECT capture, link, sessions, tunnels, tunnels > 1 AS pooled FROM v_links")
def _(spark, d):
    return link_rows(spark, d).select("capture", "link", "sessions", "tunnels", "pooled")


@query("link_summary", "SELECT capture, link, findings, worst_severity, classical_bits, quantum_bits FROM v_link_view")
def _(spark, d):
    return link_rows(spark, d).select("capture", "link", "findings", "worst_severity", "classical_bits", "quantum_bits")


@query("link_findings", "SELECT capture, link, rule_id, severity, count(*) AS findings FROM v_flink GROUP BY ALL")
def _(spark, d):
    f = findings(spark, d).groupBy("capture", "subject", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    f = PO.with_link(f).where(F.col("link").isNotNull()).groupBy("capture", "link", "rule_id", "severity").agg(F.sum("n").alias("findings"))
    return f.join(link_rows(spark, d).select("capture", "link"), ["capture", "link"], "left_semi")


@query("groups_by_link", """
SELECT capture, link, rule_id, title, count(*) AS "count", arg_min(severity, rnk) AS severity FROM v_flink JOIN d_severity USING (severity) GROUP BY capture, link, rule_id, title""")
def _(spark, d):
    return PO.groups_of_link(findings(spark, d)).drop("rank")


@query("links_sort", """
SELECT capture, link, row_number() OVER (PARTITION BY capture ORDER BY coalesce(rnk, 5), -findings, coalesce(classical_bits, 10000),
  split_part(link, '.', 1)::INT, split_part(link, '.', 2)::INT, split_part(link, '.', 3)::INT, split_part(split_part(link, '~', 1), '.', 4)::INT, link) AS pos FROM v_link_view""")
def _(spark, d):
    from ..functions.bytes import address_key

    l = link_rows(spark, d).withColumn("rank", F.coalesce(PO.rank_of(F.col("worst_severity")), F.lit(5)))
    order = [F.asc("rank"), F.desc("findings"), F.coalesce("classical_bits", F.lit(10000)).asc(),
             address_key(F.split("link", "~")[0]).asc(), address_key(F.split("link", "~")[1]).asc()]
    return PO.positioned_by_range(l, ["capture"], order, fresh(spark, "links-sort")).select("capture", "link", "pos")


@query("fn_subject_pair", """
SELECT DISTINCT subject, split_part(link, '~', 1) AS first, split_part(link, '~', 2) AS second FROM v_flink""")
def _(spark, d):
    f = PO.with_link(findings(spark, d).select("subject").distinct())
    return f.select("subject", F.split("link", "~")[0].alias("first"), F.split("link", "~")[1].alias("second"))


@query("fn_pair_key", "SELECT DISTINCT pa, pb, pa || '|' || pb AS peer_key, pa || '~' || pb AS link FROM v_sa")
def _(spark, d):
    from ..functions.net import link_id, lower_peer, peer_key, upper_peer

    a, b = F.col("peer_a"), F.col("peer_b")
    return sess(spark, d).select(lower_peer(a, b).alias("pa"), upper_peer(a, b).alias("pb"), peer_key(a, b).alias("peer_key"), link_id(a, b).alias("link")).distinct()


@query("addr_sort", """
SELECT addr, row_number() OVER (ORDER BY kind, a, b, c, addr) AS pos FROM (SELECT DISTINCT 0 AS kind, '10.' || (user_id % 13) || '.' || (event_id % 256) || '.' || (event_id // 256 % 7) AS addr,
  user_id % 13 AS a, event_id % 256 AS b, event_id // 256 % 7 AS c FROM events
 UNION ALL SELECT DISTINCT 1, '2001:db8::' || lower(to_hex(1 + event_id % 500)), event_id % 500, 0, 0 FROM events UNION ALL SELECT DISTINCT 2, 'host-' || (user_id % 40), 0, 0, 0 FROM events)""")
def _(spark, d):
    from ..functions.bytes import address_chunk, address_key

    e = A.table(spark, d, "events").selectExpr(
        "inline(array(named_struct('addr', concat('10.', user_id % 13, '.', event_id % 256, '.', event_id div 256 % 7)),"
        " named_struct('addr', concat('2001:db8::', lower(hex(1 + event_id % 500)))), named_struct('addr', concat('host-', user_id % 40))))").distinct()
    e = e.withColumn("key", address_key(F.col("addr"))).withColumn("net", F.lit("all"))
    return PO.positioned(e, ["net"], [F.asc("key")], address_chunk(F.col("key"))).select("addr", "pos")


# --- decoding ---------------------------------------------------------------------
@query("ike_messages", """
SELECT s.sid AS initiator_spi, 'IKEv2' AS version, string_agg(o.type_name || ':' || o.value_id || ':' || o.name || CASE WHEN o.key_length > 0 THEN '-' || o.key_length ELSE '' END, ',' ORDER BY o.ord) AS transforms,
  max(CASE WHEN o.type_id = 4 AND o.ord < 10 THEN o.value_id END) AS ke_group, any_value(CASE WHEN s.k % 17 = 0 THEN 8 ELSE 32 END) AS nonce_len, 0 AS errors,
  any_value(sha256(unhex(repeat(lpad(to_hex(s.k % 256), 2, '0'), CASE WHEN s.k % 17 = 0 THEN 8 ELSE 32 END)))) AS nonce_digest
FROM v_sa s JOIN v_offer o ON o.sid = s.sid WHERE NOT s.v1 GROUP BY s.sid""")
def _(spark, d):
    from ..sources.ike import decode_ike

    m = decode_ike(A.ike_packets(spark, d))
    t = F.transform(F.get("proposals", F.lit(0))["transforms"], lambda t: F.concat_ws(
        ":", t["type_name"], t["value_id"], F.when(t["key_length"] > 0, F.concat_ws("-", t["name"], t["key_length"])).otherwise(t["name"])))
    return m.select("initiator_spi", "version", F.array_join(t, ",").alias("transforms"), "ke_group", "nonce_len",
                    F.size("parse_errors").alias("errors"), "nonce_digest")
