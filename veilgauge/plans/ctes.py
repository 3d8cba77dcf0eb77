"""DuckDB building blocks: the adapters and shared tables, restated in SQL."""

from __future__ import annotations

from .. import registries as R
from ..adapters import EXTRA_PQ, EXTRA_WEAK, HANDSHAKE_SUITES, transform_rows
from .catalog import cte


def _v(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, (int, float)):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


def values(rows, cols: str) -> str:
    body = ", ".join("(" + ", ".join(_v(c) for c in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({cols})"


# --- fixed dimensions ------------------------------------------------------------
cte("d_severity", values([(k, w, r) for k, (w, r) in R.SEVERITY.items()], "severity, weight, rnk"))
cte("d_suite", values(
    [(s, o, b, i, c, max(b, 4), (i + c) % max(b, 4), R.CLASS_OF_SUITE[s]) for o, (s, (b, i, c)) in enumerate(R.SUITES.items())],
    "suite, ord, block, iv, icv, boundary, residue, class"))
cte("d_class", values([(c, s, v, len(m)) for c, (m, s, v) in R.FRAMING_CLASSES.items()],
                      "class, signature, verdict, n_members"))
cte("d_dh", values([(g, *v) for g, v in R.DH.items()], "gid, gname, mbits, kind, cbits, qbits, family"))
cte("d_encr", values([(n, b, k) for n, (b, k) in R.ENCR_STRENGTH.items()], "name, bits, block"))
cte("d_integ", values(list(R.INTEG_STRENGTH.items()), "name, bits"))
cte("d_prf", values(list(R.PRF_STRENGTH.items()), "name, bits"))
cte("d_policy", values(
    [("ENCR", n, "prohibited") for n in R.BASELINE_POLICY.encr_prohibited]
    + [("INTEG", n, "prohibited") for n in R.BASELINE_POLICY.integ_prohibited]
    + [("INTEG", n, "legacy") for n in R.BASELINE_POLICY.integ_legacy]
    + [("PRF", n, "prohibited") for n in R.BASELINE_POLICY.prf_prohibited]
    + [("PRF", n, "legacy") for n in R.BASELINE_POLICY.prf_legacy]
    + [("DH", str(n), "prohibited") for n in R.BASELINE_POLICY.dh_prohibited]
    + [("DH", str(n), "legacy") for n in R.BASELINE_POLICY.dh_legacy], "kind, name, verdict"))
cte("d_family", values(list(R.VENDOR_FAMILY.items()), "vendor, family"))
cte("d_handshake", values(
    [(i, o, *t) for i, s in enumerate(HANDSHAKE_SUITES) for o, t in enumerate(transform_rows(s))],
    "sidx, ord, type_id, type_name, value_id, name, key_length"))
cte("d_extra", values(
    [("weak", 10 + o, *t) for o, t in enumerate(transform_rows(EXTRA_WEAK))]
    + [("pq", 20 + o, *t) for o, t in enumerate(transform_rows(EXTRA_PQ))],
    "why, ord, type_id, type_name, value_id, name, key_length"))

# --- packets ------------------------------------------------------------------------
cte("v_packets", """
SELECT 'site-' || lpad(host::VARCHAR, 2, '0') || '-' || lpad(sno::VARCHAR, 2, '0') AS capture, frame, ts_us,
  '10.0.0.' || host AS src, '203.0.113.' || (10 + sno) AS dst, 4096 + host * 8 + sno AS spi,
  length, CASE WHEN length >= 256 THEN CASE WHEN sno = 5 THEN 5.62e0
    ELSE 7.83e0 + (frame % 17 - 8) / 97e0 END END AS entropy,
  (host % 4 = 1) AS encapsulated,
  CASE sno WHEN 1 THEN '3DES-CBC / HMAC-MD5-96' WHEN 2 THEN 'AES-CBC-128 / HMAC-SHA1-96'
    WHEN 3 THEN 'AES-CBC-256 / HMAC-SHA2-256-128' WHEN 4 THEN 'AES-GCM-256 (ICV 16)'
    ELSE 'NULL encryption / HMAC-SHA1-96' END AS truth,
  CASE WHEN host % 3 = 0 THEN 'tunnel' ELSE 'transport' END AS mode, host % 5 AS loss, host % 2 = 0 AS tfc
FROM (SELECT *, iv + ((inner_len + 2 + b - 1) // b) * b + icv AS length FROM (
  SELECT *, CASE sno WHEN 1 THEN 8 WHEN 2 THEN 16 WHEN 3 THEN 16 ELSE 4 END AS b,
    CASE sno WHEN 1 THEN 8 WHEN 2 THEN 16 WHEN 3 THEN 16 WHEN 4 THEN 8 ELSE 0 END AS iv,
    CASE sno WHEN 3 THEN 16 WHEN 4 THEN 16 ELSE 12 END AS icv
  FROM (SELECT event_id AS frame, epoch_us(ts) AS ts_us, user_id % 20 AS host,
      40 + floor(value * 8)::BIGINT AS inner_len,
      CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END AS sno
    FROM events)))
""")
cte("v_packets_seq", """
SELECT *, row_number() OVER (PARTITION BY capture, src, dst, spi ORDER BY frame)
  + CASE WHEN frame % 31 = 0 THEN 1 ELSE 0 END AS seq FROM v_packets
""")
cte("v_flows", """
SELECT capture, src, dst, spi, src || '->' || dst || ':0x' || lpad(lower(to_hex(spi)), 8, '0') AS flow,
  count(*) AS packets, min(ts_us) AS first_us, max(ts_us) AS last_us, arg_min(encapsulated, frame) AS encapsulated,
  sum(length)::BIGINT AS bytes, min(length) AS min_length, count(DISTINCT length) AS distinct_lengths,
  count(entropy) AS entropy_samples, CASE WHEN count(entropy) >= 12 THEN avg(entropy) END AS mean_entropy,
  any_value(truth) AS truth, any_value(mode) AS mode, any_value(loss) AS loss, any_value(tfc) AS tfc,
  list_reduce(list(DISTINCT length - base), lambda a, b: gcd(a, b)) AS granularity
FROM (SELECT *, min(length) OVER (PARTITION BY capture, src, dst, spi) AS base FROM v_packets) GROUP BY capture, src, dst, spi
""")
cte("v_trace", """
SELECT *, CASE failed WHEN 'granularity' THEN 1 WHEN 'residue' THEN 2 WHEN 'overhead' THEN 3 WHEN 'entropy' THEN 4 END AS step
FROM (SELECT f.*, s.suite, s.ord, s.class, s.boundary, s.residue AS expected_residue, s.iv + s.icv AS overhead, a.agree,
  CASE WHEN f.distinct_lengths >= 8 AND f.granularity > 0 AND f.granularity <> s.boundary THEN 'granularity'
       WHEN a.agree < 0.90e0 THEN 'residue'
       WHEN f.min_length < s.iv + s.icv + 4 THEN 'overhead'
       WHEN f.mean_entropy IS NOT NULL AND s.suite NOT LIKE 'NULL%' AND f.mean_entropy < 6.8e0 THEN 'entropy'
       WHEN f.mean_entropy IS NOT NULL AND s.suite LIKE 'NULL%' AND f.mean_entropy > 7.2e0 THEN 'entropy' END AS failed
FROM v_flows f CROSS JOIN d_suite s JOIN (
  SELECT p.capture, p.src, p.dst, p.spi, s.suite,
    sum(CASE WHEN p.length % s.boundary = s.residue THEN 1 ELSE 0 END)::DOUBLE / count(*) AS agree
  FROM v_packets p CROSS JOIN d_suite s GROUP BY ALL) a
ON a.capture = f.capture AND a.src = f.src AND a.dst = f.dst AND a.spi = f.spi AND a.suite = s.suite)
""")
# most likely class of a flow under a flat prior over surviving suites
cte("v_top", """
SELECT capture, src, dst, spi, flow, packets, truth, mode, loss, tfc, entropy_samples, mean_entropy, distinct_lengths,
  arg_max(class, struct_pack(t := top, o := -ord)) AS class, arg_max(mass, struct_pack(t := top, o := -ord)) AS confidence, max(n_surv) AS survivors
FROM (SELECT capture, src, dst, spi, flow, packets, truth, mode, loss, tfc, entropy_samples, mean_entropy, distinct_lengths,
  class, round(sum(prob), 9) AS mass, max(n) AS n_surv, round(max(prob), 9) AS top, arg_min(ord, struct_pack(p := -round(prob, 9), o := ord)) AS ord
  FROM (SELECT t.*, CASE WHEN n = 0 THEN 1e0 / 9 WHEN failed IS NULL THEN 1e0 / n ELSE 0e0 END AS prob FROM
    (SELECT *, sum(CASE WHEN failed IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY capture, src, dst, spi) AS n FROM v_trace) t)
  GROUP BY ALL) GROUP BY ALL
""")

# --- raw packets ---------------------------------------------------------------------
cte("v_raw", """
SELECT 'cap-' || (user_id % 7) AS capture, event_id AS frame, epoch_us(ts) AS ts_us, '10.0.0.' || (user_id % 20) AS src,
  '203.0.113.' || (user_id % 11) AS dst, event_id % 10 AS shape,
  CASE WHEN event_id % 10 IN (5, 6, 8, 9) THEN 50 WHEN event_id % 10 = 7 THEN 6 ELSE 17 END AS protocol,
  CASE WHEN event_id % 10 IN (0, 4) THEN 500 WHEN event_id % 10 IN (1, 2, 3) THEN 4500 WHEN event_id % 10 = 7 THEN 443 ELSE 0 END AS sport,
  CASE WHEN event_id % 10 IN (0, 4) THEN 500 WHEN event_id % 10 IN (1, 2, 3) THEN 4500 WHEN event_id % 10 = 7 THEN 50000 ELSE 0 END AS dport,
  CASE event_id % 10
   WHEN 0 THEN lpad(to_hex(event_id + 1), 16, '0') || repeat('00', 8) || '21202208' || repeat('00', 4) || '0000001C'
   WHEN 1 THEN '00000000' || lpad(to_hex(event_id + 1), 16, '0') || repeat('00', 8) || '21202220' || repeat('00', 4) || '0000001C'
   WHEN 2 THEN 'FF'
   WHEN 4 THEN lpad(to_hex(event_id + 1), 16, '0') || repeat('00', 8) || '21302208' || repeat('00', 4) || '0000001C'
   WHEN 5 THEN repeat('00', 4) || lpad(to_hex(event_id), 8, '0') || repeat('AB', 32)
   WHEN 6 THEN '0000100A'
   WHEN 7 THEN repeat('16', 24)
   ELSE lpad(to_hex(4096 + user_id % 40), 8, '0') || lpad(to_hex(event_id), 8, '0')
     || repeat(lpad(to_hex(event_id % 256), 2, '0'), 24 + 4 * (event_id % 9)) END AS hexed
FROM events
""")
cte("v_raw_class", """
SELECT *, CASE WHEN shape = 0 THEN 'ike' WHEN shape = 1 THEN 'ike' WHEN shape = 2 THEN 'keepalive' WHEN shape = 3 THEN 'esp_natt'
  WHEN shape IN (8, 9) THEN 'esp' ELSE 'other' END AS pkt_class FROM v_raw
""")

# --- handshakes -----------------------------------------------------------------------
cte("v_sa", """
SELECT *, CASE WHEN k % 2 = 1 THEN pb ELSE pa END AS a, CASE WHEN k % 2 = 1 THEN pa ELSE pb END AS b FROM (
  SELECT o_orderkey AS k, o_custkey AS c, epoch_us(o_orderdate) AS day_us, o_orderpriority = '5-LOW' AS v1,
    o_orderstatus <> 'P' AS confirmed,
    CASE WHEN o_orderpriority = '5-LOW' THEN 8 + o_orderkey % 4 ELSE o_orderkey % 8 END AS sidx,
    'site-' || lpad((o_custkey % 20)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') AS capture,
    '10.1.' || (o_custkey // 250) || '.' || (o_custkey % 250) AS pa, '203.0.113.' || (10 + o_custkey % 7) AS pb,
    lower(lpad(to_hex(o_orderkey + 1), 16, '0')) AS sid,
    epoch_us(o_orderdate) + (o_orderkey % 1000) * 1000000 + 1000 AS first_us
  FROM orders)
""")
cte("v_msg", """
SELECT s.*, slot, s.k * 10 + slot AS frame, s.day_us + (s.k % 1000) * 1000000 + slot * 1000 AS ts_us,
  CASE WHEN slot = 2 THEN s.b ELSE s.a END AS src, CASE WHEN slot = 2 THEN s.a ELSE s.b END AS dst,
  CASE WHEN s.v1 THEN 'IKEv1' ELSE 'IKEv2' END AS version,
  CASE WHEN slot <= 3 THEN CASE WHEN s.v1 THEN CASE WHEN k % 9 = 0 THEN 'Aggressive Mode' ELSE 'Identity Protection (Main Mode)' END ELSE 'IKE_SA_INIT' END
    WHEN slot = 4 THEN 'IKE_INTERMEDIATE' WHEN s.v1 THEN 'Quick Mode' ELSE 'IKE_AUTH' END AS exchange,
  CASE WHEN slot IN (2, 4, 5) THEN lower(lpad(to_hex(k + 7), 16, '0')) ELSE repeat('0', 16) END AS responder_spi,
  CASE slot WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS message_id, slot = 2 AS is_response,
  CASE WHEN slot <= 3 THEN h.value_id END AS ke_group,
  CASE WHEN slot = 1 AND v1 THEN 28800 * (1 + k % 5) END AS lifetime_seconds,
  CASE WHEN slot = 1 AND v1 THEN CASE WHEN k % 2 = 0 THEN 'PRE_SHARED_KEY' ELSE 'RSA_SIGNATURES' END END AS auth_method,
  CASE WHEN slot IN (1, 3) THEN CASE WHEN k % 10 = 5 THEN sha256('ke-' || (c % 7) || '-' || (k % 40)) ELSE sha256('ke-' || k) END
    WHEN slot = 2 THEN sha256('kr-' || k) END AS ke_digest,
  CASE WHEN slot IN (1, 3) THEN CASE WHEN k % 10 = 1 THEN sha256('n-' || (k % 100)) ELSE sha256('n-' || k) END
    WHEN slot = 2 THEN sha256('nr-' || k) END AS nonce_digest,
  CASE WHEN slot <= 3 THEN CASE WHEN k % 17 = 0 AND slot <> 2 THEN 8 ELSE 32 END END AS nonce_len
FROM v_sa s JOIN d_handshake h ON h.sidx = s.sidx AND h.type_id = 4, (SELECT unnest([1, 2, 3, 4, 5]) AS slot)
WHERE slot = 1 OR (slot = 2 AND confirmed) OR (slot = 3 AND k % 13 = 0)
  OR (slot = 4 AND confirmed AND s.sidx = 4 AND k % 3 <> 0) OR (slot = 5 AND confirmed)
""")
cte("v_notify", """
SELECT * FROM (
SELECT capture, sid, k, slot, frame, is_response, 0 AS ord, 'NAT_DETECTION_SOURCE_IP' AS notify FROM v_msg WHERE slot IN (1, 3)
UNION ALL SELECT capture, sid, k, slot, frame, is_response, 1, 'IKEV2_FRAGMENTATION_SUPPORTED' FROM v_msg WHERE slot IN (1, 3) AND k % 4 <> 0 AND NOT v1
UNION ALL SELECT capture, sid, k, slot, frame, is_response, 0, 'USE_PPK' FROM v_msg WHERE slot = 2 AND k % 19 = 0
UNION ALL SELECT capture, sid, k, slot, frame, is_response, 1, 'NO_PROPOSAL_CHOSEN' FROM v_msg WHERE slot = 2 AND k % 23 = 0)
""")
cte("v_vendor", """
SELECT capture, sid, k, frame, unnest(vendors) AS vendor, generate_subscripts(vendors, 1) AS ord FROM (
SELECT capture, sid, k, frame, CASE k % 6 WHEN 0 THEN ['Cisco IOS / ASA'] WHEN 1 THEN ['strongSwan'] WHEN 2 THEN ['Fortinet FortiGate']
  WHEN 3 THEN ['Juniper SRX / NetScreen'] WHEN 5 THEN ['Dead Peer Detection (RFC 3706)', 'Microsoft Windows IKE'] ELSE [] END AS vendors
FROM v_msg WHERE slot = 1)
""")
cte("v_family", """
SELECT s.capture, s.sid, coalesce(m.family, 'generic') AS vendor_family FROM v_sa s LEFT JOIN (
  SELECT v.sid, arg_min(f.family, v.ord) AS family FROM v_vendor v JOIN d_family f ON f.vendor = v.vendor GROUP BY v.sid) m ON m.sid = s.sid
""")
cte("v_offer", """
SELECT s.capture, s.sid, s.k, h.ord, h.type_id, h.type_name, h.value_id, h.name, h.key_length FROM v_sa s JOIN d_handshake h ON h.sidx = s.sidx
UNION ALL SELECT s.capture, s.sid, s.k, e.ord, e.type_id, e.type_name, e.value_id, e.name, e.key_length FROM v_sa s JOIN d_extra e
  ON (e.why = 'weak' AND s.k % 5 = 0 AND NOT s.v1) OR (e.why = 'pq' AND s.k % 11 = 0 AND NOT s.v1 AND s.sidx NOT IN (4, 5))
""")
cte("v_neg", """
SELECT o.*, o.name || CASE WHEN o.key_length > 0 THEN '-' || o.key_length ELSE '' END AS label, s.confirmed
FROM v_offer o JOIN v_sa s ON s.sid = o.sid WHERE NOT s.confirmed OR o.ord < 10
""")
cte("v_slot", """
SELECT capture, sid, type_id, min(cb) AS cb, min(qb) AS qb, arg_min(struct_pack(fam := fam, gid := value_id, nm := name), struct_pack(q := qb, c := cb, o := ord)) AS w
FROM (SELECT n.*, coalesce(d.cbits, CASE WHEN n.type_id = 4 THEN 112 ELSE 0 END) AS cb, coalesce(d.qbits, 0) AS qb,
    coalesce(d.family, CASE WHEN n.type_id = 4 THEN 'modp' ELSE 'unknown' END) AS fam
  FROM v_neg n LEFT JOIN d_dh d ON d.gid = n.value_id WHERE n.type_id = 4 OR n.type_id BETWEEN 6 AND 12)
GROUP BY capture, sid, type_id
""")
cte("v_kex", """
SELECT capture, sid, max(cb) AS kex_c, max(qb) AS kex_q, count(*) AS parts,
  string_agg(fam, '+' ORDER BY o) FILTER (dup = 1) AS kex_family,
  string_agg(nm, ' + ' ORDER BY o) AS kex_names FROM (
  SELECT *, row_number() OVER (PARTITION BY sid, fam ORDER BY type_id) AS dup FROM (
    SELECT capture, sid, type_id AS o, type_id, cb, qb, w.fam AS fam, w.nm AS nm FROM v_slot WHERE type_id = 4 OR w.fam NOT IN ('none', 'unknown')))
GROUP BY capture, sid
""")
cte("v_comp", """
SELECT n.capture, n.sid, min(CASE WHEN n.type_id = 1 THEN CASE WHEN n.key_length > 0 AND (n.name LIKE 'ENCR\\_AES%' ESCAPE '\\' OR n.name LIKE 'AES%') THEN n.key_length ELSE coalesce(e.bits, 128) END END) AS enc,
  min(CASE WHEN n.type_id = 1 THEN coalesce(e.block, 128) END) AS block_bits,
  min(CASE WHEN n.type_id = 2 THEN coalesce(p.bits, 128) END) AS prf,
  min(CASE WHEN n.type_id = 3 THEN coalesce(i.bits, 128) END) AS integ
FROM v_neg n LEFT JOIN d_encr e ON e.name = n.name LEFT JOIN d_prf p ON p.name = n.name LEFT JOIN d_integ i ON i.name = n.name
GROUP BY n.capture, n.sid
""")
cte("v_str", """
SELECT s.capture, s.sid, s.k, s.c, s.a, s.b, s.pa, s.pb, s.v1, s.confirmed, s.day_us, s.first_us,
  CASE WHEN s.v1 THEN 'IKEv1' ELSE 'IKEv2' END AS version, s.a || ' <-> ' || s.b AS peer,
  least(c.enc, c.prf, c.integ, x.kex_c) AS classical_bits, c.block_bits, c.enc, c.prf, c.integ, x.kex_c AS kex_bits,
  CASE WHEN s.confirmed OR x.kex_q = 0 THEN least(c.enc // 2, x.kex_q) ELSE 0 END AS quantum_bits,
  CASE WHEN s.confirmed THEN x.kex_q ELSE 0 END AS kex_quantum_bits, x.kex_q AS raw_kex_q,
  x.kex_family, x.parts, x.kex_names,
  CASE WHEN s.pa < s.pb THEN s.pa || '|' || s.pb ELSE s.pb || '|' || s.pa END AS peer_key
FROM v_sa s JOIN v_comp c ON c.sid = s.sid JOIN v_kex x ON x.sid = s.sid
""")

# --- findings ---------------------------------------------------------------------------
cte("v_volume", """
SELECT s.capture, s.sid, coalesce(sum(f.bytes), 0)::BIGINT AS observed_bytes, coalesce(max((f.last_us - f.first_us) / 1e6), 0e0) AS observed_seconds
FROM v_sa s LEFT JOIN v_flows f ON f.capture = s.capture AND (f.src IN (s.a, s.b) OR f.dst IN (s.a, s.b)) GROUP BY s.capture, s.sid
""")
cte("v_life", """
SELECT sid, max(lifetime_seconds) AS lifetime FROM v_msg GROUP BY sid
""")
cte("v_sweet", """
SELECT *, CASE WHEN rate > 0 THEN round(lim / rate, 1) END AS seconds_to_limit, round(rate * rekey / lim, 3) AS ratio, rate * rekey >= lim AS exceeds FROM (
SELECT s.*, v.observed_bytes, v.observed_seconds, coalesce(l.lifetime, 86400) AS rekey, (s.block_bits // 8) * 4294967296e0 AS lim,
  CASE WHEN v.observed_seconds > 0 THEN v.observed_bytes::DOUBLE / v.observed_seconds ELSE 0e0 END AS rate
FROM v_str s JOIN v_volume v ON v.sid = s.sid JOIN v_life l ON l.sid = s.sid WHERE s.block_bits > 0 AND s.block_bits < 128)
""")
RULE_SQL = {
    "IKE-001": "SELECT capture, peer AS subject, 'IKEv1 in use' AS title, 'high' AS severity FROM v_str WHERE v1",
    "IKE-002": "SELECT capture, peer AS subject, 'IKEv1 Aggressive Mode' AS title, 'critical' AS severity FROM v_str WHERE v1 AND k % 9 = 0",
    "IKE-003": "SELECT capture, peer AS subject, 'Pre-shared key authentication (PRE_SHARED_KEY)' AS title, 'medium' AS severity FROM v_str WHERE v1 AND k % 2 = 0",
    "IKE-004": """SELECT s.capture, s.peer AS subject, CASE WHEN p.name IS NOT NULL THEN 'Prohibited IKE encryption algorithm: ' ELSE 'Undersized key length: ' END || n.label AS title,
      CASE WHEN p.name IS NOT NULL THEN 'critical' ELSE 'high' END AS severity FROM v_str s JOIN v_neg n ON n.sid = s.sid AND n.type_id = 1
      LEFT JOIN d_policy p ON p.kind = 'ENCR' AND p.name = n.name WHERE p.name IS NOT NULL OR n.key_length < 128""",
    "IKE-005": """SELECT s.capture, s.peer AS subject, CASE p.verdict WHEN 'prohibited' THEN 'Prohibited ' ELSE 'Deprecated ' END || CASE p.kind WHEN 'PRF' THEN 'PRF: ' ELSE 'integrity algorithm: ' END || n.name AS title,
      CASE WHEN p.verdict = 'prohibited' THEN 'high' WHEN p.kind = 'PRF' THEN 'low' ELSE 'medium' END AS severity
      FROM v_str s JOIN v_neg n ON n.sid = s.sid JOIN d_policy p ON p.name = n.name AND p.kind = CASE n.type_id WHEN 3 THEN 'INTEG' WHEN 2 THEN 'PRF' END""",
    "IKE-006": """SELECT s.capture, s.peer AS subject, CASE p.verdict WHEN 'prohibited' THEN 'Prohibited' ELSE 'Deprecated' END || ' Diffie-Hellman group ' || n.value_id || ' (' || d.gname || ')' AS title,
      CASE p.verdict WHEN 'prohibited' THEN 'critical' ELSE 'high' END AS severity
      FROM v_str s JOIN (SELECT DISTINCT sid, value_id FROM v_neg WHERE type_id = 4) n ON n.sid = s.sid JOIN d_policy p ON p.kind = 'DH' AND p.name = n.value_id::VARCHAR JOIN d_dh d ON d.gid = n.value_id""",
    "IKE-007": """SELECT s.capture, s.peer AS subject, 'No quantum-resistant key establishment' AS title, 'medium' AS severity FROM v_str s
      WHERE NOT (s.confirmed AND s.k % 19 = 0) AND NOT EXISTS (SELECT 1 FROM v_neg n WHERE n.sid = s.sid AND s.confirmed AND (n.type_id = 4 OR n.type_id >= 6) AND n.value_id IN (35, 36, 37))""",
    "IKE-008": """SELECT s.capture, s.peer AS subject, 'Broken transforms remain in the proposal set' AS title, 'medium' AS severity FROM v_str s WHERE s.sid IN (
      SELECT o.sid FROM v_offer o JOIN (SELECT * FROM d_policy WHERE verdict = 'prohibited') p
        ON p.kind = CASE o.type_id WHEN 1 THEN 'ENCR' WHEN 3 THEN 'INTEG' WHEN 4 THEN 'DH' END AND p.name = CASE o.type_id WHEN 4 THEN o.value_id::VARCHAR ELSE o.name END
      LEFT JOIN v_neg n ON n.sid = o.sid AND n.label = o.name || CASE WHEN o.key_length > 0 THEN '-' || o.key_length ELSE '' END WHERE o.type_id = 4 OR n.sid IS NULL)""",
    "IKE-009": """SELECT s.capture, s.peer AS subject, 'Excessive SA lifetime (' || printf('%.1f', l.lifetime / 3600e0) || ' hours)' AS title, 'medium' AS severity
      FROM v_str s JOIN v_life l ON l.sid = s.sid WHERE l.lifetime > 86400""",
    "IKE-010": "SELECT capture, peer AS subject, 'Repeated negotiation failures observed' AS title, 'medium' AS severity FROM v_str WHERE sid IN (SELECT sid FROM v_notify WHERE notify = 'NO_PROPOSAL_CHOSEN')",
    "IKE-011": "SELECT capture, peer AS subject, 'IKEv2 fragmentation not negotiated' AS title, 'low' AS severity FROM v_str WHERE NOT v1 AND sid NOT IN (SELECT sid FROM v_notify WHERE notify = 'IKEV2_FRAGMENTATION_SUPPORTED')",
    "IKE-012": "SELECT capture, peer AS subject, 'Association provides only ' || classical_bits || '-bit security' AS title, CASE WHEN classical_bits < 80 THEN 'critical' ELSE 'high' END AS severity FROM v_str WHERE classical_bits < 112",
    "IKE-013": """SELECT capture, peer AS subject, '64-bit block cipher ' || CASE WHEN exceeds THEN 'already exceeds' WHEN ratio > 0.1 THEN 'approaches' ELSE 'remains below' END || ' the Sweet32 birthday bound' AS title,
      CASE WHEN exceeds THEN 'critical' WHEN ratio > 0.1 THEN 'high' ELSE 'medium' END AS severity FROM v_sweet""",
    "IKE-014": """SELECT s.capture, s.peer AS subject, 'Additional key exchange negotiated but not observed' AS title, 'info' AS severity FROM v_str s
      WHERE s.confirmed AND EXISTS (SELECT 1 FROM v_neg n WHERE n.sid = s.sid AND n.type_id >= 6 AND n.value_id <> 0) AND NOT EXISTS (SELECT 1 FROM v_msg m WHERE m.sid = s.sid AND m.exchange = 'IKE_INTERMEDIATE')""",
    "IKE-015": """SELECT capture, arg_min(subject, frame) AS subject, 'Key exchange public value reused across IKE SAs' AS title, 'medium' AS severity FROM (
      SELECT m.capture, m.src, m.ke_digest, m.sid, m.frame, m.a || ' <-> ' || m.b AS subject, m.pa, m.pb, count(DISTINCT m.sid) OVER (PARTITION BY m.capture, m.src, m.ke_digest) AS n
      FROM v_msg m WHERE m.ke_digest IS NOT NULL) WHERE n >= 2 GROUP BY capture, src, ke_digest, pa, pb""",
    "IKE-016": """SELECT capture, arg_min(subject, frame) AS subject, 'Nonce reused across IKE SAs' AS title, 'high' AS severity FROM (
      SELECT m.capture, m.nonce_digest, m.sid, m.frame, m.a || ' <-> ' || m.b AS subject, m.pa, m.pb, count(DISTINCT m.sid) OVER (PARTITION BY m.capture, m.nonce_digest) AS n
      FROM v_msg m WHERE m.nonce_digest IS NOT NULL) WHERE n >= 2 GROUP BY capture, nonce_digest, pa, pb
      UNION ALL SELECT capture, peer AS subject, 'Nonce shorter than 128 bits' AS title, 'high' AS severity FROM v_str WHERE NOT v1 AND k % 17 = 0""",
    "ESP-001": """SELECT t.capture, t.flow AS subject, 'ESP tunnel using ' || t.class AS title, CASE c.verdict WHEN 'prohibited' THEN 'critical' ELSE 'medium' END AS severity
      FROM v_top t JOIN d_class c ON c.class = t.class WHERE c.verdict <> 'acceptable' AND t.confidence >= 0.35e0""",
    "ESP-002": "SELECT capture, flow AS subject, 'ESP payload entropy below the ciphertext floor' AS title, 'high' AS severity FROM v_flows WHERE entropy_samples >= 12 AND mean_entropy < 7.0e0",
    "ESP-003": """SELECT f.capture, f.flow AS subject, 'Anti-replay sequence discontinuities' AS title, 'low' AS severity FROM v_flows f JOIN (
      SELECT capture, src, dst, spi, sum(CASE WHEN seq <> prev + 1 THEN 1 ELSE 0 END) AS gaps FROM (SELECT *, lag(seq) OVER (PARTITION BY capture, src, dst, spi ORDER BY frame) AS prev FROM v_packets_seq) GROUP BY ALL) g
      ON g.capture = f.capture AND g.src = f.src AND g.dst = f.dst AND g.spi = f.spi WHERE f.packets >= 50 AND g.gaps >= f.packets * 0.02e0""",
    "ESP-004": "SELECT capture, flow AS subject, 'Insufficient sample for reliable inference' AS title, 'info' AS severity FROM v_flows WHERE packets < 60",
}
cte("v_findings", " UNION ALL ".join(
    f"SELECT capture, '{r}' AS rule_id, title, severity, subject, {str(r.startswith('ESP')).lower()} AS inferred FROM ({s})" for r, s in RULE_SQL.items()))
#: Evidence of each rule: rows it fires on, then field -> SQL of its value. A value is text unless its field is in EVIDENCE_NUMBERS.
EVIDENCE_NUMBERS = ("group", "intermediate_exchanges_seen", "lifetime_seconds", "classical_bits", "quantum_bits", "threshold_gb", "rate_mbps", "per_rekey_gb",
                    "ratio", "seconds_to_limit", "distinct_sas", "group_confidence", "packets", "distinct_lengths", "mean_entropy", "gaps")
_REUSED = """SELECT capture, arg_min(subject, frame) AS subject, any_value(src) AS src, {d} AS digest, any_value(n) AS n FROM (
      SELECT m.capture, m.src, m.{d}, m.frame, m.a || ' <-> ' || m.b AS subject, m.pa, m.pb, count(DISTINCT m.sid) OVER (PARTITION BY m.capture, {who}m.{d}) AS n
      FROM v_msg m WHERE m.{d} IS NOT NULL) WHERE n >= 2 GROUP BY capture, {by}{d}, pa, pb"""
EVIDENCE_SQL = {
    "IKE-001": ("SELECT capture, peer AS subject, version, sid FROM v_str WHERE v1", {"version": "version", "spi": "sid"}),
    "IKE-003": ("SELECT capture, peer AS subject FROM v_str WHERE v1 AND k % 2 = 0", {"auth_method": "'PRE_SHARED_KEY'"}),
    "IKE-004": ("""SELECT s.capture, s.peer AS subject, n.label FROM v_str s JOIN v_neg n ON n.sid = s.sid AND n.type_id = 1
      LEFT JOIN d_policy p ON p.kind = 'ENCR' AND p.name = n.name WHERE p.name IS NOT NULL OR n.key_length < 128""", {"transform": "label"}),
    "IKE-005": ("""SELECT s.capture, s.peer AS subject, n.name FROM v_str s JOIN v_neg n ON n.sid = s.sid
      JOIN d_policy p ON p.name = n.name AND p.kind = CASE n.type_id WHEN 3 THEN 'INTEG' WHEN 2 THEN 'PRF' END""", {"transform": "name"}),
    "IKE-006": ("""SELECT s.capture, s.peer AS subject, n.value_id FROM v_str s JOIN (SELECT DISTINCT sid, value_id FROM v_neg WHERE type_id = 4) n ON n.sid = s.sid
      JOIN d_policy p ON p.kind = 'DH' AND p.name = n.value_id::VARCHAR""", {"group": "value_id"}),
    "IKE-007": ("""SELECT s.capture, s.peer AS subject, s.confirmed, s.sid IN (SELECT sid FROM v_offer WHERE (type_id = 4 OR type_id BETWEEN 6 AND 12) AND value_id IN (35, 36, 37)) AS offered,
      (SELECT count(*) FROM v_msg m WHERE m.sid = s.sid AND m.exchange = 'IKE_INTERMEDIATE') AS seen FROM v_str s
      WHERE NOT (s.confirmed AND s.k % 19 = 0) AND NOT EXISTS (SELECT 1 FROM v_neg n WHERE n.sid = s.sid AND s.confirmed AND (n.type_id = 4 OR n.type_id >= 6) AND n.value_id IN (35, 36, 37))""",
                {"ppk": "'false'", "responder_confirmed": "confirmed::VARCHAR", "pq_offered": "offered::VARCHAR", "intermediate_exchanges_seen": "seen"}),
    "IKE-008": ("""SELECT s.capture, s.peer AS subject, string_agg(DISTINCT o.said, ', ' ORDER BY o.said) AS residual FROM v_str s JOIN (
      SELECT o.sid, CASE WHEN o.type_id = 4 THEN 'DH group ' || o.value_id ELSE o.name || CASE WHEN o.key_length > 0 THEN '-' || o.key_length ELSE '' END END AS said
      FROM v_offer o JOIN (SELECT * FROM d_policy WHERE verdict = 'prohibited') p
        ON p.kind = CASE o.type_id WHEN 1 THEN 'ENCR' WHEN 3 THEN 'INTEG' WHEN 4 THEN 'DH' END AND p.name = CASE o.type_id WHEN 4 THEN o.value_id::VARCHAR ELSE o.name END
      LEFT JOIN v_neg n ON n.sid = o.sid AND n.label = o.name || CASE WHEN o.key_length > 0 THEN '-' || o.key_length ELSE '' END WHERE o.type_id = 4 OR n.sid IS NULL) o ON o.sid = s.sid
      GROUP BY s.capture, s.sid, s.peer""", {"residual": "residual"}),
    "IKE-009": ("SELECT s.capture, s.peer AS subject, l.lifetime FROM v_str s JOIN v_life l ON l.sid = s.sid WHERE l.lifetime > 86400", {"lifetime_seconds": "lifetime"}),
    "IKE-010": ("SELECT capture, peer AS subject FROM v_str WHERE sid IN (SELECT sid FROM v_notify WHERE notify = 'NO_PROPOSAL_CHOSEN')", {"notifies": "'NO_PROPOSAL_CHOSEN'"}),
    "IKE-012": ("""SELECT capture, peer AS subject, classical_bits, quantum_bits, CASE classical_bits WHEN enc THEN 'encryption' WHEN prf THEN 'prf' WHEN integ THEN 'integrity' ELSE 'key_exchange' END AS weakest,
      CASE WHEN classical_bits >= 80 THEN 'deprecated' ELSE 'broken' END AS grade FROM v_str WHERE classical_bits < 112""",
                {"weakest": "weakest", "classical_bits": "classical_bits", "quantum_bits": "quantum_bits", "grade": "grade"}),
    "IKE-013": ("SELECT *, peer AS subject FROM v_sweet", {"threshold_gb": "round(lim / 1e9, 1)", "rate_mbps": "round(rate * 8 / 1e6, 2)", "per_rekey_gb": "round(rate * rekey / 1e9, 2)",
                                                        "ratio": "ratio", "seconds_to_limit": "seconds_to_limit"}),
    "IKE-014": ("""SELECT s.capture, s.peer AS subject, string_agg(n.type_name || '=' || n.name, ', ' ORDER BY n.ord) AS agreed FROM v_str s
      JOIN v_neg n ON n.sid = s.sid AND n.type_id >= 6 AND n.value_id <> 0 WHERE s.confirmed AND NOT EXISTS (SELECT 1 FROM v_msg m WHERE m.sid = s.sid AND m.exchange = 'IKE_INTERMEDIATE')
      GROUP BY s.capture, s.sid, s.peer""", {"addke_selected": "agreed"}),
    "IKE-015": (_REUSED.format(d="ke_digest", who="m.src, ", by="src, "), {"peer": "src", "ke_sha256": "digest", "distinct_sas": "n"}),
    "IKE-016": (_REUSED.format(d="nonce_digest", who="", by=""), {"nonce_sha256": "digest", "distinct_sas": "n"}),
    "ESP-001": ("""SELECT t.capture, t.flow AS subject, t.class, t.confidence, t.packets, t.distinct_lengths
      FROM v_top t JOIN d_class c ON c.class = t.class WHERE c.verdict <> 'acceptable' AND t.confidence >= 0.35e0""",
                {"framing_class": "class", "group_confidence": "round(confidence, 4)", "packets": "packets", "distinct_lengths": "distinct_lengths"}),
    "ESP-002": ("SELECT capture, flow AS subject, mean_entropy, packets FROM v_flows WHERE entropy_samples >= 12 AND mean_entropy < 7.0e0",
                {"mean_entropy": "round(mean_entropy, 3)", "packets": "packets"}),
    "ESP-003": ("""SELECT f.capture, f.flow AS subject, f.packets, g.gaps FROM v_flows f JOIN (
      SELECT capture, src, dst, spi, sum(CASE WHEN seq <> prev + 1 THEN 1 ELSE 0 END) AS gaps FROM (SELECT *, lag(seq) OVER (PARTITION BY capture, src, dst, spi ORDER BY frame) AS prev FROM v_packets_seq) GROUP BY ALL) g
      ON g.capture = f.capture AND g.src = f.src AND g.dst = f.dst AND g.spi = f.spi WHERE f.packets >= 50 AND g.gaps >= f.packets * 0.02e0""", {"gaps": "gaps", "packets": "packets"}),
    "ESP-004": ("SELECT capture, flow AS subject, packets FROM v_flows WHERE packets < 60", {"packets": "packets"}),
}
cte("v_evidence", " UNION ALL ".join(
    f"SELECT capture, '{r}' AS rule_id, subject, '{field}' AS field, {'NULL' if field in EVIDENCE_NUMBERS else said}::VARCHAR AS said, "
    f"{said if field in EVIDENCE_NUMBERS else 'NULL'}::DOUBLE AS number FROM ({rows}) WHERE {said} IS NOT NULL"
    for r, (rows, fields) in EVIDENCE_SQL.items() for field, said in fields.items()))
cte("v_flink", """
SELECT *, CASE WHEN rule_id LIKE 'ESP%' THEN split_part(subject, '->', 1) || '~' || split_part(split_part(subject, '->', 2), ':', 1)
  WHEN subject LIKE '10.1.%' THEN split_part(subject, ' <-> ', 1) || '~' || split_part(subject, ' <-> ', 2)
  ELSE split_part(subject, ' <-> ', 2) || '~' || split_part(subject, ' <-> ', 1) END AS link FROM v_findings
""")
cte("v_captures", "SELECT DISTINCT capture FROM v_sa UNION SELECT DISTINCT capture FROM v_packets")
cte("v_posture", """
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'E' END AS grade FROM (
SELECT capture, coalesce(sum((severity = 'critical')::INT), 0)::BIGINT AS critical, coalesce(sum((severity = 'high')::INT), 0)::BIGINT AS high,
  coalesce(sum((severity = 'medium')::INT), 0)::BIGINT AS medium, coalesce(sum((severity = 'low')::INT), 0)::BIGINT AS low,
  coalesce(sum((severity = 'info')::INT), 0)::BIGINT AS info, count(severity) AS findings, round(100 * exp(-coalesce(any_value(pen), 0) / 75e0))::INT AS score
FROM v_captures LEFT JOIN v_findings USING (capture) LEFT JOIN (
  SELECT capture, sum(weight * least(1 + (n - 1) / 3e0, 3e0)) AS pen FROM (SELECT capture, severity, count(*) AS n FROM v_findings GROUP BY ALL) JOIN d_severity USING (severity) GROUP BY capture) p USING (capture)
GROUP BY capture)
""")
cte("v_links", """
SELECT capture, link, sum(s)::BIGINT AS sessions, sum(t)::BIGINT AS tunnels, min(w) AS w FROM (
 SELECT capture, pa || '~' || pb AS link, 1 AS s, 0 AS t, struct_pack(c := classical_bits, q := quantum_bits, f := kex_family, h := parts > 1) AS w FROM v_str
 UNION ALL SELECT capture, src || '~' || dst, 0, 1, NULL FROM v_flows) GROUP BY capture, link
""")
cte("v_link_view", """
SELECT l.*, coalesce(f.findings, 0) AS findings, f.rnk, l.w.c AS classical_bits, l.w.q AS quantum_bits, CASE f.rnk WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' END AS worst_severity
FROM v_links l LEFT JOIN (SELECT capture, link, count(*) AS findings, min(rnk) AS rnk FROM v_flink JOIN d_severity USING (severity) GROUP BY ALL) f USING (capture, link)
""")

# --- fleet ----------------------------------------------------------------------------------
cte("v_obs", """
SELECT s.sid AS id, s.k, s.peer_key, s.first_us AS observed_us, s.capture, s.version AS ike_version, f.vendor_family, s.classical_bits, s.quantum_bits,
  t.transforms, row_number() OVER (PARTITION BY s.peer_key ORDER BY s.first_us, s.sid) AS rn
FROM v_str s JOIN v_family f ON f.sid = s.sid JOIN (SELECT sid, string_agg(label, ',' ORDER BY label) AS transforms FROM v_neg GROUP BY sid) t ON t.sid = s.sid WHERE s.confirmed
""")
cte("v_seen", """
SELECT o.*, (SELECT count(*) FROM v_obs p WHERE p.peer_key = o.peer_key AND p.rn <= o.rn AND p.classical_bits >= o.classical_bits) AS seen FROM v_obs o
""")
cte("v_verdict", """
SELECT *, CASE WHEN base IS NULL THEN 'new' WHEN classical_bits = base.bits AND quantum_bits < base.q THEN 'downgrade-quantum' WHEN classical_bits = base.bits THEN 'steady'
  WHEN classical_bits < base.bits THEN 'downgrade' WHEN seen >= 2 THEN 'improvement' ELSE 'unconfirmed' END AS verdict FROM (
SELECT o.*, (SELECT max(struct_pack(bits := p.classical_bits, o := -p.rn, q := p.quantum_bits, t := p.transforms)) FROM v_seen p
   WHERE p.peer_key = o.peer_key AND p.rn < o.rn AND (p.rn = 1 OR p.seen >= 2)) AS base FROM v_seen o)
""")
cte("v_base", """
SELECT peer_key, best.bits AS best_classical_bits, best.q AS best_quantum_bits, best.t AS best_transforms, best.id AS best_observation_id, observations, first_seen_us FROM (
SELECT peer_key, max(CASE WHEN rn = 1 OR seen >= 2 THEN struct_pack(bits := classical_bits, o := -rn, q := quantum_bits, t := transforms, id := id) END) AS best,
  count(*) AS observations, min(observed_us) AS first_seen_us FROM v_seen GROUP BY peer_key)
""")
cte("v_fleet", """
SELECT b.peer_key, b.best_classical_bits, b.best_quantum_bits, b.first_seen_us, b.observations, o.classical_bits AS current_bits, o.quantum_bits AS current_quantum,
  o.observed_us AS last_seen_us, o.transforms AS current_transforms, o.vendor_family, o.ike_version, o.classical_bits < b.best_classical_bits AS degraded
FROM v_base b JOIN v_obs o ON o.peer_key = b.peer_key AND o.rn = b.observations
""")
cte("v_exposure", """
SELECT s.capture, s.sid, s.k, s.peer AS subject, s.classical_bits, s.quantum_bits, s.kex_family, s.quantum_bits >= 128 AS quantum_safe, s.kex_quantum_bits, v.observed_bytes,
  CASE WHEN v.observed_seconds > 0 THEN round(v.observed_bytes * 8 / 1e6 / v.observed_seconds, 2) ELSE 0e0 END AS harvest_rate_mbps,
  CASE WHEN s.quantum_bits >= 128 THEN 0e0 ELSE round((1 + sqrt(v.observed_bytes / 1e9)) * greatest(1e0, 128e0 / greatest(s.classical_bits, 8)) * 1.1e0, 2) END AS exposure_index,
  CASE WHEN s.quantum_bits >= 128 THEN 'safe' WHEN s.raw_kex_q > s.kex_quantum_bits THEN 'offer not confirmed' WHEN s.kex_quantum_bits >= 128 THEN 'cipher is the limit' ELSE 'classical key exchange' END AS why
FROM v_str s JOIN v_volume v ON v.sid = s.sid
""")
cte("v_algs", """
SELECT capture, label, peer AS subject, arg_min(struct_pack(t := type_id, tn := type_name, v := value_id, f := vendor_family), struct_pack(s := sid, o := ord)) AS x
FROM (SELECT n.*, s.peer, f.vendor_family FROM v_neg n JOIN v_str s ON s.sid = n.sid JOIN v_family f ON f.sid = n.sid WHERE NOT (n.type_id >= 6 AND n.value_id = 0)) GROUP BY capture, label, peer
""")
cte("v_pairs", """
SELECT DISTINCT capture, substr(capture, 1, 8) || (substr(capture, 9, 2)::INT // 2) AS pair, substr(capture, 9, 2)::INT % 2 = 0 AS is_a FROM v_captures
""")
cte("v_suite_info", """
SELECT c.capture, c.pair, c.is_a, x.version, x.cipher, x.prf, x.dh_group, x.dh_id, coalesce(f.class, 'None observed') AS esp, coalesce(e.exposed, 0) AS exposed FROM v_pairs c
JOIN (SELECT s.capture, s.version, max(CASE WHEN n.type_id = 1 THEN n.label END) AS cipher, max(CASE WHEN n.type_id = 2 THEN n.name END) AS prf,
   string_agg(CASE WHEN n.type_id = 4 AND n.ord < 10 OR n.type_id >= 6 AND n.value_id <> 0 THEN n.name END, ' + ' ORDER BY n.ord) AS dh_group,
   max(CASE WHEN n.type_id = 4 AND n.ord < 10 THEN n.value_id END) AS dh_id
  FROM v_str s JOIN (SELECT * FROM v_neg WHERE type_id >= 4 OR ord < 10) n ON n.sid = s.sid WHERE s.sid IN (SELECT min(sid) FROM v_sa GROUP BY capture) GROUP BY s.capture, s.version) x ON x.capture = c.capture
LEFT JOIN (SELECT capture, arg_max(class, struct_pack(p := packets, f := flow)) AS class FROM v_top GROUP BY capture) f ON f.capture = c.capture
LEFT JOIN (SELECT capture, sum((NOT quantum_safe)::INT)::BIGINT AS exposed FROM v_exposure GROUP BY capture) e ON e.capture = c.capture
""")

# --- hosts ----------------------------------------------------------------------------------
cte("v_wifi", """
SELECT *, CASE WHEN upper(authentication) LIKE '%OPEN%' OR encryption = 'None' THEN 0 WHEN authentication = 'WEP' THEN 1 WHEN encryption = 'TKIP' THEN 2 WHEN authentication LIKE 'WPA3%' THEN 4 ELSE 3 END AS rank FROM (
SELECT p_partkey // 40 AS host, CASE WHEN p_brand = 'Brand#1' THEN '' ELSE p_brand END AS ssid, lower(lpad(to_hex(p_partkey), 12, '0')) AS bssid, p_size * 2 AS signal_percent,
 CASE WHEN p_partkey % 2 = 0 THEN 1 + p_partkey % 11 ELSE 36 + 4 * (p_partkey % 8) END AS channel, CASE WHEN p_partkey % 2 = 0 THEN '2.4 GHz' ELSE '5 GHz' END AS band,
 CASE p_type WHEN 'ECONOMY' THEN 'Open' WHEN 'SMALL' THEN 'WEP' WHEN 'STANDARD' THEN 'WPA-Personal' WHEN 'MEDIUM' THEN 'WPA2-Personal' WHEN 'LARGE' THEN 'WPA2-Enterprise' ELSE 'WPA3-Personal' END AS authentication,
 CASE p_type WHEN 'ECONOMY' THEN 'None' WHEN 'SMALL' THEN 'WEP' WHEN 'STANDARD' THEN 'TKIP' ELSE 'CCMP' END AS encryption FROM part)
""")
cte("v_host", """
SELECT * EXCLUDE (rn), host % 7 <> 3 AS up FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY signal_percent DESC, bssid DESC) AS rn FROM v_wifi) WHERE rn = 1
""")
cte("v_ssid", """
SELECT w.host, lower(w.ssid) AS ssid_key, count(*) AS aps, max(w.rank) AS best, min(w.rank) AS worst, min(w.ssid) AS ssid, sum((w.rank < m.best)::INT)::BIGINT AS weak_aps, bool_or(coalesce(lower(h.ssid) = lower(w.ssid), false)) AS own
FROM v_wifi w JOIN (SELECT host, lower(ssid) AS k, max(rank) AS best FROM v_wifi GROUP BY ALL) m ON m.host = w.host AND m.k = lower(w.ssid) JOIN v_host h ON h.host = w.host WHERE w.ssid <> '' AND h.up GROUP BY w.host, lower(w.ssid) HAVING count(*) >= 2
""")
WIFI_SQL = {
    "WIFI-000": "SELECT host, 'info' AS severity, 0 AS delta FROM v_host WHERE NOT up",
    "WIFI-001": "SELECT host, 'critical' AS severity, -60 AS delta FROM v_host WHERE up AND rank = 0",
    "WIFI-002": "SELECT host, 'critical' AS severity, -50 AS delta FROM v_host WHERE up AND rank = 1",
    "WIFI-003": "SELECT host, 'high' AS severity, -30 AS delta FROM v_host WHERE up AND rank = 2",
    "WIFI-004": "SELECT host, 'medium' AS severity, -15 AS delta FROM v_host WHERE up AND rank = 3",
    "WIFI-005": "SELECT host, 'info' AS severity, 0 AS delta FROM v_host WHERE up AND rank = 4",
    "WIFI-010": "SELECT host, 'low' AS severity, -5 AS delta FROM v_host WHERE up AND signal_percent < 40",
    "WIFI-011": "SELECT host, 'info' AS severity, 0 AS delta FROM v_host WHERE up AND band = '2.4 GHz'",
    "WIFI-020": "SELECT host, CASE WHEN own THEN 'critical' ELSE 'high' END AS severity, CASE WHEN own THEN -35 ELSE 0 END AS delta FROM v_ssid WHERE worst < best",
    "WIFI-021": "SELECT host, 'info' AS severity, 0 AS delta FROM v_ssid WHERE worst = best AND own",
    "WIFI-030": "SELECT host, 'medium' AS severity, -5 AS delta FROM v_host WHERE up AND host % 3 = 0",
    "WIFI-031": "SELECT host, 'low' AS severity, 0 AS delta FROM v_host WHERE up AND host % 3 = 2",
    "WIFI-040": "SELECT host, 'info' AS severity, 0 AS delta FROM v_host WHERE up",
}
cte("v_wifi_findings", " UNION ALL ".join(f"SELECT host, '{r}' AS rule_id, severity, delta FROM ({s})" for r, s in WIFI_SQL.items()))
from ..adapters import ADAPTER_NAMES  # noqa: E402

cte("d_adapter", values([(i, *n.split("|")) for i, n in enumerate(ADAPTER_NAMES)], "n, name, description"))
cte("v_adapter", """
SELECT s_suppkey, s_suppkey // 3 AS host, s_suppkey % 3 AS idx, d.name, d.description, 10 + s_suppkey % 5 AS metric, s_suppkey % 8 <> 7 AS connected,
 CASE d.n WHEN 1 THEN 'WireGuard' WHEN 4 THEN 'OpenVPN' WHEN 5 THEN 'Cisco AnyConnect' WHEN 6 THEN 'IPsec / IKEv2' WHEN 8 THEN 'Generic VPN' WHEN 9 THEN 'ProtonVPN (WireGuard)' WHEN 10 THEN 'Tailscale' END AS vpn_type
FROM supplier JOIN d_adapter d ON d.n = (s_suppkey * 7 + s_nationkey) % 12
""")
cte("v_vpn", """
SELECT h.host, t.name, t.vpn_type, t.name IS NOT NULL AS connected, t.name IS NOT NULL AND NOT coalesce(t.has_dns, false) AND (h.host % 5 <> 0 OR w.n > 0) AS dns_leak,
 coalesce(t.has_dns, false) AS has_dns, t.name IS NOT NULL AND coalesce(r.iface = t.name, false) AS default_route
FROM (SELECT DISTINCT host FROM v_adapter) h
LEFT JOIN (SELECT a.*, a.name IN (SELECT name FROM v_adapter x WHERE x.host = a.host AND x.s_suppkey % 4 <> 1) AS has_dns
  FROM v_adapter a WHERE connected AND vpn_type IS NOT NULL AND idx = (SELECT min(idx) FROM v_adapter b WHERE b.host = a.host AND b.connected AND b.vpn_type IS NOT NULL)) t ON t.host = h.host
LEFT JOIN (SELECT host, arg_min(name, struct_pack(m := metric, n := name)) AS iface FROM v_adapter WHERE host % 2 = 0 OR name = 'Wi-Fi' GROUP BY host) r ON r.host = h.host
LEFT JOIN (SELECT host, count(*) AS n FROM v_adapter WHERE name = 'Wi-Fi' AND s_suppkey % 4 <> 1 GROUP BY host) w ON w.host = h.host
""")

# --- labels, windows --------------------------------------------------------------------------
cte("v_truth", "SELECT capture, src, dst, spi, flow, packets, truth, mode, loss, tfc, (spi - 4096) // 8 AS host FROM v_flows")
cte("v_matched", """
SELECT *, CASE WHEN host % 4 IN (0, 1) THEN 0 WHEN host % 4 = 2 THEN 1 END AS label_idx, CASE WHEN host % 4 = 3 THEN NULL WHEN host % 8 = 0 THEN 'ChaCha20-Poly1305' ELSE truth END AS label_suite FROM v_truth
""")
cte("v_scored", """
SELECT t.*, p.suite AS pred, sp.class AS pred_class, st.class AS true_class, sp.class = st.class AS hit, p.suite = t.truth AS exact, x.confidence FROM v_truth t
JOIN (SELECT flow, suite FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY failed IS NOT NULL, ord) AS rn FROM v_trace) WHERE rn = 1) p ON p.flow = t.flow
JOIN v_top x ON x.flow = t.flow JOIN d_suite st ON st.suite = t.truth JOIN d_class sp ON sp.class = x.class
""")
cte("v_sensor", """
SELECT user_id AS sensor, event_id AS frame, epoch_us(ts) AS ts_us, epoch_us(ts) // 86400000000 AS "window", 40 + floor(value * 8)::BIGINT AS length, event_id % 7 = 0 AS dropped FROM events
""")
# windows of 4 packets, 600 bytes or 21600 seconds, each starting where the one before has ended
cte("v_chain", """
WITH RECURSIVE p AS (SELECT sensor, ts_us, length, row_number() OVER w AS nth, sum(length) OVER w - length AS before FROM v_sensor WINDOW w AS (PARTITION BY sensor ORDER BY ts_us, frame)),
s AS (SELECT sensor, nth, ts_us, before FROM p WHERE nth = 1
 UNION ALL SELECT p.sensor, p.nth, p.ts_us, p.before FROM (
  SELECT s.sensor, min(p.nth) AS nth FROM s JOIN p ON p.sensor = s.sensor AND p.nth > s.nth AND (p.nth - s.nth >= 4 OR p.before - s.before >= 600 OR p.ts_us - s.ts_us >= 21600000000)
  GROUP BY s.sensor) n JOIN p ON p.sensor = n.sensor AND p.nth = n.nth),
t AS (SELECT sensor, count(*) AS n, sum(length) AS held FROM v_sensor GROUP BY sensor),
l AS (SELECT sensor, nth, ts_us, before, lead(nth) OVER w AS next, lead(before) OVER w AS until, row_number() OVER w - 1 AS "window" FROM s WINDOW w AS (PARTITION BY sensor ORDER BY nth)),
f AS (SELECT sensor, "window", ts_us AS start_us, coalesce(next, n + 1) - nth AS packets, (coalesce(until, held) - before)::BIGINT AS bytes, next IS NOT NULL AS followed FROM l JOIN t USING (sensor))
SELECT *, packets < 4 AND bytes >= 600 AS truncated, CASE WHEN packets >= 4 THEN 'packets' WHEN bytes >= 600 THEN 'bytes' WHEN followed THEN 'seconds' ELSE 'open' END AS closed_by FROM f
""")
cte("v_log", """
SELECT sensor, "window", sum((NOT dropped)::INT)::BIGINT AS packets, sum(dropped::INT)::BIGINT AS dropped, max(ts_us) AS completed_us FROM v_sensor GROUP BY ALL
""")
cte("d_overlayable", values(
    [(s, str(v)) for s, (a, k) in R.POLICY_FIELDS.items() for v in ((getattr(R.BASELINE_POLICY, a),) if k == "scalar" else getattr(R.BASELINE_POLICY, a))],
    "setting, key"))
