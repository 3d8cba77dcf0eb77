"""Registered queries: packets, flows and framing."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import flows as FL, framing as FR, packets as P
from ..functions import framing as FF
from .catalog import query
from .stage import fresh, staged

FLOW_ORDER = "capture, src, dst, spi"


# --- packets ----------------------------------------------------------------------
@query("pkt_classify", "SELECT capture, frame, pkt_class FROM v_raw_class")
def _(spark, d):
    return P.classify(A.raw_packets(spark, d)).select("capture", "frame", "pkt_class")


@query("pkt_filter_ipsec", "SELECT capture, frame, protocol, sport, dport FROM v_raw WHERE shape <> 7")
def _(spark, d):
    return P.ipsec_only(A.raw_packets(spark, d)).select("capture", "frame", "protocol", "sport", "dport")


@query("live_event_kind", """
SELECT capture, CASE pkt_class WHEN 'ike' THEN 'IKE' WHEN 'esp' THEN 'ESP' WHEN 'esp_natt' THEN 'UDP-ESP' ELSE 'OTHER' END AS kind,
  count(*) AS packets, sum(length(hexed) // 2)::BIGINT AS payload_bytes FROM v_raw_class GROUP BY ALL""")
def _(spark, d):
    return P.event_kind(A.raw_packets(spark, d)).groupBy("capture", "kind").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.octet_length("payload").cast("bigint")).alias("payload_bytes"))


@query("pkt_cap", """
SELECT capture, count(*) AS packets, max(frame) AS last_frame FROM (
  SELECT *, row_number() OVER (PARTITION BY capture ORDER BY frame) AS rn FROM v_raw) WHERE rn <= 500 GROUP BY capture""")
def _(spark, d):
    return P.first_packets(A.raw_packets(spark, d), 500).groupBy("capture").agg(
        F.count(F.lit(1)).alias("packets"), F.max("frame").alias("last_frame"))


@query("capture_stats", """
SELECT coalesce(r.capture, i.capture) AS capture, coalesce(packets_read, 0) AS packets_read, coalesce(ike_messages, 0) AS ike_messages, coalesce(esp_packets, 0) AS esp_packets,
  coalesce(other_packets, 0) AS other_packets, capture_seconds, coalesce(t.tracked, 0) AS flows_tracked, coalesce(t.assessed, 0) AS flows_assessed,
  coalesce(ike_sessions, 0) AS ike_sessions, coalesce(parse_errors, 0) AS parse_errors FROM (
SELECT capture, count(*) AS packets_read, sum((pkt_class = 'ike')::INT)::BIGINT AS ike_messages,
  sum((pkt_class LIKE 'esp%')::INT)::BIGINT AS esp_packets, sum((pkt_class IN ('other', 'keepalive'))::INT)::BIGINT AS other_packets,
  round((max(ts_us) - min(ts_us)) / 1e6, 3) AS capture_seconds FROM v_raw_class GROUP BY capture) r
LEFT JOIN (SELECT capture, count(*) AS tracked, sum((n >= 8)::INT)::BIGINT AS assessed FROM (
  SELECT capture, src, dst, substr(hexed, 1, 8) AS spi, count(*) AS n FROM v_raw_class WHERE pkt_class LIKE 'esp%' GROUP BY ALL) GROUP BY capture) t ON t.capture = r.capture
FULL JOIN (SELECT capture, count(*) AS ike_sessions, sum(CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END)::BIGINT AS parse_errors FROM v_sa GROUP BY capture) i ON i.capture = r.capture""")
def _(spark, d):
    from ..operators.posture import capture_stats
    from .session_queries import sess

    return capture_stats(P.classify(A.raw_packets(spark, d)), sessions=sess(spark, d))


@query("throughput", """
SELECT capture, packets_read, packets_read >= 1000 AS measurable,
  CASE WHEN packets_read >= 1000 THEN round(packets_read / (packets_read * 0.001e0), 1) END AS packets_per_second
FROM (SELECT capture, count(*) AS packets_read FROM v_raw GROUP BY capture)""")
def _(spark, d):
    from ..operators.posture import throughput

    stats = A.raw_packets(spark, d).groupBy("capture").agg(F.count(F.lit(1)).alias("packets_read"))
    stats = stats.withColumn("processing_seconds", F.col("packets_read") * 0.001)
    return throughput(stats, min_packets=1000).select("capture", "packets_read", "measurable", "packets_per_second")


@query("pkt_headers", """
SELECT capture, frame, ts_us, src, dst, protocol, CASE WHEN protocol = 17 THEN sport ELSE 0 END AS sport,
  CASE WHEN protocol = 17 THEN dport ELSE 0 END AS dport, hexed AS payload_hex FROM v_raw""")
def _(spark, d):
    return P.decode_headers(A.frames(spark, d)).select(
        "capture", "frame", "ts_us", "src", "dst", "protocol", "sport", "dport", F.hex("payload").alias("payload_hex"))


@query("ip_text", """
SELECT event_id AS id, '10.' || (user_id % 256) || '.' || (event_id % 256) || '.' || (event_id // 256 % 256) AS v4,
  '2001:db8::' || lower(to_hex(1 + event_id % 65535)) AS v6 FROM events""")
def _(spark, d):
    from ..functions.bytes import ipv4, ipv6

    e = A.table(spark, d, "events").selectExpr(
        "event_id AS id",
        "unhex(concat('0A', lpad(hex(user_id % 256), 2, '0'), lpad(hex(event_id % 256), 2, '0'), lpad(hex(event_id div 256 % 256), 2, '0'))) AS b4",
        "unhex(concat('20010DB8', repeat('00', 10), lpad(hex(1 + event_id % 65535), 4, '0'))) AS b6")
    return e.select("id", ipv4(F.col("b4"), 1).alias("v4"), ipv6(F.col("b6"), 1).alias("v6"))


@query("hex_rows", """
SELECT doc_id, i * 16 AS "offset", lower(rtrim(regexp_replace(row, '(..)', '\\1 ', 'g'))) AS hex,
  array_to_string(list_transform(regexp_extract_all(row, '..'), lambda x: CASE WHEN x >= '20' AND x <= '7E' THEN chr(('0x' || x)::INT) ELSE '.' END), '') AS ascii
FROM (SELECT doc_id, i, substr(h, i * 32 + 1, 32) AS row FROM (SELECT doc_id, h, unnest(range((length(h) + 31) // 32)) AS i FROM (
  SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE length(text) > 0)))""")
def _(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return P.hex_rows(docs, "doc_id", "data")


@query("fn_entropy", """
SELECT doc_id, round(least(8e0, h + (m - 1) / (2e0 * n * ln(2e0))), 6) AS entropy FROM (
 SELECT doc_id, n, count(*) AS m, -sum(c / n * log2(c / n)) AS h FROM (
  SELECT doc_id, x, count(*)::DOUBLE AS c, any_value(n)::DOUBLE AS n FROM (
   SELECT doc_id, len(b) AS n, unnest(b) AS x FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents))
  GROUP BY doc_id, x) GROUP BY doc_id, n)""")
def _(spark, d):
    from ..functions.bytes import byte_entropy

    docs = A.table(spark, d, "documents").where(F.length("text") > 0)
    return docs.select("doc_id", F.round(byte_entropy(F.encode("text", "UTF-8")), 6).alias("entropy"))


@query("fn_entropy_all", """
SELECT d.doc_id, CASE WHEN length(d.text) = 0 THEN 0e0 ELSE e.entropy END AS entropy FROM documents d LEFT JOIN (
 SELECT doc_id, round(least(8e0, h + (m - 1) / (2e0 * n * ln(2e0))), 6) AS entropy FROM (
  SELECT doc_id, n, count(*) AS m, -sum(c / n * log2(c / n)) AS h FROM (
   SELECT doc_id, x, count(*)::DOUBLE AS c, any_value(n)::DOUBLE AS n FROM (
    SELECT doc_id, len(b) AS n, unnest(b) AS x FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents))
   GROUP BY doc_id, x) GROUP BY doc_id, n)) e ON e.doc_id = d.doc_id""")
def _(spark, d):
    """Every document: 0 for an empty text, null for none."""
    from ..functions.bytes import byte_entropy

    return A.table(spark, d, "documents").select("doc_id", F.round(byte_entropy(F.encode("text", "UTF-8")), 6).alias("entropy"))


@query("fn_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))


@query("wire_samples", """
SELECT r.capture, r.src, r.dst, ('0x' || substr(hexed, 1, 8))::BIGINT AS spi, nth, frame, frame AS seq, n AS length, c.iv AS iv_bytes,
  greatest(n - c.iv - c.icv, 0) AS body_bytes, c.icv AS icv_bytes, n % c.block AS residue, (c.iv + c.icv) % c.block AS expected,
  n % c.block = (c.iv + c.icv) % c.block AS residue_ok, false AS looks_encrypted
FROM (SELECT *, length(hexed) // 2 - 8 AS n, row_number() OVER (PARTITION BY capture, src, dst, substr(hexed, 1, 8) ORDER BY frame) AS nth FROM v_raw_class WHERE pkt_class LIKE 'esp%') r
 JOIN (VALUES (0, 8::BIGINT, 12::BIGINT, 8::BIGINT), (1, 8, 16, 16), (2, 16, 12, 16), (3, 16, 16, 16)) c(kind, iv, icv, block) ON c.kind = ('0x' || substr(r.hexed, 1, 8))::BIGINT % 4
WHERE nth <= 3""")
def _(spark, d):
    """Flows of three known classes and flows without one."""
    classed = P.classify(A.raw_packets(spark, d))
    spis = classed.where(F.col("pkt_class").isin("esp", "esp_natt")).select(
        "capture", "src", "dst", P.uint(F.col("payload"), 1, 4).alias("spi")).distinct()
    classes = spis.where("spi % 4 < 3").withColumn("class", F.when(F.col("spi") % 4 == 0, "64-bit block cipher").when(
        F.col("spi") % 4 == 1, "AEAD or counter mode").otherwise("AES-CBC with 96-bit ICV"))
    samples = P.wire_samples(classed, classes)
    return samples.withColumns({c: F.col(c).cast("bigint") for c in ("iv_bytes", "icv_bytes", "residue", "expected")})


# --- flows --------------------------------------------------------------------------
@query("esp_flows", """
SELECT capture, src, dst, spi, flow, packets, round((last_us - first_us) / 1e6, 6) AS seconds, encapsulated, bytes, min_length,
  distinct_lengths, entropy_samples, round(bytes / packets, 6) AS mean_payload FROM v_flows""")
def _(spark, d):
    return FL.esp_flows(A.esp_packets(spark, d)).select(
        "capture", "src", "dst", "spi", "flow", "packets", F.round("seconds", 6).alias("seconds"), "encapsulated", "bytes",
        "min_length", "distinct_lengths", "entropy_samples", F.round(F.col("bytes") / F.col("packets"), 6).alias("mean_payload"))


@query("flow_min_packets", """
SELECT packets >= 100 AS assessed, count(*) AS flows, sum(packets)::BIGINT AS packets FROM v_flows GROUP BY 1""")
def _(spark, d):
    f = FL.esp_flows(A.esp_packets(spark, d))
    return f.groupBy((F.col("packets") >= 100).alias("assessed")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum("packets").alias("packets"))


@query("len_residues", """
SELECT f.capture, f.src, f.dst, f.spi, m.modulus, r.residue, count(p.frame) AS packets FROM v_flows f, (VALUES (4), (8), (16)) m(modulus)
JOIN (SELECT unnest(range(16)) AS residue) r ON r.residue < m.modulus
LEFT JOIN v_packets p ON p.capture = f.capture AND p.src = f.src AND p.dst = f.dst AND p.spi = f.spi AND p.length % m.modulus = r.residue
GROUP BY ALL""")
def _(spark, d):
    return FL.length_residues(A.esp_packets(spark, d))


@query("len_granularity", """
SELECT flow, granularity, distinct_lengths, distinct_lengths >= 8 AND granularity > 0 AS usable FROM v_flows""")
def _(spark, d):
    return FL.esp_flows(A.esp_packets(spark, d)).select(
        "flow", "granularity", "distinct_lengths", ((F.col("distinct_lengths") >= 8) & (F.col("granularity") > 0)).alias("usable"))


@query("flow_entropy", "SELECT flow, entropy_samples, round(mean_entropy, 6) AS mean_entropy FROM v_flows")
def _(spark, d):
    return FL.esp_flows(A.esp_packets(spark, d)).select("flow", "entropy_samples", F.round("mean_entropy", 6).alias("mean_entropy"))


@query("seq_gaps", """
SELECT capture, src, dst, spi, count(*) AS packets, sum(CASE WHEN seq <> prev + 1 THEN 1 ELSE 0 END)::BIGINT AS gaps FROM (
  SELECT *, lag(seq) OVER (PARTITION BY capture, src, dst, spi ORDER BY frame) AS prev FROM v_packets_seq) GROUP BY ALL""")
def _(spark, d):
    return FL.sequence_gaps(A.esp_packets_seq(spark, d))


@query("inter_arrivals", """
SELECT capture, src, dst, spi, frame, ts_us - latest AS iat_us FROM (
  SELECT *, max(ts_us) OVER (PARTITION BY capture, src, dst, spi ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM v_packets)
WHERE ts_us >= latest""")
def _(spark, d):
    return FL.inter_arrivals(A.esp_packets(spark, d))


@query("sample_caps", """
SELECT capture, src, dst, spi, count(*) AS lengths_kept, sum(length)::BIGINT AS bytes_kept,
  count(CASE WHEN nth <= 20 THEN entropy END) AS entropy_kept FROM (
 SELECT *, count(entropy) OVER (PARTITION BY capture, src, dst, spi ORDER BY frame) AS nth FROM (
  SELECT *, row_number() OVER (PARTITION BY capture, src, dst, spi ORDER BY frame) AS rn FROM v_packets) WHERE rn <= 60) GROUP BY ALL""")
def _(spark, d):
    return FL.sample_caps(A.esp_packets(spark, d), max_samples=60, max_entropy=20)


@query("flow_evict", """
SELECT capture, flow, packets FROM (
 SELECT *, row_number() OVER (PARTITION BY host ORDER BY packets DESC, last_us DESC, src, dst, spi) AS rn FROM (
  SELECT *, substr(capture, 1, 7) AS host FROM v_flows)) WHERE rn <= 3""")
def _(spark, d):
    f = FL.esp_flows(A.esp_packets(spark, d)).withColumn("site", F.col("capture"))
    return FL.busiest(f.withColumn("capture", F.substring("capture", 1, 7)), 3).select(F.col("site").alias("capture"), "flow", "packets")


@query("flow_evict_batched", """
SELECT capture, src, dst, spi, packets, last_us FROM (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY packets DESC, last_us DESC, src, dst, spi) AS rn FROM (
 SELECT substr(capture, 1, 7) AS capture, src, dst, spi, count(*) AS packets, max(ts_us) AS last_us FROM v_packets GROUP BY ALL)) WHERE rn <= 3""")
def _(spark, d):
    """The busiest flows of every site by bounded tables with batched eviction, then counted exactly."""
    from ..operators.eviction import busiest_bounded

    p = A.esp_packets(spark, d).withColumn("capture", F.substring("capture", 1, 7))
    return busiest_bounded(p, 3, max_flows=64, root=fresh(spark, "eviction"))


@query("flows_sort", """
SELECT capture, flow, packets, row_number() OVER (PARTITION BY substr(capture, 1, 7) ORDER BY packets DESC, flow) AS pos FROM v_flows""")
def _(spark, d):
    from ..operators.posture import positioned

    f = FL.esp_flows(A.esp_packets(spark, d)).select(F.substring("capture", 1, 7).alias("site"), "capture", "flow", "packets")
    return positioned(f, ["site"], [F.desc("packets"), F.asc("flow")], [-F.floor(F.log2("packets"))]).select(
        "capture", "flow", "packets", "pos")


_SHARES = {**{f"mod{m}_{i}": f"avg((length % {m} = {i})::INT)" for m in (16, 8, 4) for i in range(m)},
           **{f"lenhist_{i}": f"avg((least(floor(least(length, 1600) * 36 / 1600e0), 35) = {i})::INT)" for i in range(36)}}
# decimals compared, 4 where none are stated
_DIGITS = {"entropy_std": 3, "iat_mean": 3, "iat_std": 2, "iat_p50": 3, "packet_rate": 6, "log_packets": 6}
_FEATURE_SQL = {
    **{c: c for c in [*_SHARES, "len_mean", "len_std", "len_p25", "len_p50", "len_p75", "len_p90", "len_unique_ratio", "small_pkt_ratio", "mtu_pkt_ratio",
                      "entropy_mean", "entropy_std", "entropy_min", "iat_mean", "iat_std", "iat_p50", "burstiness"]},
    "len_min": "lo::DOUBLE", "len_max": "hi::DOUBLE", "len_range": "(hi - lo)::DOUBLE", "len_gcd": "list_reduce(ls, lambda a, b: gcd(a, b))::DOUBLE",
    "len_delta_gcd": "list_reduce(list_prepend(0, list_transform(ls, lambda x: x - lo)), lambda a, b: gcd(a, b))::DOUBLE",
    "iat_cv": "iat_std / iat_mean", "packet_rate": "n / dur", "log_packets": "ln(1 + n)"}


@query("flow_features", f"""
WITH lens AS (SELECT capture, src, dst, spi, avg(length) AS len_mean, stddev_pop(length) AS len_std, quantile_cont(length, 0.25) AS len_p25,
   quantile_cont(length, 0.5) AS len_p50, quantile_cont(length, 0.75) AS len_p75, quantile_cont(length, 0.9) AS len_p90,
   count(DISTINCT length) / count(*) AS len_unique_ratio, min(length) AS lo, max(length) AS hi, list(DISTINCT length) AS ls,
   avg((length < 128)::INT) AS small_pkt_ratio, avg((length > 1300)::INT) AS mtu_pkt_ratio,
   coalesce(avg(entropy), 0) AS entropy_mean, coalesce(stddev_pop(entropy), 0) AS entropy_std, coalesce(min(entropy), 0) AS entropy_min,
   {", ".join(f"{sql} AS {name}" for name, sql in _SHARES.items())}, count(*) AS n, (max(ts_us) - min(ts_us)) / 1e6 AS dur FROM v_packets GROUP BY ALL),
 gaps AS (SELECT capture, src, dst, spi, (ts_us - latest) / 1e6 AS iat FROM (
   SELECT *, max(ts_us) OVER (PARTITION BY capture, src, dst, spi ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM v_packets)
   WHERE ts_us >= latest),
 iats AS (SELECT capture, src, dst, spi, avg(iat) AS iat_mean, stddev_pop(iat) AS iat_std, quantile_cont(iat, 0.5) AS iat_p50,
   avg((iat < m * 0.25e0)::INT) AS burstiness FROM (SELECT *, avg(iat) OVER (PARTITION BY capture, src, dst, spi) AS m FROM gaps) GROUP BY ALL)
SELECT capture, src, dst, spi, {", ".join(f"round(({_FEATURE_SQL[c]})::DOUBLE, {_DIGITS.get(c, 4)}) AS {c}" for c in FL.FEATURES)}
FROM lens JOIN iats USING (capture, src, dst, spi)""")
def _(spark, d):
    f = FL.flow_features(A.esp_packets(spark, d), fresh(spark, "gaps"))
    return f.select(*FL.KEYS, *[F.round(c, _DIGITS.get(c, 4)).alias(c) for c in FL.FEATURES])


# --- framing -------------------------------------------------------------------------
def _flows(spark, d):
    return staged(spark, d, "flows", lambda: FL.esp_flows(A.esp_packets(spark, d)))


def _trace(spark, d):
    return FR.framing_trace(_flows(spark, d))


@query("framing_trace", """
SELECT flow, suite, boundary, expected_residue, round(agree, 6) AS residue_agreement, failed AS eliminated_by, step FROM v_trace""")
def _(spark, d):
    return _trace(spark, d).select("flow", "suite", "boundary", "expected_residue",
                                   F.round("residue_agreement", 6).alias("residue_agreement"), "eliminated_by", "step")


@query("suite_cross", "SELECT flow, suite, boundary, expected_residue, overhead FROM v_trace")
def _(spark, d):
    return _trace(spark, d).select("flow", "suite", "boundary", "expected_residue", "overhead")


@query("framing_notes", """
SELECT flow, kind, test FROM (
SELECT flow, unnest([CASE WHEN NOT (d >= 8 AND g > 0) THEN 'skipped|granularity' END, CASE WHEN e IS NULL THEN 'skipped|entropy' END,
  CASE WHEN n = 0 THEN 'fallback|' END, CASE WHEN c > 1 THEN 'unresolved|' END]) AS x, split_part(x, '|', 1) AS kind, split_part(x, '|', 2) AS test FROM (
SELECT flow, max(distinct_lengths) AS d, max(granularity) AS g, max(mean_entropy) AS e, sum((failed IS NULL)::INT) AS n,
  count(DISTINCT CASE WHEN failed IS NULL THEN class END) AS c FROM v_trace GROUP BY flow)) WHERE x IS NOT NULL""")
def _(spark, d):
    return FR.framing_notes(_trace(spark, d)).select("flow", "kind", "test")


@query("framing_classes", """
SELECT t.flow, t.class, count(*) AS alive, any_value(c.n_members) AS members, any_value(c.n_members) = 1 AS separable
FROM v_trace t JOIN d_class c ON c.class = t.class WHERE failed IS NULL GROUP BY t.flow, t.class""")
def _(spark, d):
    return FR.surviving_classes(_trace(spark, d)).select("flow", "class", "alive", "members", "separable")


@query("class_of_suite", """
SELECT truth AS suite, s.class, c.signature, c.verdict, count(*) AS packets FROM v_packets p JOIN d_suite s ON s.suite = p.truth
JOIN d_class c ON c.class = s.class GROUP BY ALL""")
def _(spark, d):
    per = A.esp_packets(spark, d).groupBy(F.col("truth").alias("suite")).agg(F.count(F.lit(1)).alias("packets"))
    return FR.with_class(per).select("suite", "class", "signature", "verdict", "packets")


@query("fn_inseparable", """
SELECT t.flow, t.class, CASE WHEN c.n_members = 1 THEN 'single member' ELSE c.n_members || ' members share iv ' || min(s.iv) || ', icv ' || min(s.icv)
  || ', boundary ' || min(s.boundary) END AS why FROM v_trace t JOIN d_class c ON c.class = t.class JOIN d_suite s ON s.class = t.class
WHERE t.failed IS NULL GROUP BY t.flow, t.class, c.n_members""")
def _(spark, d):
    return FR.surviving_classes(_trace(spark, d)).select("flow", "class", FR.why_inseparable().alias("why"))


@query("ml_mask", """
SELECT flow, suite, round(CASE WHEN kept_sum <= 0 THEN p ELSE CASE WHEN failed IS NULL THEN p ELSE 0e0 END / kept_sum END, 6) AS prob, kept_sum <= 0 AS fallback FROM (
 SELECT *, sum(CASE WHEN failed IS NULL THEN p ELSE 0e0 END) OVER (PARTITION BY flow) AS kept_sum FROM (
  SELECT *, (ord + 1) / 45e0 AS p FROM v_trace))""")
def _(spark, d):
    t = _trace(spark, d)
    prior = t.select(*FL.KEYS, "suite", ((F.col("ord") + 1) / 45.0).alias("prob"))
    return FR.mask_probabilities(t, prior).select("flow", "suite", F.round("prob", 6).alias("prob"), "fallback")


@query("ml_group_conf", """
SELECT flow, class, round(sum(prob), 6) AS mass, round(max(prob), 6) AS top, count(*) > 1 AND sum(prob) - max(prob) > 0.12e0 AS ambiguous FROM (
 SELECT flow, class, CASE WHEN n = 0 THEN 1e0 / 9 WHEN failed IS NULL THEN 1e0 / n ELSE 0e0 END AS prob FROM (
  SELECT *, sum((failed IS NULL)::INT) OVER (PARTITION BY flow) AS n FROM v_trace)) GROUP BY flow, class""")
def _(spark, d):
    p = FR.mask_probabilities(_trace(spark, d))
    return p.groupBy("flow", "class").agg(
        F.round(F.sum("prob"), 6).alias("mass"), F.round(F.max("prob"), 6).alias("top"),
        ((F.count(F.lit(1)) > 1) & (F.sum("prob") - F.max("prob") > 0.12)).alias("ambiguous"))


@query("suite_rank", """
SELECT flow, suite, rank, round(prob, 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY prob DESC, ord) AS rank FROM (
 SELECT flow, suite, ord, CASE WHEN n = 0 THEN 1e0 / 9 WHEN failed IS NULL THEN 1e0 / n ELSE 0e0 END AS prob FROM (
  SELECT *, sum((failed IS NULL)::INT) OVER (PARTITION BY flow) AS n FROM v_trace))) WHERE rank <= 3""")
def _(spark, d):
    return FR.ranked_suites(FR.mask_probabilities(_trace(spark, d))).select("flow", "suite", "rank", F.round("prob", 6).alias("prob"))


@query("flow_class", """
SELECT t.flow, t.packets, t.class, round(t.confidence, 6) AS confidence, c.verdict, t.survivors FROM v_top t JOIN d_class c ON c.class = t.class""")
def _(spark, d):
    return flow_classes(spark, d).select("flow", "packets", "class", F.round("confidence", 6).alias("confidence"), "verdict", "survivors")


def flow_classes(spark, d):
    return staged(spark, d, "flow_classes", lambda: _flow_classes(spark, d))


def _flow_classes(spark, d):
    return FR.classify_flows(FR.mask_probabilities(_trace(spark, d)))


@query("fn_boundary", """
SELECT flow, suite, boundary, expected_residue AS residue, min_length >= overhead + 4 AS holds FROM v_trace""")
def _(spark, d):
    t = _trace(spark, d)
    from ..registries import SUITES

    dims = F.create_map(*[F.lit(x) for s, v in SUITES.items() for x in (s, ",".join(map(str, v)))])
    part = F.split(dims[F.col("suite")], ",")
    b, iv, icv = (part[i].cast("int") for i in range(3))
    return t.select("flow", "suite", FF.boundary(b).alias("boundary"), FF.residue(iv, icv, b).alias("residue"),
                    (F.col("min_length") >= iv + icv + 4).alias("holds"))


@query("fn_cipher_len", """
SELECT event_id, s.suite, (s.iv + ceil((40 + floor(value) + 2) / s.boundary::DOUBLE) * s.boundary + s.icv)::BIGINT AS length
FROM events CROSS JOIN d_suite s""")
def _(spark, d):
    from ..registries import SUITES

    suites = F.array(*[F.struct(F.lit(s).alias("suite"), F.lit(b).alias("b"), F.lit(iv).alias("iv"), F.lit(icv).alias("icv"))
                       for s, (b, iv, icv) in SUITES.items()])
    e = A.table(spark, d, "events").select("event_id", F.floor("value").alias("v"), F.explode(suites).alias("s"))
    return e.select("event_id", "s.suite", FF.cipher_len(F.lit(40) + F.col("v"), F.col("s.b"), F.col("s.iv"), F.col("s.icv")).alias("length"))


@query("fn_flow_key", "SELECT DISTINCT flow FROM v_flows")
def _(spark, d):
    p = A.esp_packets(spark, d).select("src", "dst", "spi").distinct()
    return p.select(FF.flow_name(F.col("src"), F.col("dst"), F.col("spi")).alias("flow"))
