"""Strength, scores and grouping on worked values."""

import pytest

from veilgauge import adapters as A, registries as R
from veilgauge.operators import framing as FR, flows as FL, posture as PO, strength as ST


def strength_of(spark, items, confirmed=True):
    rows = [(confirmed, [tuple(t) for t in A.transform_rows(items)])]
    df = spark.createDataFrame(rows, f"confirmed boolean, transforms array<{A.TRANSFORM_DDL}>")
    return ST.session_strength(df).first()


def test_weakest_link(spark):
    s = strength_of(spark, [(1, 12, "ENCR_AES_CBC", 256), (2, 2, "PRF_HMAC_SHA1", None), (3, 2, "AUTH_HMAC_SHA1_96", None), (4, 2, None, None)])
    assert (s.classical_bits, s.quantum_bits, s.grade) == (80, 0, "deprecated")


def test_hybrid(spark):
    items = [(1, 20, "ENCR_AES_GCM_16", 256), (2, 7, "PRF_HMAC_SHA2_512", None), (4, 31, None, None), (6, 36, None, None)]
    s = strength_of(spark, items)
    assert (s.kex_bits, s.kex_quantum_bits, s.quantum_bits, s.hybrid, s.kex_family) == (192, 192, 128, True, "ecp+ml-kem")
    offer = strength_of(spark, items, confirmed=False)
    assert (offer.quantum_bits, offer.kex_quantum_bits, offer.uncredited) == (0, 0, True)


def test_unused_slot_and_no_proposal(spark):
    s = strength_of(spark, [(1, 20, "ENCR_AES_GCM_16", 256), (4, 31, None, None), (6, 36, None, None), (6, 0, None, None)])
    assert (s.kex_quantum_bits, s.hybrid) == (0, False)
    assert strength_of(spark, []).kex_family == "unknown"


GOLDEN = [((6, 3, 4, 0), 10), ((1, 1, 5, 2), 27), ((0, 1, 4, 2), 48), ((0, 0, 1, 0), 85), ((0, 0, 0, 0), 100)]


def test_scores(spark):
    rows, caps = [], []
    for i, (counts, _s) in enumerate(GOLDEN):
        caps.append((f"c{i}",))
        for sev, n in zip(("critical", "high", "medium", "low"), counts):
            rows += [(f"c{i}", "IKE-001", "t", sev, f"s{j}", False) for j in range(n)]
    f = spark.createDataFrame(rows, "capture string, rule_id string, title string, severity string, subject string, inferred boolean")
    got = {r.capture: r.score for r in PO.posture(spark.createDataFrame(caps, "capture string"), f).collect()}
    assert got == {f"c{i}": s for i, (_c, s) in enumerate(GOLDEN)}


def test_digest_streams_hot_captures(spark):
    import hashlib

    rows = [("big", "IKE-001", f"a{i % 50}") for i in range(500)] + [("small", "IKE-002", "x")]
    f = spark.createDataFrame(rows, "capture string, rule_id string, subject string")
    got = {r.capture: r.digest for r in PO.report_digest(f).collect()}
    raw = "|".join(sorted(f"IKE-001:a{i % 50}" for i in range(500)))
    assert got == {"big": hashlib.sha256(raw.encode()).hexdigest()[:16], "small": hashlib.sha256(b"IKE-002:x").hexdigest()[:16]}


def packets(spark, suite, inners, entropy=7.9):
    b, iv, icv = R.SUITES[suite]
    pad = max(b, 4)
    rows = [("c", i, i * 1000, "a", "b", 1, iv + -(-(n + 2) // pad) * pad + icv, entropy, False) for i, n in enumerate(inners)]
    return spark.createDataFrame(rows, "capture string, frame bigint, ts_us bigint, src string, dst string, spi bigint, length bigint, entropy double, encapsulated boolean")


@pytest.mark.parametrize("suite", list(R.SUITES))
def test_true_suite_survives(spark, suite):
    p = packets(spark, suite, [40 + 37 * i % 1400 for i in range(60)], 5.0 if suite.startswith("NULL") else 7.9)
    t = {r.suite: r.eliminated_by for r in FR.framing_trace(FL.esp_flows(p)).collect()}
    assert t[suite] is None
    assert {R.CLASS_OF_SUITE[s] for s, e in t.items() if e is None} == {R.CLASS_OF_SUITE[suite]}


def test_skipped_tests_and_fallback(spark):
    few = FR.framing_trace(FL.esp_flows(packets(spark, "ChaCha20-Poly1305", [40] * 10, None)))
    assert {(r.kind, r.test) for r in FR.framing_notes(few).collect()} >= {("skipped", "granularity"), ("skipped", "entropy")}
    odd = spark.createDataFrame([("c", i, i, "a", "b", 1, 101 + 2 * i, None, False) for i in range(20)], packets(spark, "ChaCha20-Poly1305", [1]).schema)
    trace = FR.framing_trace(FL.esp_flows(odd))
    assert {r.kind for r in FR.framing_notes(trace).collect()} >= {"fallback"}
    assert FR.classify_flows(FR.mask_probabilities(trace)).first().fallback


def test_gaps(spark):
    rows = [("c", i, i, "a", "b", 1, s) for i, s in enumerate([1, 2, 3, 9, 10, 11, 40, 41])]
    df = spark.createDataFrame(rows, "capture string, frame bigint, ts_us bigint, src string, dst string, spi bigint, seq bigint")
    assert FL.sequence_gaps(df).first().gaps == 2


def test_volume_any_endpoint_never_counts_twice(spark):
    f = spark.createDataFrame([("c", "a", "b", 10, 1.0), ("c", "b", "a", 20, 2.0), ("c", "a", "x", 40, 3.0), ("c", "y", "z", 80, 9.0), ("c", "a", "a", 100, 4.0)],
                              "capture string, src string, dst string, bytes bigint, seconds double")
    s = spark.createDataFrame([("c", "1", "a", "b"), ("c", "2", "x", "q"), ("c", "3", "q", "r"), ("c", "4", "a", "a")], "capture string, sid string, peer_a string, peer_b string")
    got = {r.sid: (r.observed_bytes, r.observed_seconds) for r in ST.attribute_volume(s, f).collect()}
    assert got == {"1": (170, 4.0), "2": (40, 3.0), "3": (0, 0.0), "4": (170, 4.0)}
    pair = {r.sid: r.observed_bytes for r in ST.attribute_volume(s, f, "pair").collect()}
    assert pair == {"1": 30, "2": 0, "3": 0, "4": 100}


def test_policy_overlay_changes_verdict():
    p = R.BASELINE_POLICY.overlay({"DH_PROHIBITED": ["14"], "MIN_KEY_BITS": 256})
    assert 14 in p.dh_prohibited and 2 in p.dh_prohibited and p.min_key_bits == 256
    assert R.BASELINE_POLICY.overlay({"DH_PROHIBITED": ["14"]}, replace_tables=True).dh_prohibited == (14,)


def test_evidence_is_a_row_per_field_that_has_a_value(spark):
    rows = [("c", "R-1", "a", '{"x":"1","y":null}'), ("c", "R-2", "b", "{}"), (None, "R-3", None, None), ("c", "R-1", "a", '{"x":"1","y":null}')]
    got = PO.evidence_fields(spark.createDataFrame(rows, "capture string, rule_id string, subject string, evidence string")).collect()
    assert [tuple(r) for r in got] == [("c", "R-1", "a", "x", "1")] * 2
    assert PO.evidence_fields(spark.createDataFrame([], "capture string, rule_id string, subject string, evidence string")).count() == 0


def test_positions_by_range_move_rows_once(spark, tmp_path):
    """Equal rows are dropped and rows numbered where range partitioning has put them; nulls and keys of many pieces too."""
    from pyspark.sql import functions as F

    from veilgauge.operators.posture import positioned_by_range

    names = [("hot" if i % 3 else None if i % 2 else f"k{i % 5}", f"n{i * 7919 % 3000:05d}") for i in range(6000)]
    df = spark.createDataFrame(names, "k string, name string")
    got = positioned_by_range(df, ["k"], [F.asc("name")], str(tmp_path), partitions=12, distinct=True)
    plan = df._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan
    wanted = {}
    for k, name in sorted(set(names), key=lambda r: (str(r[0]), r[1])):
        wanted.setdefault(k, []).append(name)
    rows = got.collect()
    assert len(rows) == len(set(names)) and all(wanted[r.k][r.pos - 1] == r.name for r in rows)
    spans = [len(spark.read.parquet(str(p)).where("k = 'hot'").select("_part").distinct().collect()) for p in tmp_path.iterdir() if "_part" in spark.read.parquet(str(p)).columns]
    assert spans and max(spans) > 4


def test_a_digest_moves_its_keys_once(spark):
    import hashlib

    from veilgauge.operators.posture import report_digest

    rows = [(f"c{i % 3}", f"R-{i % 4}", f"s{i % 50}") for i in range(900)]
    digests = report_digest(spark.createDataFrame(rows, "capture string, rule_id string, subject string"))
    assert digests._sc._jvm.PythonSQLUtils.explainString(digests._jdf.queryExecution(), "simple").count("Exchange hashpartitioning") == 1
    wanted = {c: hashlib.sha256("|".join(sorted(f"{r}:{s}" for x, r, s in rows if x == c)).encode()).hexdigest()[:16] for c in ("c0", "c1", "c2")}
    assert {r.capture: r.digest for r in digests.collect()} == wanted
