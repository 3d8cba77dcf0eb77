"""Side files, sinks and the fleet store."""

import json

import pytest

from tests.test_fleet import DDL, table
from veilgauge import registries as R
from veilgauge.operators import fleet as FT, labels as LB, operations as OP
from veilgauge.sources import sidecars as SC, sinks as SK

FINDINGS = "capture string, rule_id string, title string, severity string, subject string, inferred boolean"


def test_label_sidecar(spark, tmp_path):
    flows = [{"suite": "ChaCha20-Poly1305", "spi": "0x10"}, {"suite": "nope", "spi": "11"}, {"suite": "ChaCha20-Poly1305", "peers": ["a", "a"]},
             {"suite": "ChaCha20-Poly1305", "spi": "10"}, {"suite": "ChaCha20-Poly1305"}, {"suite": "ChaCha20-Poly1305", "peers": ["a", "b"]}]
    (tmp_path / "x.pcap.label.json").write_text(json.dumps({"source": "gateway", "flows": flows}, indent=1))
    got = {r.idx: (r.capture, r.spi, r.problem) for r in LB.validate(SC.read_labels(spark, str(tmp_path))).collect()}
    assert [got[i][2] for i in range(6)] == [None, "unknown suite", "peers are not two addresses", "spi labelled twice", "one of spi or peers", None]
    assert got[0][:2] == ("x.pcap", 16)


def test_spi_entry_wins_over_peers(spark):
    f = spark.createDataFrame([("c", "a", "b", 7), ("c", "b", "a", 8)], "capture string, src string, dst string, spi bigint")
    l = spark.createDataFrame([("c", 0, None, None, "b", "a", "S-peers", "x"), ("c", 1, 7, None, None, None, "S-spi", "x")],
                              "capture string, idx int, spi bigint, dst string, peer_a string, peer_b string, suite string, source string")
    assert {r.spi: r.label_suite for r in LB.match(f, l).collect()} == {7: "S-spi", 8: "S-peers"}


def test_overlay_file(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"name": "directive", "DH_PROHIBITED": {"14": "too small"}, "MIN_KEY_BITS": 256, "DH_PQ_GROUPS": [35, 40]}))
    rows = SC.read_overlay(spark, str(tmp_path / "o.json"))
    assert OP.check_overlay(rows).where("problem IS NOT NULL").count() == 0
    p = SC.overlay_policy(rows)
    assert 14 in p.dh_prohibited and p.min_key_bits == 256 and 40 in p.dh_pq
    (tmp_path / "bad.json").write_text(json.dumps({"ENCR_FORBIDDEN": {"X": "y"}}))
    with pytest.raises(ValueError):
        SC.overlay_policy(SC.read_overlay(spark, str(tmp_path / "bad.json")))
    merged = OP.merge_policy(OP.policy_table(spark), rows.select("setting", "key"))
    assert [r.key for r in merged.where("setting = 'MIN_KEY_BITS'").collect()] == ["256"]
    assert merged.where("setting = 'DH_PROHIBITED'").count() == len(R.BASELINE_POLICY.dh_prohibited) + 1


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("a", "IKE-001", "t", "high", "x <-> y", False), ("a", "IKE-007", "u", "medium", "x <-> y", False)], FINDINGS)
    caps = spark.createDataFrame([("a",), ("b",)], "capture string")
    SK.append_audit_log(str(tmp_path / "log"), caps, f)
    SK.append_audit_log(str(tmp_path / "log"), caps, f)
    log = spark.read.json(str(tmp_path / "log"))
    assert log.count() == 4 and log.where("capture = 'b'").first().score == 100 and "detail" not in log.columns
    SK.write_report(str(tmp_path / "rep"), {"finding": f, "capture": caps})
    assert spark.read.json(str(tmp_path / "rep")).where("capture = 'a' AND part = 'finding'").count() == 2
    m = SK.export_dataset(str(tmp_path / "ds"), caps, f)
    assert {r.capture: r.grade for r in m.collect()}["b"] == "A"


def test_fleet_store(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = DDL + ", verdict string"
    assert SK.read_fleet(spark, path, schema).count() == 0 and not (tmp_path / "store").exists()
    o = table(spark, [("p", 1, "a", 128, 0), ("p", 2, "b", 80, 0)])
    SK.write_fleet(path, 1, FT.verdicts(o), FT.baselines(o))
    assert sorted(r.verdict for r in SK.read_fleet(spark, path, schema).collect()) == ["downgrade", "new"]


def test_inventory_lines(spark, tmp_path):
    from veilgauge.operators import inventory as IN
    from veilgauge.plans import all_queries
    from veilgauge.plans.flow_queries import flow_classes
    from veilgauge.plans.session_queries import findings, strong

    all_queries()
    d = "/root/testdata/sf0.001"
    s = strong(spark, d)
    lines = SK.component_lines(IN.protocols(s), IN.algorithms(s), IN.esp_assets(flow_classes(spark, d)), IN.vulnerabilities(findings(spark, d)))
    SK.write_inventory(str(tmp_path / "inv"), lines)
    one = json.loads(lines.where("part = 'component'").first().body)
    assert one["type"] == "cryptographic-asset" and one["bom-ref"].startswith("crypto:")
    assert spark.read.json(str(tmp_path / "inv")).count() == lines.count()


def test_rate_guard_equals_plain_window(spark):
    from pyspark.sql import Window as W, functions as F

    e = spark.range(400).selectExpr("id % 3 AS k", "id * 777777 % 90000000 AS ts", "id")
    w = W.partitionBy("k").orderBy("ts").rangeBetween(-9_999_999, 0)
    want = {r.id: r.n for r in e.withColumn("n", F.count(F.lit(1)).over(w)).collect()}
    assert {r.id: r.recent for r in OP.rate_guard(e, "k", "ts", 5, 10).collect()} == want
