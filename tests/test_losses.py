"""No row is lost to a bound: each case passes what once was a cap, a null-dropping join or a switch."""

import random
import struct

import numpy as np
from pyspark.sql import Window as W, functions as F

from veilgauge import registries as R
from veilgauge.functions.bytes import address_chunk, address_key, byte_entropy
from veilgauge.operators import fleet as FT, flows as FL, labels as LB, operations as OP, packets as P
from veilgauge.operators.posture import positioned
from veilgauge.operators.scan import frame_chunk, ordered
from veilgauge.operators.sessions import group_bits
from veilgauge.sources import sidecars as SC, sinks as SK

from .test_capture import chain, header, ike_rows, v2_sa
from .test_fleet import table


def test_null_keys_and_order_values_stay(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", None, 7), ("a", 3, None), ("a", 4, 9)], "k string, frame bigint, v bigint")
    got = ordered(df, ["k"], [F.col("frame")], frame_chunk(size=2), rank="r", lag={"l": "v"}, sum_to={"s": "v"})
    w = W.partitionBy("k").orderBy("frame")
    want = df.withColumns({"r": F.row_number().over(w).cast("bigint"), "l": F.lag("v").over(w), "s": F.sum("v").over(w)})
    assert sorted(map(str, got.select("k", "frame", "r", "l", "s").collect())) == sorted(map(str, want.select("k", "frame", "r", "l", "s").collect()))
    placed = positioned(df, ["k"], [F.asc("frame")], [F.floor(F.col("frame") / 2)]).collect()
    assert sorted((str(r.k), r.pos) for r in placed) == [("None", 1), ("None", 2), ("a", 1), ("a", 2), ("a", 3)]


def test_gaps_across_chunks(spark):
    r = random.Random(2)
    rows = [(c, "s", "d", 1, f, f + r.choice([0, 0, 5])) for c in ("x", None) for f in range(0, 400_000, 997)]
    df = spark.createDataFrame(rows, "capture string, src string, dst string, spi bigint, frame bigint, seq bigint")
    got = {x.capture: (x.packets, x.gaps) for x in FL.sequence_gaps(df).collect()}
    for c in ("x", None):
        s = [q for k, _, _, _, _, q in rows if k == c]
        assert got[c] == (len(s), sum(b != a + 1 for a, b in zip(s, s[1:])))
    plan = FL.sequence_gaps(df)._jdf.queryExecution().toString()
    assert plan.split("Physical Plan")[1].count("Exchange hashpartitioning") <= 4


def test_evidence_without_a_ceiling_and_without_times(spark):
    files = spark.createDataFrame([("d", f"window-{i}.pcap", 100 * i, 10, False) for i in range(1, 6)] + [("d", "window-x.pcap", None, 10, False)],
                                  "dir string, name string, mtime_us bigint, bytes bigint, protected boolean")
    names = lambda **k: sorted(r.name for r in OP.evidence_to_delete(files, **k).collect())
    assert names(keep=10, max_bytes=0) == []
    assert names(keep=5, max_bytes=0) == ["window-x.pcap"]
    assert names(keep=10, max_bytes=30) == ["window-1.pcap", "window-2.pcap", "window-x.pcap"]


def test_policy_with_many_groups():
    bits = group_bits(range(100))
    assert sorted(bits) == list(range(100)) and len(set(bits.values())) == 100 and all(b < 63 for _, b in bits.values())


def test_many_proposals_and_long_chains(spark):
    one = v2_sa()
    body = b"".join(struct.pack("!BBH", 2 if i < 39 else 0, 0, len(one)) + one[4:] for i in range(40))
    long = [(43, b"vendor %03d" % i) for i in range(90)] + [(40, b"n" * 32)]
    (f1, b1), (f2, b2) = chain([(33, body)]), chain(long)
    rows, _ = ike_rows(spark, [header(b1, f1), header(b2, f2)])
    assert len(rows[0].proposals) == 40 and not rows[0].parse_errors
    assert len(rows[1].vendor_ids) == 90 and rows[1].nonce_len == 32


def test_changes_of_a_link_with_many_observations(spark):
    df = table(spark, [("p", i, "c", 192 if i == 0 else 128, 0) for i in range(1500)])
    judged = FT.changes(FT.verdicts(df)).where("baseline_bits IS NOT NULL")
    assert judged.count() == 1499 and judged.where("removed = array('T192') AND added = array('T128')").count() == 1499


def test_withheld_links_are_recorded(spark):
    df = table(spark, [(f"p{i:02d}", i, "c", 128, 0) for i in range(70)])
    got = FT.withhold(FT.verdicts(df), df, None, 64).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"new": 64, "withheld": 6}


def test_rows_are_told_apart_by_capture_and_id(spark):
    day = 86400 * 10 ** 6
    df = table(spark, [("p", 300 * day, "new", 128, 0), ("q", 0, "old", 128, 0), ("q", day, "old", 128, 0)]).withColumn("id", F.lit("same"))
    kept = FT.prune(df, FT.baselines(df).where("peer_key = 'p'"), now_us=300 * day, keep=5, days=90).collect()
    assert [(r.capture, r.peer_key) for r in kept] == [("new", "p")]


def test_window_bounds(spark):
    df = spark.createDataFrame([("c", f, 100) for f in range(100)] + [(None, 5, 10)], "capture string, frame bigint, length bigint")
    got = {r.capture: (r.packets, r.bytes, r.truncated) for r in OP.close_windows(df, ["capture"], 50, 1000).collect()}
    assert got == {"c": (10, 1000, True), None: (1, 10, False)}


def test_flows_without_a_class_take_the_default_layout(spark):
    packets = spark.createDataFrame([("c", 1, 1, "a", "b", "esp", bytes(8) + bytes(100))], "capture string, frame bigint, ts_us bigint, src string, dst string, pkt_class string, payload binary")
    none = spark.createDataFrame([], "capture string, src string, dst string, spi bigint, class string")
    r = P.wire_samples(packets, none).first()
    assert (r.iv_bytes, r.icv_bytes, r.body_bytes, r.residue, r.expected) == (16, 16, 68, 100 % 16, 0)


def test_addresses_of_all_kinds_in_order(spark):
    want = ["9.0.0.1", "10.0.0.2", "10.1.0.0", "::1", "2001:db8::1", "2001:db8::a", "host-a", "host-b"]
    df = spark.createDataFrame([(a, "all") for a in reversed(want)], "addr string, net string").withColumn("key", address_key(F.col("addr")))
    got = positioned(df, ["net"], [F.asc("key")], address_chunk(F.col("key"))).collect()
    assert [r.addr for r in sorted(got, key=lambda r: r.pos)] == want


def test_entropy_of_many_values(spark):
    r = np.random.default_rng(1)
    values = [None, b""] + [bytes(r.integers(0, 1 + i % 256, 1 + i % 700, dtype=np.uint8)) for i in range(3000)]

    def plain(b):
        if not b:
            return 0.0 if b is not None else None
        c = np.bincount(np.frombuffer(b, np.uint8))
        p = c[c > 0] / len(b)
        return min(8.0, -(p * np.log2(p)).sum() + (len(p) - 1) / (2 * len(b) * np.log(2)))

    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, b binary").repartition(1).select("i", byte_entropy("b").alias("e")).collect()
    assert all((x.e is None) == (values[x.i] is None) and (x.e is None or abs(x.e - plain(values[x.i])) < 1e-9) for x in got)


def test_store_written_twice_counts_once_and_files_are_bounded(spark, tmp_path):
    df = table(spark, [(f"p{i % 3}", i, "c", 128, 0) for i in range(30)])
    path = str(tmp_path / "store")
    for version in (1, 2, 2):
        SK.write_fleet(path, version, FT.verdicts(df.where(f"observed_us % 2 = {version % 2}")), FT.baselines(df).withColumn("observations", F.lit(version)))
    (tmp_path / "store/baselines/version=9").mkdir()  # a run that broke off
    assert SK.complete_versions(spark, path) == [1, 2]
    assert SK.read_fleet(spark, path, "id string, verdict string").count() == 30
    assert {r.observations for r in SK.read_baselines(spark, path, "peer_key string, observations int").collect()} == {2}
    lines = spark.range(4000).repartition(16).selectExpr("concat('c', id % 3) AS capture", "'finding' AS part", "cast(id AS string) AS body")
    SK.write_inventory(str(tmp_path / "inv"), lines)
    assert all(len(list((tmp_path / f"inv/capture=c{i}/part=finding").glob("*.json"))) <= SK.FILES_PER_CAPTURE for i in range(3))


def test_class_of_the_most_probable_suite(spark):
    from veilgauge.operators.framing import classify_flows

    many = max(R.FRAMING_CLASSES, key=lambda c: len(R.FRAMING_CLASSES[c][0]))
    other = next(c for c in R.FRAMING_CLASSES if c != many)
    base = dict(capture="c", src="a", dst="b", spi=1, flow="f", packets=99, survivors=5, fallback=False, entropy_samples=0, mean_entropy=None, distinct_lengths=9)
    rows = [base | {"class": many, "ord": i, "prob": 0.1} for i in range(4)] + [base | {"class": other, "ord": 7, "prob": 0.3}]
    df = spark.createDataFrame(rows, "capture string, src string, dst string, spi bigint, flow string, packets bigint, survivors bigint, fallback boolean, entropy_samples bigint,"
                                     " mean_entropy double, distinct_lengths bigint, class string, ord int, prob double")
    r = classify_flows(df).first()
    assert r["class"] == other and abs(r.confidence - 0.3) < 1e-9


def test_unreadable_and_empty_sidecars_are_reported(spark, tmp_path):
    (tmp_path / "bad.pcap.label.json").write_text('{"source": "x", "flows": [')
    (tmp_path / "none.pcap.label.json").write_text('{"source": "x"}')
    (tmp_path / "empty.pcap.label.json").write_text('{"source": "x", "flows": []}')
    got = {r.capture: (r.idx, r.problem) for r in LB.validate(SC.read_labels(spark, str(tmp_path))).collect()}
    assert got == {"bad.pcap": (None, "not JSON"), "none.pcap": (None, "no flows"), "empty.pcap": (None, "no flows")}


def test_busiest_of_many_flows(spark):
    flows = spark.range(20_000).selectExpr("'c' AS capture", "concat('s', id) AS src", "'d' AS dst", "id AS spi", "(id * 7919) % 20011 AS packets", "0L AS last_us")
    got = {r.packets for r in FL.busiest(flows, 3000).collect()}
    assert got == set(sorted((i * 7919 % 20011 for i in range(20_000)), reverse=True)[:3000])
