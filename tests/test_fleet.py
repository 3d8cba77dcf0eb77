"""Verdicts against a row-by-row fold, and the store's rules."""

import random

from pyspark.sql import functions as F

from veilgauge.operators import fleet as FT

DDL = ("id string, peer_key string, observed_us bigint, capture string, ike_version string, vendor_family string,"
       " classical_bits int, quantum_bits int, dh_group int, transforms array<string>")


def table(spark, rows):
    df = spark.createDataFrame([(f"{i:06d}", k, t, c, "IKEv2", "generic", b, q, 14, [f"T{b}"]) for i, (k, t, c, b, q) in enumerate(rows)], DDL)
    return df.withColumn("at", F.struct(F.col("observed_us").alias("first_us"), F.col("id").alias("sid")))


def fold(rows, k):
    """What a store that sees one row after another would say."""
    best, seen, out = {}, {}, []
    for key, _t, _c, bits, q in rows:
        seen.setdefault(key, []).append(bits)
        if key not in best:
            best[key] = (bits, q)
            out.append(("new", None))
            continue
        base, bq = best[key]
        if bits == base:
            out.append(("downgrade-quantum" if q < bq else "steady", base))
        elif bits < base:
            out.append(("downgrade", base))
        elif sum(b >= bits for b in seen[key]) >= k:
            out.append(("improvement", base))
            best[key] = (bits, q)
        else:
            out.append(("unconfirmed", base))
    return out, best


def test_verdicts_equal_the_fold(spark):
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "hot", "a|b", "c|d"]), 100 + i // 3, "cap", r.choice([56, 80, 112, 128, 192, 256]), r.choice([0, 64, 128])) for i in range(400)]
    df = table(spark, rows)
    for k in (1, 2, 3):
        want, best = fold(rows, k)
        got = {x.id: (x.verdict, x.baseline_bits) for x in FT.verdicts(df, k).collect()}
        assert [got[f"{i:06d}"] for i in range(len(rows))] == want
        assert {x.peer_key: (x.best_classical_bits, x.best_quantum_bits) for x in FT.baselines(df, k).collect()} == best


def test_downgrade_and_promotion(spark):
    rows = [("p", 1, "a", 128, 0), ("p", 2, "b", 80, 0), ("q", 1, "a", 128, 0), ("q", 2, "b", 192, 0), ("q", 3, "c", 192, 0)]
    v = {(x.peer_key, x.observed_us): x.verdict for x in FT.verdicts(table(spark, rows)).collect()}
    assert v == {("p", 1): "new", ("p", 2): "downgrade", ("q", 1): "new", ("q", 2): "unconfirmed", ("q", 3): "improvement"}


def test_new_peer_cap(spark):
    rows = [(f"peer{i:03d}", i, "flood", 128, 0) for i in range(70)]
    n = FT.new_peers(table(spark, rows), None, 64)
    assert n.where("withheld").count() == 6 and n.where("NOT withheld").count() == 64


def test_retention_keeps_protected_rows(spark):
    day = 86400 * 10 ** 6
    rows = [("busy", i * day // 100, "c", 192 if i == 0 else 128, 0) for i in range(600)] + [("quiet", 0, "old", 128, 0), ("ghost", 0, "old", 128, 0)]
    df = table(spark, rows)
    base = FT.baselines(df).where("peer_key <> 'ghost'")
    kept = FT.prune(df.withColumn("run", F.col("id").cast("int")), base, now_us=200 * day, keep=500, days=90, run="run").collect()
    ids = {x.id for x in kept}
    assert "000000" in ids  # behind the baseline
    assert any(x.peer_key == "quiet" for x in kept)  # newest row of a baselined link
    assert "000601" in ids  # the latest assessment wrote it (highest run), though it has no baseline
    assert len([x for x in kept if x.peer_key == "busy"]) < 600


def test_replay_truncates(spark):
    df = table(spark, [("p", i, "c", 128, 0) for i in range(12)])
    r = FT.replay(FT.verdicts(df), FT.baselines(df), limit=5).orderBy("pos").collect()
    assert [x.observed_us for x in r] == [7, 8, 9, 10, 11] and [x.pos for x in r] == [1, 2, 3, 4, 5] and all(x.truncated for x in r)
