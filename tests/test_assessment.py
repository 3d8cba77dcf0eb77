"""What belongs to one assessment: its rows, its exit code, its statistics, its held-out score."""

from pyspark.sql import functions as F

from tests.test_fleet import table
from veilgauge.operators import fleet as FT, ml as ML, posture as PO
from veilgauge.streaming import monitor as MO

DAY = 86400 * 10 ** 6


def test_all_rows_of_the_latest_assessment_are_kept(spark):
    rows = [("a", 0, "old", 128, 0), ("b", 5 * DAY, "last", 128, 0), ("c", 6 * DAY, "last", 112, 0), ("d", 7 * DAY, "last", 80, 0), ("e", 1 * DAY, "old", 80, 0)]
    df = table(spark, rows)
    none = FT.baselines(df).where("peer_key = 'nobody'")
    kept = FT.prune(df, none, now_us=400 * DAY, keep=5, days=90).collect()
    assert sorted(r.peer_key for r in kept) == ["b", "c", "d"]  # one capture, three times
    numbered = df.withColumn("run", F.when(F.col("capture") == "old", 9).otherwise(4))
    kept = FT.prune(numbered, none, now_us=400 * DAY, keep=5, days=90, run="run").collect()
    assert sorted(r.peer_key for r in kept) == ["a", "e"]  # the clock was set back: the run says which is latest


def test_exit_codes(spark):
    v = FT.verdicts(table(spark, [("p", 1, "a", 128, 64), ("p", 2, "b", 128, 0), ("p", 3, "c", 80, 0)]))
    scores = spark.createDataFrame([("a", 90), ("b", 59), ("c", 10), ("d", 60), ("e", 0), ("f", None)], "capture string, score int")
    code = {r.capture: r.exit_code for r in MO.alerts(v, scores, 60).collect()}
    assert code == {"a": 0, "b": 2, "c": 3, "d": 0, "e": 2, "f": 0}
    assert {r.exit_code for r in MO.alerts(v, scores).collect()} == {0, 3} == {r.exit_code for r in MO.alerts(v, scores, 0).collect()}


def test_capture_statistics_with_sessions(spark):
    packets = spark.createDataFrame([("a", 1, 10 ** 6, "s", "d", "ike", b""), ("a", 2, 3 * 10 ** 6, "s", "d", "esp", b"abcdefgh")],
                                    "capture string, frame bigint, ts_us bigint, src string, dst string, pkt_class string, payload binary")
    sessions = spark.createDataFrame([("a", 0), ("a", 3), ("b", 1)], "capture string, parse_errors bigint")
    got = {r.capture: r for r in PO.capture_stats(packets, sessions=sessions).collect()}
    assert (got["a"].ike_sessions, got["a"].parse_errors, got["a"].packets_read, got["a"].capture_seconds) == (2, 3, 2, 2.0)
    assert (got["b"].ike_sessions, got["b"].parse_errors, got["b"].packets_read, got["b"].capture_seconds) == (1, 1, 0, None)


def test_no_tree_scores_a_capture_that_it_was_grown_on(spark):
    s = spark.range(500).select(F.concat(F.lit("c"), F.col("id")).alias("capture"))
    scored = ML.unseen_by(s)
    group = F.pmod(ML.forest_group() - F.col("forest"), F.lit(6))
    assert scored.where(group >= 2).count() == 0  # group >= 2: the forest was grown on it
    assert scored.groupBy("capture").count().where("count <> 2").count() == 0
    assert [r["count"] > 30 for r in s.groupBy(ML.forest_group()).count().collect()] == [True] * 6
