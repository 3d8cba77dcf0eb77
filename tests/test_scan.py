"""Two-level ordered calculations equal the plain window, hot key or not."""

import random

import numpy as np
from pyspark.sql import Window as W, functions as F

from veilgauge.operators.posture import positioned
from veilgauge.operators.scan import exact_percentiles, ordered


def rows(n=600, seed=1):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.5 else f"k{r.randint(0, 5)}", i, r.randint(0, 1000)) for i in range(n)]


def test_ordered_equals_window(spark):
    df = spark.createDataFrame(rows(), "k string, frame bigint, v bigint")
    w = W.partitionBy("k").orderBy("frame")
    want = df.select(
        "k", "frame", F.row_number().over(w).alias("r"), F.lag("v").over(w).alias("l"),
        F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("m"), F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"))
    for size in (1, 7, 10_000):
        got = ordered(df, ["k"], [F.col("frame")], F.floor(F.col("frame") / size), rank="r", lag={"l": "v"}, max_before={"m": "v"}, sum_to={"s": "v"})
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_lag_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None), ("a", 4, 7)], "k string, frame bigint, v bigint")
    got = ordered(df, ["k"], [F.col("frame")], F.floor(F.col("frame") / 2), lag={"p": "v"})
    assert {r.frame: r.p for r in got.collect()} == {1: None, 2: None, 3: 5, 4: None}


def test_positions(spark):
    df = spark.createDataFrame(rows(300, 2), "k string, frame bigint, v bigint")
    want = df.withColumn("pos", F.row_number().over(W.partitionBy("k").orderBy(F.desc("v"), "frame")))
    got = positioned(df, ["k"], [F.desc("v"), F.asc("frame")], [-F.floor(F.col("v") / 100)])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_percentiles_match_numpy(spark):
    data = rows(500, 3)
    hist = spark.createDataFrame(data, "k string, frame bigint, v bigint").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    for width in (1, 64, 100_000):
        for r in exact_percentiles(hist, ["k"], "v", "n", probs, width).collect():
            values = [v for k, _f, v in data if k == r.k]
            for name, p in probs.items():
                assert abs(r[name] - np.percentile(values, p * 100)) < 1e-9
