"""Validation of the inference against known suites. `scored` has truth, pred, classes, hit, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .flows import KEYS
from .labels import class_of


def scored(ranked_top: DataFrame, classified: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per flow: truth, top suite and class, and whether they agree."""
    t = ranked_top.where("rank = 1").select(*KEYS, F.col("suite").alias("pred"))
    c = classified.select(*KEYS, "flow", F.col("class").alias("pred_class"), "confidence", "survivors")
    j = truth.join(t, KEYS).join(c, KEYS).withColumn("true_class", class_of(F.col("truth")))
    return j.withColumns({"hit": F.col("true_class") == F.col("pred_class"), "exact": F.col("truth") == F.col("pred")})


def confusion(s: DataFrame) -> DataFrame:
    return s.groupBy("true_class", "pred_class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("exact").cast("bigint")).alias("exact"))


def by_condition(s: DataFrame) -> DataFrame:
    """Accuracy by padding, by mode and by loss in one pass with GROUPING SETS."""
    g = s.groupingSets([[F.col("tfc")], [F.col("mode")], [F.col("loss")]], F.col("tfc"), F.col("mode"), F.col("loss")).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"))
    name = (F.when(F.col("tfc").isNotNull(), F.concat(F.lit("tfc="), F.col("tfc").cast("string")))
            .when(F.col("mode").isNotNull(), F.concat(F.lit("mode="), F.col("mode"))).otherwise(F.concat(F.lit("loss="), F.col("loss").cast("string"))))
    return g.select(name.alias("condition"), "n", "accuracy")


def mask_alone(trace: DataFrame, truth: DataFrame) -> DataFrame:
    """How far the constraints get without a model: resolved share, correct share, mean survivors."""
    left = F.when(F.col("eliminated_by").isNull(), F.col("class"))
    per = trace.groupBy(*KEYS).agg(
        F.count(left).alias("survivors"), F.count_distinct(left).alias("classes"), F.max(left).alias("only_class"))
    j = per.join(truth, KEYS).withColumn("true_class", class_of(F.col("truth")))
    one = F.col("classes") == 1
    right = one & (F.col("only_class") == F.col("true_class"))
    return j.agg(
        F.count(F.lit(1)).alias("n"), F.avg(one.cast("double")).alias("resolved"), F.avg(right.cast("double")).alias("correct"),
        F.sum((one & ~right).cast("bigint")).alias("wrong_when_resolved"), F.avg(F.col("survivors").cast("double")).alias("mean_survivors"))


def calibration(s: DataFrame, bins: int = 10) -> DataFrame:
    """Confidence bins with mean confidence and accuracy; ece is the weighted gap over all bins."""
    b = s.withColumn("bin", F.least(F.floor(F.round(F.col("confidence") * bins, 9)), F.lit(bins - 1)))
    t = b.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("hit").cast("double")).alias("accuracy"))
    # ten rows at most
    total = t.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))).alias("gap"))
    return t.join(F.broadcast(total)).select("bin", "n", "mean_confidence", "accuracy", (F.col("gap") / F.col("total")).alias("ece"))


def ablation(with_mask: DataFrame, without_mask: DataFrame) -> DataFrame:
    """Class and exact accuracy with and without the arithmetic."""
    a = with_mask.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("masked_class"), F.avg(F.col("exact").cast("double")).alias("masked_exact"))
    b = without_mask.agg(F.avg(F.col("hit").cast("double")).alias("raw_class"), F.avg(F.col("exact").cast("double")).alias("raw_exact"))
    return a.join(F.broadcast(b)).withColumn("mask_contribution", F.col("masked_class") - F.col("raw_class"))


def corpus_mix(samples: DataFrame) -> DataFrame:
    """What a training table holds: synthetic and real rows, real share, captures."""
    per = samples.groupBy("real", "capture").agg(F.count(F.lit(1)).alias("n"))
    c = per.agg(
        F.sum(F.when(~F.col("real"), F.col("n")).otherwise(0)).alias("synthetic_flows"),
        F.sum(F.when(F.col("real"), F.col("n")).otherwise(0)).alias("real_flows"), F.sum(F.col("real").cast("bigint")).alias("real_captures"))
    return c.withColumn("real_fraction", F.round(F.col("real_flows") / (F.col("real_flows") + F.col("synthetic_flows")), 4))
