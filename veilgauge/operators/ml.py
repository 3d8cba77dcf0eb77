"""Learned ranking of suites: two library models, blended, then masked by the arithmetic."""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from .. import registries as R
from .flows import FEATURES, KEYS, SHARE_NAMES
from .scan import ordered

FEATURE_VERSION = 1
FOREST_SHARE = 0.55
SUITE_INDEX = {s: i for i, s in enumerate(R.SUITES)}


def schema_hash() -> str:
    return hashlib.sha256(json.dumps([FEATURE_VERSION, FEATURES]).encode()).hexdigest()


def with_label(features: DataFrame, truth: DataFrame) -> DataFrame:
    index = F.create_map(*[F.lit(x) for s, i in SUITE_INDEX.items() for x in (s, float(i))])
    return features.join(truth.select(*KEYS, "truth"), KEYS).withColumn("label", index[F.col("truth")])


def stratified(rows: DataFrame, test_share: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Train and test rows: the same share of every label, to the row, the test rows first in the order of a hash of the flow key.

    A label of two rows or more has at least one in either part; a single row is for training.
    """
    n, rank, order = F.col("label_rows"), F.col("label_rank"), F.col("label_order")
    ranked = ordered(rows.withColumn("label_order", F.xxhash64("label", *KEYS)), ["label"], [order, *map(F.col, KEYS)], F.shiftright(order, 52), rank="label_rank")
    sizes = rows.groupBy(F.col("label").alias("label_of")).agg(F.count(F.lit(1)).alias("label_rows"))
    wanted = F.least(F.greatest(F.floor(n * test_share + 0.5), F.lit(1)), n - 1)
    dealt = ranked.join(F.broadcast(sizes), F.col("label").eqNullSafe(F.col("label_of")))
    return tuple(dealt.where(x).select(*rows.columns) for x in (rank > wanted, rank <= wanted))


def fit_ranker(train: DataFrame, seed: int = 42, trees: int = 300, depth: int = 30, epochs: int = 60) -> PipelineModel:
    """Forest on all 88 features with class weights, perceptron on the 64-value length profile.

    A depth of 30 is the library's greatest; trees stop at pure leaves long before.
    """
    sizes = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))  # nine rows
    total = sizes.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    weights = sizes.join(F.broadcast(total)).select("label", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))
    data = train.join(F.broadcast(weights), "label")
    n = len(SUITE_INDEX)
    return Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="all_features", handleInvalid="keep"),
        VectorAssembler(inputCols=SHARE_NAMES, outputCol="profile", handleInvalid="keep"),
        RandomForestClassifier(featuresCol="all_features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed,
                               probabilityCol="p_forest", rawPredictionCol="r_forest", predictionCol="c_forest"),
        MultilayerPerceptronClassifier(featuresCol="profile", labelCol="label", layers=[len(SHARE_NAMES), 32, n], maxIter=epochs, seed=seed,
                                       probabilityCol="p_second", rawPredictionCol="r_second", predictionCol="c_second"),
    ]).fit(data)


def suite_probabilities(model: PipelineModel, features: DataFrame, forest_share: float = FOREST_SHARE) -> DataFrame:
    """(flow keys, suite, prob): 0.55 forest + 0.45 second model."""
    s = model.transform(features)
    names = list(SUITE_INDEX)
    forest, second = vector_to_array("p_forest"), vector_to_array("p_second")

    def at(arr, i):  # a model trained without the last suites has shorter vectors
        return F.coalesce(F.get(arr, F.lit(i)), F.lit(0.0))

    blend = F.array(*[F.struct(F.lit(n).alias("suite"), (at(forest, i) * forest_share + at(second, i) * (1 - forest_share)).alias("prob"))
                      for i, n in enumerate(names)])
    return s.select(*KEYS, F.inline(blend))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)
    model_spark().createDataFrame([(schema_hash(),)], "features string").write.mode("overwrite").json(f"{path}/schema_guard")


def model_spark():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def load_model(path: str) -> PipelineModel:
    """Refuses a model trained on another feature list."""
    stored = model_spark().read.json(f"{path}/schema_guard").first()["features"]
    if stored != schema_hash():
        raise ValueError("model was trained on a different feature schema")
    return PipelineModel.load(path)


def leave_one_capture_out(samples: DataFrame, folds: list[str], predict) -> DataFrame:
    """Class hits of every held-out fold. `predict(train, test)` returns (flow keys, class)."""
    from .labels import class_of

    out = None
    for fold in folds:  # one model per fold; folds are few
        train, test = samples.where(F.col("fold") != fold), samples.where(F.col("fold") == fold)
        r = predict(train, test).join(test.select(*KEYS, "truth", "fold"), KEYS).groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.sum((F.col("class") == class_of(F.col("truth"))).cast("bigint")).alias("hits"))
        out = r if out is None else out.unionByName(r)
    return out


# --- leave-one-capture-out, every capture by itself ---------------------------------------
def forest_group(capture: str = "capture", forests: int = 6):
    """Which of the groups 0 .. forests - 1 a capture belongs to, by digest."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(capture)), 1, 8), 16, 10).cast("bigint"), F.lit(forests)).cast("int")


def unseen_by(samples: DataFrame, forests: int = 6, left_out: int = 2) -> DataFrame:
    """One row per sample and forest that never sees its capture: forest g leaves out the captures of groups g .. g + left_out - 1."""
    steps = F.array(*[F.lit(i) for i in range(left_out)])
    return samples.withColumn("forest", F.explode(F.transform(steps, lambda i: F.pmod(forest_group(forests=forests) - i, F.lit(forests)))))


def grouped_forests(samples: DataFrame, forests: int = 6, left_out: int = 2, trees: int = 50, depth: int = 30, seed: int = 42) -> DataFrame:
    """(flow keys, suite, prob): every flow ranked by the trees that never saw its capture, and by no others.

    One forest of forests * trees trees whose sample is drawn by capture, not by
    flow: `trees` of them at a time are grown without the captures of
    `left_out` groups. A capture is thus scored by left_out * trees trees, at
    the price of one forest instead of one model per capture.
    """
    names, out = list(SUITE_INDEX), None
    inputs = VectorAssembler(inputCols=FEATURES, outputCol="all_features", handleInvalid="keep")
    group = forest_group(forests=forests)
    for g in range(forests):  # a fixed number of fits, whatever the number of captures
        hidden = F.pmod(group - g, F.lit(forests)) < left_out
        train, test = samples.where(~hidden), samples.where(hidden)
        forest = RandomForestClassifier(featuresCol="all_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed + g, probabilityCol="p_forest")
        p = vector_to_array("p_forest")
        votes = Pipeline(stages=[inputs, forest]).fit(train).transform(test).select(*KEYS, F.inline(F.array(*[
            F.struct(F.lit(n).alias("suite"), F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)).alias("prob")) for i, n in enumerate(names)])))
        out = votes if out is None else out.unionByName(votes)
    return out.groupBy(*KEYS, "suite").agg(F.avg("prob").alias("prob"))
