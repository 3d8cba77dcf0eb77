"""Cipher class from length arithmetic: which suites a flow's lengths rule out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import registries as R
from .flows import KEYS


def suite_rows():
    """The nine suites as an array of structs; nine rows per flow, never per packet."""
    return F.array(*[
        F.struct(
            F.lit(s).alias("suite"), F.lit(o).alias("ord"), F.lit(R.CLASS_OF_SUITE[s]).alias("class"),
            F.lit(max(b, 4)).alias("boundary"), F.lit((iv + icv) % max(b, 4)).alias("expected_residue"),
            F.lit(iv + icv).alias("overhead"), F.col(f"agree_{max(b, 4)}_{(iv + icv) % max(b, 4)}").alias("agreeing"))
        for o, (s, (b, iv, icv)) in enumerate(R.SUITES.items())])


def framing_trace(flows: DataFrame) -> DataFrame:
    """Flow x suite with the first constraint that eliminates the suite, if any."""
    t = flows.withColumn("s", F.explode(suite_rows())).select(
        *[c for c in flows.columns if not c.startswith("agree_")], "s.*")
    share = F.when(F.col("packets") > 0, F.col("agreeing") / F.col("packets"))
    usable = (F.col("distinct_lengths") >= R.MIN_DISTINCT) & (F.col("granularity") > 0)
    null_suite = F.col("suite").startswith("NULL")
    failed = (
        F.when(usable & (F.col("granularity") != F.col("boundary")), "granularity")
        .when(share < R.RESIDUE_SHARE, "residue")
        .when(F.col("min_length") < F.col("overhead") + 4, "overhead")
        .when(F.col("mean_entropy").isNotNull() & ~null_suite & (F.col("mean_entropy") < R.ENTROPY_FLOOR), "entropy")
        .when(F.col("mean_entropy").isNotNull() & null_suite & (F.col("mean_entropy") > R.ENTROPY_CEILING), "entropy"))
    t = t.withColumn("residue_agreement", share).withColumn("eliminated_by", failed).drop("agreeing")
    reason = (
        F.when(F.col("eliminated_by") == "granularity", F.concat(
            F.lit("lengths step by "), F.col("granularity"), F.lit(", suite pads to "), F.col("boundary")))
        .when(F.col("eliminated_by") == "residue", F.concat(
            F.format_number(F.col("residue_agreement") * 100, 0), F.lit("% of lengths leave "), F.col("expected_residue"),
            F.lit(" modulo "), F.col("boundary")))
        .when(F.col("eliminated_by") == "overhead", F.concat(
            F.lit("shortest length "), F.col("min_length"), F.lit(" is below "), F.col("overhead") + 4))
        .when(F.col("eliminated_by") == "entropy", F.concat(
            F.lit("mean entropy "), F.format_number("mean_entropy", 2), F.lit(" does not fit"))))
    step = F.create_map(*[F.lit(x) for kv in R.CONSTRAINT_STEP.items() for x in kv])
    return t.withColumn("step", step[F.col("eliminated_by")]).withColumn("reason", reason)


def survivors_of(trace: DataFrame) -> DataFrame:
    """Trace plus the number of suites left standing, without a second scan."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*KEYS)
    return trace.withColumn("survivors", F.sum(F.col("eliminated_by").isNull().cast("int")).over(w))


def mask_probabilities(trace: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Prior suite probabilities with eliminated suites set to zero and the rest renormalised.

    `prior` has (flow keys, suite, prob); a flat prior is used without one. When
    nothing survives the prior is kept and `fallback` is set. Windows run over
    the nine suite rows of a flow.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*KEYS)
    t = survivors_of(trace)
    if prior is None:
        t = t.withColumn("prior", F.lit(1.0 / len(R.SUITES)))
    else:
        t = t.join(prior.select(*KEYS, "suite", F.col("prob").alias("prior")), [*KEYS, "suite"], "left").fillna(0.0, ["prior"])
    t = t.withColumn("kept", F.when(F.col("eliminated_by").isNull(), F.col("prior")).otherwise(0.0))
    mass = F.sum("kept").over(w)
    fallback = (F.col("survivors") == 0) | (mass <= 0)
    return (t.withColumn("fallback", fallback)
            .withColumn("prob", F.when(fallback, F.col("prior")).otherwise(F.try_divide(F.col("kept"), mass)))
            .drop("kept"))


def classify_flows(probs: DataFrame) -> DataFrame:
    """Class of the most probable suite per flow, the mass of that class, and ambiguity; ties go to the first suite."""
    per_class = probs.groupBy(*KEYS, "flow", "class").agg(
        F.sum("prob").alias("mass"), F.min_by("ord", F.struct(-F.round("prob", 9), "ord")).alias("ord"), F.max("prob").alias("top"), F.max("packets").alias("packets"),
        F.max("survivors").alias("survivors"), F.max("fallback").alias("fallback"),
        F.max("entropy_samples").alias("entropy_samples"), F.max("mean_entropy").alias("mean_entropy"),
        F.max("distinct_lengths").alias("distinct_lengths"), F.count(F.lit(1)).alias("members"))
    best = F.struct(F.round("top", 9), -F.col("ord"), F.struct("class", "mass", "members", "top"))
    # at most five class rows per flow
    flows = per_class.groupBy(*KEYS, "flow").agg(
        F.max(best).alias("b"), F.max("packets").alias("packets"), F.max("survivors").alias("survivors"),
        F.max("fallback").alias("fallback"), F.max("entropy_samples").alias("entropy_samples"),
        F.max("mean_entropy").alias("mean_entropy"), F.max("distinct_lengths").alias("distinct_lengths"))
    pick = F.col("b")["col3"]
    verdict = F.create_map(*[F.lit(x) for c, (_m, _s, v) in R.FRAMING_CLASSES.items() for x in (c, v)])
    return flows.select(
        *KEYS, "flow", "packets", pick["class"].alias("class"), pick["mass"].alias("confidence"),
        pick["top"].alias("suite_confidence"),
        ((pick["members"] > 1) & (pick["mass"] - pick["top"] > 0.12)).alias("ambiguous"),
        verdict[pick["class"]].alias("verdict"), "survivors", "fallback", "entropy_samples", "mean_entropy", "distinct_lengths")


def ranked_suites(probs: DataFrame, top: int = 3) -> DataFrame:
    """Best suites per flow; nine rows per flow, so the rank window is small."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*KEYS).orderBy(F.desc("prob"), F.asc("ord"))
    return probs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def framing_notes(trace: DataFrame) -> DataFrame:
    """Which tests could not run, whether anything survived, whether classes remain open."""
    per = trace.groupBy(*KEYS, "flow").agg(
        F.max("packets").alias("packets"), F.max("distinct_lengths").alias("distinct_lengths"),
        F.max("granularity").alias("granularity"), F.max("mean_entropy").alias("mean_entropy"),
        F.sum(F.col("eliminated_by").isNull().cast("int")).alias("survivors"),
        F.count_distinct(F.when(F.col("eliminated_by").isNull(), F.col("class"))).alias("classes"))
    usable = (F.col("distinct_lengths") >= R.MIN_DISTINCT) & (F.col("granularity") > 0)
    return per.select(*KEYS, "flow", F.explode(F.array_compact(F.array(
        F.when(~usable, F.struct(F.lit("skipped").alias("kind"), F.lit("granularity").alias("test"))),
        F.when(F.col("mean_entropy").isNull(), F.struct(F.lit("skipped").alias("kind"), F.lit("entropy").alias("test"))),
        F.when(F.col("survivors") == 0, F.struct(F.lit("fallback").alias("kind"), F.lit("").alias("test"))),
        F.when(F.col("classes") > 1, F.struct(F.lit("unresolved").alias("kind"), F.lit("").alias("test"))),
    ))).alias("n")).select(*KEYS, "flow", "n.kind", "n.test")


def surviving_classes(trace: DataFrame) -> DataFrame:
    """Classes with a member left, how many members, and whether lengths could ever split them."""
    sizes = F.create_map(*[F.lit(x) for c, (m, _s, _v) in R.FRAMING_CLASSES.items() for x in (c, len(m))])
    return trace.where(F.col("eliminated_by").isNull()).groupBy(*KEYS, "flow", "class").agg(
        F.count(F.lit(1)).alias("alive")).withColumn("members", sizes[F.col("class")]).withColumn(
        "separable", F.col("members") == 1)


def with_class(rows: DataFrame, suite: str = "suite") -> DataFrame:
    """Adds class, signature and verdict of a suite; rows of unknown suites have nulls."""
    known = [(s, c, R.FRAMING_CLASSES[c][1], R.FRAMING_CLASSES[c][2]) for s, c in R.CLASS_OF_SUITE.items()]
    dim = rows.sparkSession.createDataFrame(known, "known_suite string, class string, signature string, verdict string")
    return rows.join(F.broadcast(dim), F.col(suite) == F.col("known_suite"), "left").drop("known_suite")  # the suites of the catalogue


def why_inseparable(of_class: str = "class"):
    """What the members of a class share, so that lengths cannot tell them apart."""
    text = {}
    for c, (members, _signature, _verdict) in R.FRAMING_CLASSES.items():
        block, iv, icv = R.SUITES[members[0]]
        text[c] = "single member" if len(members) == 1 else f"{len(members)} members share iv {iv}, icv {icv}, boundary {max(block, 4)}"
    return F.create_map(*[F.lit(x) for kv in text.items() for x in kv])[F.col(of_class)]
