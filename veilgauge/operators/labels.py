"""Ground-truth labels: validation, matching to flows, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import registries as R
from .flows import KEYS


def parse_spi(text: Column) -> Column:
    """Hex text, with or without 0x, to a number; null when it is none."""
    clean = F.regexp_replace(F.lower(F.trim(text)), "^0x", "")
    return F.when(clean.rlike("^[0-9a-f]{1,15}$"), F.conv(clean, 16, 10).cast("bigint"))


def validate(raw: DataFrame) -> DataFrame:
    """Add `spi` and `problem` to raw entries (capture, idx, suite, source, spi_text, dst, peers).

    The first broken rule is named. A repeated (SPI, dst) is found by comparing
    each entry with the first index of its key, an aggregate and a join.
    """
    spi = parse_spi(F.col("spi_text"))
    has_spi, has_peers = F.col("spi_text").isNotNull(), F.col("peers").isNotNull()
    peers_ok = (F.size("peers") == 2) & (F.get("peers", F.lit(0)) != F.get("peers", F.lit(1))) & (
        F.get("peers", F.lit(0)) != "") & (F.get("peers", F.lit(1)) != "")
    first_problem = (
        F.when(~F.coalesce(F.col("suite").isin(*R.SUITES), F.lit(False)), "unknown suite")
        .when(F.trim(F.coalesce("source", F.lit(""))) == "", "no source").when(has_spi == has_peers, "one of spi or peers")
        .when(has_spi & spi.isNull(), "spi is not hex").when(has_spi & ((spi <= 0) | (spi > 0xFFFFFFFF)), "spi out of range")
        .when(has_peers & ~peers_ok, "peers are not two addresses"))
    if "file_problem" in raw.columns:  # of the file that an entry should have come from
        first_problem = F.coalesce("file_problem", first_problem)
    r = raw.withColumn("spi", spi).withColumn("problem", first_problem)
    good = r.where(F.col("problem").isNull() & F.col("spi").isNotNull())
    first = good.groupBy("capture", "spi", F.coalesce("dst", F.lit("")).alias("to")).agg(F.min("idx").alias("first_idx"))
    j = r.withColumn("to", F.coalesce("dst", F.lit(""))).join(first, ["capture", "spi", "to"], "left")
    return j.withColumn("problem", F.when(F.col("problem").isNull() & (F.col("idx") > F.col("first_idx")), "spi labelled twice").otherwise(
        F.col("problem"))).drop("to", "first_idx")


def match(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """Each flow with the entry that claims it: SPI entries before peer entries, then entry order.

    Entries are reduced to one per key first, so a flow meets at most three.
    """
    entry = F.struct("idx", "suite", "source")
    spi = labels.where(F.col("spi").isNotNull())
    exact = spi.where(F.col("dst").isNotNull()).groupBy("capture", "spi", "dst").agg(F.min(entry).alias("e1"))
    anyd = spi.where(F.col("dst").isNull()).groupBy("capture", "spi").agg(F.min(entry).alias("e2"))
    lo, hi = F.least("peer_a", "peer_b"), F.greatest("peer_a", "peer_b")
    peers = labels.where(F.col("peer_a").isNotNull()).groupBy("capture", lo.alias("lo"), hi.alias("hi")).agg(F.min(entry).alias("e3"))
    f = flows.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")})
    j = f.join(exact, ["capture", "spi", "dst"], "left").join(anyd, ["capture", "spi"], "left").join(peers, ["capture", "lo", "hi"], "left")
    by_spi = F.least("e1", "e2")
    return j.withColumn("entry", F.coalesce(by_spi, F.col("e3"))).drop("e1", "e2", "e3", "lo", "hi").select(
        *flows.columns, F.col("entry.idx").alias("label_idx"), F.col("entry.suite").alias("label_suite"), F.col("entry.source").alias("label_source"))


def unmatched(labels: DataFrame, matched: DataFrame) -> DataFrame:
    used = matched.where(F.col("label_idx").isNotNull()).select("capture", F.col("label_idx").alias("idx")).distinct()
    return labels.join(used, ["capture", "idx"], "left_anti")


def class_of(suite: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in R.CLASS_OF_SUITE.items() for x in kv])[suite]


def rollup(scored: DataFrame) -> DataFrame:
    """Hits and misses per capture; a labelled capture passes when it has rows and all hit."""
    return scored.groupBy("capture").agg(
        F.count("label_suite").alias("labelled"), F.sum(F.col("hit").cast("bigint")).alias("hits"),
        (F.count("label_suite") - F.sum(F.coalesce(F.col("hit"), F.lit(False)).cast("bigint"))).alias("misses"),
        F.coalesce(F.min("hit"), F.lit(False)).alias("passed"))


def miss_diagnosis(trace: DataFrame, labelled: DataFrame) -> DataFrame:
    """Whether the arithmetic excluded all, some or no members of the labelled class."""
    truth = labelled.where(F.col("label_suite").isNotNull()).select(*KEYS, class_of(F.col("label_suite")).alias("class"))
    t = trace.join(truth, [*KEYS, "class"]).groupBy(*KEYS, "class").agg(
        F.count(F.lit(1)).alias("members"), F.count("eliminated_by").alias("excluded"))
    return t.withColumn("diagnosis", F.when(F.col("excluded") == F.col("members"), "all excluded").when(
        F.col("excluded") > 0, "some excluded").otherwise("outranked"))
