"""JSON side files: label sidecars and policy overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import registries as R

LABEL_SCHEMA = ("source string, notes string, flows array<struct<suite:string,source:string,spi:string,dst:string,peers:array<string>>>")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label sidecars (<capture>.label.json) to raw entries for labels.validate.

    A file that is no JSON, or has no flows, gives one row without an index that says so in file_problem.
    """
    docs = spark.read.schema(LABEL_SCHEMA + ", _corrupt string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn(
        "capture", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.label\.json$", ""))
    problem = F.when(F.col("_corrupt").isNotNull(), "not JSON").when(F.coalesce(F.size("flows"), F.lit(0)) < 1, "no flows")
    return docs.select("capture", F.col("source").alias("top"), problem.alias("file_problem"), F.posexplode_outer("flows").alias("idx", "f")).select(
        "file_problem", "capture", "idx", "f.suite", F.coalesce("f.source", "top").alias("source"), F.col("f.spi").alias("spi_text"), "f.dst", "f.peers")


def read_overlay(spark: SparkSession, path: str) -> DataFrame:
    """A policy overlay file to (setting, key, value) rows, for operations.check_overlay and merge_policy."""
    text = spark.read.option("wholetext", "true").text(path)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("setting", "value")).where(
        ~F.col("setting").isin("name", "reference", "description"))
    keys = (F.when(F.startswith("value", F.lit("{")), F.map_keys(F.from_json("value", "map<string,string>")))
            .when(F.startswith("value", F.lit("[")), F.from_json("value", "array<string>")).otherwise(F.array("value")))
    return pairs.select("setting", F.explode(keys).alias("key")).withColumn("value", F.col("key"))


def overlay_policy(rows: DataFrame, base: R.Policy = R.BASELINE_POLICY, replace_tables: bool = False) -> R.Policy:
    """Rows of a checked overlay as a Policy. An overlay is one hand-written file, which a task has held whole before its rows come here."""
    found = rows.select("setting", "key").distinct().collect()
    changes: dict = {}
    for setting, key in found:
        if setting not in R.POLICY_FIELDS:
            raise ValueError(f"unknown policy setting {setting}")
        if R.POLICY_FIELDS[setting][1] == "scalar":
            changes[setting] = int(key)
        else:
            changes.setdefault(setting, []).append(key)
    return base.overlay(changes, replace_tables)
