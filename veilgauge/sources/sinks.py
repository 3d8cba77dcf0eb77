"""Sinks: reports, inventory, audit log, fleet store, dataset export.

Documents are written as JSON lines partitioned by capture, one line per part
(session, flow, finding, component), so a capture with a third of all findings
is written by many tasks. Nothing is assembled into one object in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.posture import posture, report_digest


def as_lines(kind: str, df: DataFrame) -> DataFrame:
    """(capture, part, body) rows of a table."""
    return df.select("capture", F.lit(kind).alias("part"), F.to_json(F.struct(*[c for c in df.columns if c != "capture"])).alias("body"))


FILES_PER_CAPTURE = 8


def by_capture(lines: DataFrame, files: int = FILES_PER_CAPTURE) -> DataFrame:
    """Rows dealt by capture and, up to `files`, the task they come from: at most `files` files each, and no task has to write a whole hot capture.

    Rows of one task that follow each other, such as the findings of a session, stay together and take a fifth less to move than dealt by hash.
    """
    return lines.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(files))).repartition("capture", "_part").drop("_part")


COMPRESSION = "gzip"  # JSON lines repeat their names; Spark reads them back by the files' ending


def write_report(path: str, parts: dict[str, DataFrame], mode: str = "overwrite") -> None:
    """A full assessment: lines of every part under capture=<name>/."""
    out = None
    for kind, df in parts.items():
        lines = as_lines(kind, df)
        out = lines if out is None else out.unionByName(lines)
    by_capture(out).write.mode(mode).partitionBy("capture").json(path, compression=COMPRESSION)


def component_lines(protocols: DataFrame, algorithms: DataFrame, esp: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """CycloneDX 1.6 component and vulnerability objects, one JSON text per row."""
    def component(df, asset):
        props = [c for c in df.columns if c not in ("capture", "bom_ref", "name")]
        return df.select("capture", F.lit("component").alias("part"), F.to_json(F.struct(
            F.lit("cryptographic-asset").alias("type"), F.col("bom_ref").alias("bom-ref"), F.col("name"),
            F.struct(F.lit(asset).alias("assetType")).alias("cryptoProperties"),
            F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in props]).alias("properties"))).alias("body"))

    vulns = vulnerabilities.select("capture", F.lit("vulnerability").alias("part"), F.to_json(F.struct(
        F.col("bom_ref").alias("bom-ref"), "id", "description", F.array(F.struct("severity", F.lit("other").alias("method"))).alias("ratings"))).alias("body"))
    return component(protocols, "protocol").unionByName(component(algorithms, "algorithm")).unionByName(
        component(esp.withColumn("name", F.col("flow")), "algorithm")).unionByName(vulns)


def inventory_header(captures: DataFrame, findings: DataFrame) -> DataFrame:
    """One document line per capture: format, version and metadata with the posture of the capture."""
    score = F.array(F.struct(F.lit("posture:score").alias("name"), F.col("score").cast("string").alias("value")),
                    F.struct(F.lit("posture:grade").alias("name"), F.col("grade").alias("value")))
    component = F.struct(F.lit("application").alias("type"), F.col("capture").alias("name"))
    return posture(captures, findings).select("capture", F.lit("document").alias("part"), F.to_json(F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.lit(1).alias("version"),
        F.struct(component.alias("component"), score.alias("properties")).alias("metadata"))).alias("body"))


def write_inventory(path: str, lines: DataFrame) -> None:
    by_capture(lines).write.mode("overwrite").partitionBy("capture", "part").json(path, compression=COMPRESSION)


def audit_records(captures: DataFrame, findings: DataFrame) -> DataFrame:
    """One record per assessment: score, grade, counts and digest, never finding detail."""
    p = posture(captures, findings)
    return p.join(report_digest(findings), "capture", "left").select(
        F.lit("assessment").alias("event"), "capture", "score", "grade", "critical", "high", "medium", "low", "info", "digest")


def append_audit_log(path: str, captures: DataFrame, findings: DataFrame) -> None:
    audit_records(captures, findings).write.mode("append").json(path)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """All records of the log; fields that a record lacks (no findings, no digest) are null."""
    return spark.read.schema("event string, capture string, score int, grade string, critical bigint, high bigint, medium bigint, low bigint, info bigint, digest string").json(path)


def write_fleet(path: str, version: int, judged: DataFrame, baselines: DataFrame) -> None:
    """Observations of one run, then the baseline snapshot after it, both under the run's version.

    Writing a version again replaces it, so a replayed batch counts once. A
    version is complete when its snapshot is; readers look at complete ones only.
    """
    judged.drop("at").write.mode("overwrite").parquet(f"{path}/observations/version={version}")
    baselines.write.mode("overwrite").parquet(f"{path}/baselines/version={version}")


def complete_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose baseline snapshot was committed, oldest first; a store that does not exist has none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/baselines")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if re.fullmatch(r"version=\d+", n) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/baselines/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def read_fleet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored observations of all complete versions; a store that does not exist reads as empty and is not created."""
    versions = complete_versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/observations/version={v}" for v in versions])


def read_baselines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest complete baseline snapshot."""
    versions = complete_versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/baselines/version={versions[-1]}") if versions else spark.createDataFrame([], schema)


def export_dataset(path: str, captures: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings per capture plus a manifest: folder and size of its lines, finding count, score and grade."""
    lines = as_lines("finding", findings)
    by_capture(lines).write.mode("overwrite").partitionBy("capture").json(f"{path}/documents", compression=COMPRESSION)
    sizes = lines.groupBy("capture").agg(F.sum(F.octet_length("body")).alias("bytes"))
    manifest = posture(captures, findings).join(sizes, "capture", "left").select(
        "capture", F.when(F.col("bytes").isNotNull(), F.concat(F.lit("documents/capture="), "capture")).alias("file"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"), "findings", "score", "grade")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest
