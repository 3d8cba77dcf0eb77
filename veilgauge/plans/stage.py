"""Shared intermediate tables of the registered queries.

Sessions, flows, findings and links feed dozens of queries. Like the tables of
a lake they are written once per input folder and state of its files, as Parquet in the shared folder
of spark.checkpoint.dir, and read back with column pruning and push-down. A
written table also cuts lineage: a lost executor re-reads files instead of
recomputing the chain. Where no shared folder exists on a cluster the plan is
used as it is.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import adapters as A

#: Shuffled bytes that one task of a staged table reads at most, where there are partitions enough: wide rows take ten times that when they are sorted.
TASK_BYTES = 16 << 20
#: Spark then removes the shuffle files of a statement when it ends; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TABLES: dict[tuple[str, str, str], tuple[str, object]] = {}
_FOLDERS: dict[str, str] = {}


def folder(spark: SparkSession) -> str | None:
    """The cluster's shared folder; a new temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        return None
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _FOLDERS[app]


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """What the tables of a folder are now: name, size and time of every file. A listing, no file is opened."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen = []
    for pattern in ("*.parquet", "*.parquet/*"):
        seen += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, pattern)) or []]
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]


@contextlib.contextmanager
def small_tasks(spark: SparkSession, sf_dir: str, times: int = 1):
    """Inside the block, shuffles have partitions for the rows of the input, are read in tasks that do not grow with it and leave no files behind.

    `times`: how many times the partitions of the staged tables, for a statement that moves more than they do.
    """
    parts, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {parts: spark.conf.get(parts), size: spark.conf.get(size), CLEANUP: spark.conf.get(CLEANUP, None)}
    jvm = spark.sparkContext._jvm
    files = [jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet") for t in ("orders", "events")]
    held = [str(f) for f in files if f.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(f)]
    try:
        spark.conf.set(parts, max([int(before[parts]), *[times * A.tasks(spark.read.parquet(f)) for f in held]]))
        spark.conf.set(size, min(jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[size]), TASK_BYTES))
        spark.conf.set(CLEANUP, "true")
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    root = folder(spark)
    if root is None:
        return build()
    app = spark.sparkContext.applicationId
    state = fingerprint(spark, sf_dir)  # tables that have changed are staged anew
    key = (app, f"{sf_dir} {state}", name)
    if key not in _TABLES:
        tag = hashlib.sha256(f"{sf_dir} {state}".encode()).hexdigest()[:16]
        path = f"{root}/veilgauge/{app}/{tag}/{name}"
        with small_tasks(spark, sf_dir):
            df = build()
            df.write.mode("overwrite").parquet(path)
        _TABLES[key] = (path, df.schema)
    path, schema = _TABLES[key]
    return spark.read.schema(schema).parquet(path)


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads back, beside the staged tables."""
    root = folder(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{root}/veilgauge/fresh/{name}-{uuid.uuid4().hex}"
