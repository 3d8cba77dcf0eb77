"""Helpers of the operators: tables, and results that are written once to the shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only a local session without it gets a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a result once and read it back: later uses read files, whatever executors are lost."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Remove the files of tables that `written` made and nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for what runs inside the block; those of before are put back."""
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not use yet (names compare without case)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def with_result(df: DataFrame, name: str, column) -> DataFrame:
    """Set a result column; an input column of that name, whatever its case, is replaced."""
    return df.drop(*[c for c in df.columns if c.lower() == name.lower()]).withColumn(name, column)


#: bytes of a text in UTF-8; a null text has none
def utf8_bytes(text="text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: number of words [^\x20\x09-\x0D]+ of a text; a null text has none
def word_count(text="text"):
    blank = "[\\x20\\x09-\\x0D]+"
    return F.coalesce(F.size(F.filter(F.split(F.col(text), blank), lambda w: F.length(w) > 0)), F.lit(0)).cast("long")
