"""Spark session settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change plans, not results. On a cluster the same values apply;
# shuffle parallelism is left to AQE, which coalesces from a high start.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build(app: str = "veilgauge", master: str | None = None, partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    for key, value in CONF.items():
        b = b.config(key, value)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder the cluster names for cut lineage and state.

    A fallback is only for local tests; on a cluster a machine-local folder
    would lose the data with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local") and fallback:
        return fallback
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
