"""Staged tables follow their input."""

import os

from veilgauge.plans.stage import staged


def test_a_changed_input_is_staged_anew(spark, tmp_path):
    src, built = str(tmp_path), []

    def build():
        built.append(1)
        return spark.read.parquet(f"{src}/numbers.parquet")

    spark.range(3).coalesce(1).write.parquet(f"{src}/numbers.parquet")
    assert staged(spark, src, "numbers", build).count() == 3 == staged(spark, src, "numbers", build).count() and len(built) == 1
    spark.range(5).coalesce(1).write.mode("append").parquet(f"{src}/numbers.parquet")
    assert staged(spark, src, "numbers", build).count() == 8 and len(built) == 2
    assert os.path.exists(f"{src}/numbers.parquet")


def test_tasks_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from veilgauge import adapters as A

    monkeypatch.setattr(A, "TASK_ROWS", 100)
    src, seen = str(tmp_path), []
    spark.range(5000).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{src}/orders.parquet")
    table = A.table(spark, src, "orders")
    assert table.rdd.getNumPartitions() == 50 and table.distinct().count() == 5000
    assert max(table.rdd.glom().map(len).collect()) < 300
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(k) for k in keys]

    def build():
        seen.extend(spark.conf.get(k) for k in keys)
        return table

    assert staged(spark, src, "orders", build).count() == 5000
    assert seen == ["50", str(16 << 20)] and [spark.conf.get(k) for k in keys] == before


def test_staging_leaves_no_shuffle_files(spark, tmp_path):
    def files():
        held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(i).getName() for i in range(held.size()) if held.apply(i).getName().startswith("shuffle_")}

    before = files()
    table = staged(spark, str(tmp_path), "spread", lambda: spark.range(1000).repartition(7, "id"))
    assert not files() - before
    assert table.count() == 1000
