import zlib

import pytest
from pyspark.sql import functions as F

from veilgauge.llm import sharding
from veilgauge.llm.queries import QUERIES

from .rows import DOCS, awkward, extra

HELPERS = ["_copies", "_chunk", "_before", "_sum", "_start", "_shard", "_part", "_shard_of", "_chunk_of", "_piece", "piece"]


def jump(key, n):
    key, at, to = key % (1 << 64), -1, 0
    while to < n:
        at = to
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        to = int(float(at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("n", [1, 2, 8, 9, 39, 41, 1000])
def test_shards_are_those_of_the_published_loop(spark, n):
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), 123456789012345, *range(100, 400)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("s", sharding.jump_shard(F.col("k"), n)).collect()
    assert [r.s for r in got] == [jump(r.k, n) for r in got]


def test_a_further_shard_only_takes_rows_into_itself(spark):
    df = spark.range(20000).select(sharding.jump_shard(F.col("id"), 8).alias("a"), sharding.jump_shard(F.col("id"), 9).alias("b"))
    moved = df.filter("a <> b").groupBy("b").count().collect()
    assert [r.b for r in moved] == [8] and abs(moved[0]["count"] / 20000 - 1 / 9) < 0.01
    assert df.groupBy("a").count().agg(F.max("count")).first()[0] < 20000 / 8 * 1.06


def test_slots_are_gapless_for_nulls_ties_and_repeated_rows(spark):
    df = extra(spark.createDataFrame(awkward() * 2, DOCS), "shard", "Slot", *HELPERS)
    numbered = sharding.number_slots(sharding.assign_shards(df))
    got = numbered.collect()
    assert sorted(numbered.columns) == sorted([*[c for c in df.columns if c not in ("shard", "Slot")], "shard", "slot"])
    assert all(r[n] == f"own {n}" for r in got for n in HELPERS)
    assert len(got) == 2 * len(awkward())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.shard == jump(r.doc_id or 0, 8) for r in got)
    assert sharding.number_slots(sharding.assign_shards(df.limit(0))).count() == 0


def test_one_row_repeated_without_end(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 7)
    df = spark.range(30000).select(F.lit(5).alias("doc_id"))
    got = sharding.number_slots(sharding.assign_shards(df)).agg(F.min("slot"), F.max("slot"), F.countDistinct("slot")).first()
    assert tuple(got) == (0, 29999, 30000)


def test_query_against_plain_python(spark, tmp_path):
    rows = [r for r in awkward() if r[0] is not None]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op2_sharding"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(tuple(r)[:5] + (r.grown_shard,) for r in got.collect()) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", jump(i, 8), jump(i, 9)) for i, t, *_ in rows)


def test_plan_has_no_python(spark):
    plan = sharding.number_slots(sharding.assign_shards(spark.range(5).select(F.col("id").alias("doc_id"))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
