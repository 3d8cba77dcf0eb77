from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from .rows import DOCS, awkward, prose
from .test_decontaminate import ITEMS
from .test_quality_rules import LABELS, corpus


def folder(spark, path, rows, labels, items):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_every_decision_takes_effect(spark, tmp_path):
    rows, labels = corpus(400)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, *_ in rows]
    leak = prose(7777, 40)
    rows += [(1000, rows[1][1], "en", "s0", 1), (1001, rows[1][1] + " end", "en", "s1", 1), (1002, prose(5, 80) + " " + leak, "en", "s2", 1)]
    rows += [(i and i + 2000, t, la, s, n) for i, t, la, s, n in awkward() if i is None or i > 99]
    sf = folder(spark, tmp_path, rows, labels, [(1, leak)])
    got = corpus_pipeline.run(spark, sf).collect()
    count = Counter(r.doc_id for r in got)
    assert max(n for i, n in count.items() if i is not None and i < 1000) == 2
    assert not {1000, 1001, 1002} & set(count)
    bad = {i for i, q, _ in labels if not q}
    good = {i for i, q, _ in labels if q}
    assert len(bad & set(count)) <= 0.1 * len(bad) and len(good & set(count)) >= 0.7 * len(good)
    for s in range(corpus_pipeline.SHARDS):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(got[0].asDict())


def test_stages_bear_awkward_rows_and_empty_tables(spark, tmp_path):
    rows, labels = corpus(40)
    sf = folder(spark, tmp_path, rows, labels, [(1, prose(13, 63)), (2, None)])
    docs = spark.createDataFrame(awkward(), DOCS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dup", "decontaminate", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "sharding":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
        out.agg(F.count("*")).collect()


def test_run_on_no_documents(spark, tmp_path):
    sf = folder(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
