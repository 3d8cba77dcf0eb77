import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from veilgauge.llm import quality_rules as qr
from veilgauge.llm.queries import QUERIES

from .rows import DOCS, awkward, extra, prose

LABELS = "doc_id long, quality int, toxic int"


def by_hand(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab A\n\r\té#|", max_size=50)), max_size=8))
def test_statistics_against_plain_python(texts):
    got = qr.statistics(pa.array(texts, pa.string()))
    assert got[:, :6].tolist() == [by_hand(t) for t in texts]


def test_awkward_rows(spark):
    df = extra(spark.createDataFrame(awkward(), DOCS), "KEPT", "anomaly", "_stats")
    got = qr.judge(df, spark.createDataFrame([], LABELS)).collect()
    assert len(got) == len(awkward())
    for r in got:
        n, *_ , repeat, _ = by_hand(r.text) if len(r.text or "") < 5000 else (r.n_words, 0, r.n_repeat_words, 0)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and r.kept == (not r.base_failed)
    assert qr.judge(df.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def corpus(n=600):
    rows, labels = [], []
    for i in range(n):
        text, bad = prose(i, 80 + i % 150).capitalize() + ".", i % 8 == 0
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 16 else text.replace(" ", " | ")
        rows.append((i, text, None, None, None))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_forest_tells_labelled_documents_apart(spark):
    rows, labels = corpus()
    got = qr.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and not r.base_failed]
    assert sum(r.kept != (r.doc_id % 8 != 0) for r in held) <= 0.03 * len(held)


def test_held_out_labels_change_nothing(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, DOCS)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = (qr.fit(docs, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert a.threshold == b.threshold and np.array_equal(a.cut, b.cut)


def test_threshold_keeps_to_the_allowed_share():
    scores, good = np.array([0.1, 0.2, 0.3, 0.4, 0.6, 0.9]), np.array([1, 1, 1, 1, 0, 0], bool)
    assert 0.4 < qr.calibrate(scores, good, 0.0) < 0.6
    assert qr.calibrate(np.array([0.2, 0.5, 0.3]), np.array([1, 1, 0], bool), 0.0) >= 0.5
    assert qr.calibrate(np.array([0.2, 0.5]), np.array([True, True]), 0.0) >= 0.5


def test_threshold_counts_every_labelled_document(spark):
    """Long documents and those beyond any number of rows count; the threshold is that of all scores at once."""
    rows, labels = corpus()
    rows = [(i, " ".join([text] * 250) + prose(i, 3000) * 10 if i == 51 else text, *rest) for i, text, *rest in rows]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    table = qr.labelled_features(docs, known)
    counted = [i for i, text, *_ in rows if zlib.crc32(str(i).encode()) % 5 and len(text.split()) >= 50]
    assert sorted(r.doc for r in table.collect()) == counted and max(len(text) for _, text, *_ in rows) > 1 << 18
    forest = qr.fit(docs, known)
    x, good = (np.array(c) for c in zip(*[(r.x, r.label == 1) for r in table.collect()]))
    scores, (_, _, n_good, n_bad) = forest.score(x), qr.score_counts(table, forest)
    assert n_good.sum() == good.sum() and n_bad.sum() == (~good).sum()
    exact = qr.calibrate(scores, good, qr.MAX_FALSE_REJECTS)
    assert (scores > exact).tolist() == (scores > forest.threshold).tolist()


def test_paths_are_short_where_there_is_no_data():
    r = np.random.default_rng(1)
    x = r.uniform(0.4, 0.6, (1000, 3))
    forest = qr.grow(x, np.zeros(3), np.ones(3))
    inside, outside = forest.score(x[:200]), forest.score(r.uniform(0.9, 1.0, (200, 3)))
    assert inside.max() < outside.min()


def test_query_columns(spark, tmp_path):
    rows, labels = corpus(100)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op6_quality_rules"](spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"] and got.count() == 100
