import zlib

import numpy as np
import pyarrow as pa
import pytest

from veilgauge.llm import quality_net as qn

from .rows import DOCS, awkward, extra
from .test_quality_rules import LABELS, corpus


def by_hand(net, text):
    raw = list((text or "").encode())
    places = max(1, -(-(len(raw) - qn.WIDTH) // qn.STRIDE) + 1)
    raw += [qn.PAD] * ((places - 1) * qn.STRIDE + qn.WIDTH - len(raw))
    active = np.array([np.maximum(net.embed[raw[p * qn.STRIDE:p * qn.STRIDE + qn.WIDTH]].reshape(-1) @ net.filters + net.bias, 0) for p in range(places)])
    chunks = np.array([active[a:a + qn.CHUNK].max(axis=0) for a in range(0, places, qn.CHUNK)])
    document = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) - net.middle
    return 1 / (1 + np.exp(-float(document @ net.out + net.shift[0])))


def test_scores_cover_the_whole_text_and_not_the_batch():
    net = qn.Network(1)
    net.out += np.random.default_rng(0).normal(0, 1, net.out.shape).astype(np.float32)
    texts = ["", None, "short", "é" * 700, "a" * 12, "b" * 13, "plain words " * 900 + "!! ZZ"]
    got = net.score(pa.array(texts))
    assert got == pytest.approx([by_hand(net, t) for t in texts], abs=1e-5)
    assert net.score(pa.array(texts[6:]))[0] == pytest.approx(got[6], abs=1e-6)
    assert abs(net.score(pa.array(["plain words " * 900]))[0] - got[6]) > 1e-9


def test_a_text_longer_than_a_slice_is_pooled_in_blocks(monkeypatch):
    net = qn.Network(1)
    net.out += np.random.default_rng(0).normal(0, 1, net.out.shape).astype(np.float32)
    texts = pa.array(["x y z " * 3000, "", "long words here " * 2000])
    whole = net.score(texts)
    monkeypatch.setattr(qn, "_SLICE", 1000)
    monkeypatch.setattr(qn, "_BLOCK", 7)
    assert net.score(texts) == pytest.approx(whole, abs=1e-6)


def test_gradients_against_differences():
    net = qn.Network(2)
    net.out += np.random.default_rng(0).normal(0, 1, net.out.shape).astype(np.float32)
    net.bias += 0.01  # off the corner of the maximum with zero
    texts, wanted = pa.array(["some words here", "OTHER!! TEXT!!" * 60, ""]), np.array([1, 0, 1], np.float32)

    def loss():
        p = net.score(texts)
        return -np.mean(wanted * np.log(p) + (1 - wanted) * np.log(1 - p))

    for p, g in zip(net.parameters(), net.gradients(texts, wanted)):
        for i in np.argsort(-np.abs(g.reshape(-1)))[:4]:
            before, d = p.reshape(-1)[i], 2e-3
            p.reshape(-1)[i] = before + d
            up = loss()
            p.reshape(-1)[i] = before - d
            down = loss()
            p.reshape(-1)[i] = before
            assert (up - down) / (2 * d) == pytest.approx(g.reshape(-1)[i], rel=0.1, abs=2e-3)


def test_held_out_accuracy_and_no_use_of_held_out_labels(spark):
    rows, labels = corpus(500)
    docs = spark.createDataFrame(rows, DOCS)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    got = qn.classify(docs, spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == int(r.doc_id % 8 != 0) for r in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    assert np.array_equal(qn.fit(docs, spark.createDataFrame(labels, LABELS)).filters, qn.fit(docs, spark.createDataFrame(turned, LABELS)).filters)


def test_awkward_rows_and_no_labels(spark):
    df = extra(spark.createDataFrame(awkward(), DOCS), "Score", "label")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0), (999, 1, 0)], LABELS)
    got = qn.classify(df, labels).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    same = {}
    for r in got:
        assert same.setdefault(r.text or "", r.score) == pytest.approx(r.score, abs=1e-6)
    assert {r.score for r in qn.classify(df, labels.limit(0)).collect()} == {0.5}
    assert qn.classify(df.limit(0), labels).count() == 0
    assert qn.drop_poor(df, labels.limit(0)).columns == df.columns and qn.drop_poor(df, labels.limit(0)).count() == len(awkward())
