from fractions import Fraction
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgauge.llm import queries, whitening
from veilgauge.llm.vectors import pack_rows, unpack_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def floors(vector):
    return [math.floor(256 * float(np.float32(c))) for c in vector]


def plain(rows):
    """The contract in fractions and one eigendecomposition, row by row."""
    good = [(i, floors(v)) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(x) for _, x in good)
    good = [(i, x + [0] * (d - len(x))) for i, x in good]
    fit = sorted({tuple(x) for _, x in good})
    n = len(fit)
    sums = [sum(x[k] for x in fit) for k in range(d)]
    mean = [Fraction(s, n) for s in sums]
    v = [[sum((x[a] - mean[a]) * (x[b] - mean[b]) for x in fit) / n for b in range(d)] for a in range(d)]
    return good, n, sums, np.array([[float(c) for c in r] for r in v])


def check(got, rows):
    good, n, sums, v = plain(rows)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)
    assert len(got) == len(good) * min(4, len(sums))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    sign = {}
    for i, x in good:
        for c in range(1, min(4, len(sums)) + 1):
            r = by[(i, c)].pop()
            far = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert r.n == n and r.deviation == (far if far < 1 << 63 else None)
            e = values[order[c - 1]]
            if e <= np.trace(v) * 1e-12:
                assert r.whitened == 0
                continue
            w = (np.array(x) - np.array(sums) / n) @ vectors[:, order[c - 1]] / math.sqrt(e)
            if abs(w) > 1e-6:
                s = sign.setdefault(c, 1 if (w > 0) == (r.whitened > 0) else -1)
                assert r.whitened * s == pytest.approx(w, rel=1e-4)
            assert r.explained == pytest.approx(e / np.trace(v), rel=1e-6) and r.identity_error < 1e-4


def test_planes_give_the_exact_products():
    r = np.random.default_rng(1)
    for n, d, top in ((1, 1, 3), (64, 3, 300), (1000, 5, 70_000), (129, 2, 1 << 61), (70, 2, 0)):
        x = r.integers(-top, top + 1, (n, d))
        s, c = whitening.bit_sliced(x)
        exact = x.astype(object)
        assert list(s) == list(exact.sum(axis=0)) and (c == exact.T.dot(exact)).all()


def test_packed_rows_come_back():
    x = np.array([[1, -2, 0], [0, 0, 0], [1 << 40, 5, -7], [-32768, 32767, 1]])
    assert (unpack_rows(pack_rows(x)) == x).all()
    assert pack_rows(np.array([[3, 0]])) == pack_rows(np.array([[3, 0, 0]]))


def test_query_against_fractions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = queries.QUERIES["op13_whitening"](spark, "/root/testdata/sf0.001").collect()
    check(got, [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


def test_awkward_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(c) for c in r.normal(size=3)], 1) for i in range(40)]
    rows += [(1000 + i, rows[0][1], None) for i in range(200)]  # one vector is most rows
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (None, rows[6][1], 1), (900, None, 1), (901, [1.0, None, 2.0], 1), (902, [1.0, math.nan, 2.0], 1),
             (903, [math.inf, 0.0, 0.0], 1), (904, [0.5, -0.25], 1), (905, [], 1), (906, [100.0, -3e4, 1e6], 1), (907, [-0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x")).withColumn("x", F.lit("y")).withColumn("whitened", F.lit(1)).withColumn("id", F.lit(2))
    check(whitening.whiten(df).collect(), rows)
    again = whitening.whiten(df.repartition(7)).orderBy("vec_id", "component").collect()
    assert [round(a.whitened, 9) for a in again] == [round(a.whitened, 9) for a in whitening.whiten(df).orderBy("vec_id", "component").collect()]


def test_no_rows_and_no_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 1), (2, [0.5, 1.0], 2)], SCHEMA)).collect()
    assert len(got) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, 0.0, None, 0.0)}
