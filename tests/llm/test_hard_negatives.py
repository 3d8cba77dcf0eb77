import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgauge.llm import hard_negatives as H, queries

from ..harness import compare, connect

SCHEMA = "vec_id long, embedding array<double>, label long"


def plain(rows, anchors=50, positives=5, negatives=3, low=50, high=95):
    good = sorted({(i, l, tuple(math.floor(256 * c) for c in v)) for i, v, l in rows
                   if i is not None and l is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    out = []
    for i, l, v in good:
        if i % anchors:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good if j != i)
        for s, j, _ in [x for x in scored if x[2] == l][:positives]:
            rank = 0
            for t, k, m in scored:
                if m != l and low * -s <= 100 * -t <= high * -s and rank < negatives:
                    rank += 1
                    out.append((i, j, rank, k, -s, -t))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(queries.QUERIES["op11_hard_negatives"](spark, sf), queries.ORACLES["op11_hard_negatives"], connect(sf)) is None


def random_rows(seed, n, d, scale=0.2, labels=3):
    r = np.random.default_rng(seed)
    return [(int(i), [float(c) for c in r.normal(scale=scale, size=d)], int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("row_block,anchor_block", [(8192, 16384), (7, 2), (40, 3)])
def test_any_size_of_blocks(spark, row_block, anchor_block):
    rows = random_rows(1, 400, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    mined = H.mine(df, F.col("id") % 10 == 0, row_block=row_block, anchor_block=anchor_block)
    assert got(mined) == plain(rows, anchors=10)


def test_clustered_rows_of_very_different_norms(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 5))
    rows = [(int(i), [float(c) for c in (centres[i % 6] + r.normal(scale=0.1, size=5)) * r.choice([0.01, 1, 40, 3e6])], int(i % 4)) for i in range(300)]
    assert got(H.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0, row_block=32)) == plain(rows, anchors=10)


def test_awkward_rows(spark):
    rows = random_rows(4, 160, 3)
    rows += [(1000 + i, rows[0][1], 1) for i in range(300)]  # one vector is most rows: ties by id
    rows += [(5, rows[5][1], rows[5][2])] * 3 + [(50, rows[50][1], rows[50][2])] * 2
    rows += [(2000, [0.0, 0.0, 0.0], 0), (2050, [], 1), (2100, [0.5], 2), (2150, [1e-9, -1e-9, 0.0], 0), (2001, None, 1), (2002, [1.0, None, 0.0], 1), (2003, [math.nan, 1.0, 1.0], 1),
             (2004, [math.inf, 1.0, 1.0], 1), (2005, [0.1, 0.1, 0.1], None), (None, [0.1, 0.1, 0.1], 1), (2200, [1.0, 1.0, 1.0], 77)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "x", "near", "angle", "block", "rank", "k"):
        df = df.withColumn(name, F.lit(name))
    assert got(H.mine(df, row_block=64)) == plain(rows)


def test_no_rows_and_no_anchors(spark):
    assert got(H.mine(spark.createDataFrame([], SCHEMA))) == []
    assert got(H.mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA))) == []


def test_a_score_beyond_64_bits_fails(spark):
    with pytest.raises(Exception, match="does not fit"):
        H.mine(spark.createDataFrame([(50, [1e15], 1), (51, [1e15], 1)], SCHEMA)).collect()


def test_bounds_hold_and_thin(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(8, 6)) * 300
    x = np.floor(centres[r.integers(8, size=400)] + r.normal(scale=8, size=(400, 6))).astype(np.int64)
    references = H.fit_references(x)
    norms, angles = H.angles_of(x, references)
    angles = angles.astype(np.float32).astype(np.float64)
    kept = 0
    for i in range(0, 400, 10):
        low, high = H.score_bounds(angles[i], angles[i], norms[i], norms[i], angles, norms)
        s = x @ x[i]
        assert (low <= s).all() and (s <= high).all()
        kept += (high >= 0.9 * s[i]).sum()
    assert kept < 0.4 * 40 * 400  # most rows need no score
