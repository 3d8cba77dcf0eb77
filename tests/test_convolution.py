"""The convolution's arithmetic against SQL over its weights, its gradient against differences, its fit against a plain sum."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from veilgauge.operators import convolution as CO
from veilgauge.operators.flows import KEYS, SHARE_NAMES


def small(seed=1, classes=3, filters=4):
    r = np.random.default_rng(seed)
    return CO.ProfileNet(r.normal(size=(filters, CO.WIDTH)), r.normal(size=filters), r.normal(size=(2 * filters, classes)), r.normal(size=classes)), r


def test_probabilities_are_those_of_sql_over_the_weights():
    net, r = small()
    x = r.random((7, 64))
    con = duckdb.connect()
    long = lambda a, *names: pd.DataFrame([(*i, float(v)) for i, v in np.ndenumerate(a)], columns=[*names, "v"])
    for name, frame in {"x": long(x, "n", "i"), "f": long(net.filters, "f", "k"), "b": long(net.bias, "f"), "o": long(net.output, "f", "c"), "t": long(net.offset, "c")}.items():
        con.register(name, frame)
    got = con.sql(f"""
WITH a AS (SELECT x.n, x.i - f.k AS w, f.f, greatest(sum(x.v * f.v) + any_value(b.v), 0) AS a FROM x JOIN f ON x.i - f.k BETWEEN 0 AND {64 - CO.WIDTH} JOIN b ON b.f = f.f GROUP BY ALL),
s AS (SELECT n, f, max(a) AS v FROM a GROUP BY n, f UNION ALL SELECT n, f + {len(net.bias)}, avg(a) FROM a GROUP BY n, f),
z AS (SELECT n, o.c, exp(sum(s.v * o.v) + any_value(t.v)) AS e FROM s JOIN o ON o.f = s.f JOIN t ON t.c = o.c GROUP BY n, o.c)
SELECT n, c, e / sum(e) OVER (PARTITION BY n) AS p FROM z ORDER BY n, c""").fetchnumpy()["p"].reshape(7, 3)
    assert np.allclose(got, net.probabilities(x))


def test_gradient_is_that_of_differences():
    net, r = small(2)
    x, label, weight = r.random((5, 64)), np.array([0, 1, 2, 2, 0]), r.random(5)
    loss, g = net.gradient(x, label, weight)
    flat = net.flat()
    for k in r.choice(len(flat), 30, replace=False):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        up, down = (net.with_weights(flat + s).gradient(x, label, weight)[0] for s in (step, -step))
        assert g[k] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_fit_finds_peaks_wherever_they_are(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = []
    for i in range(240):
        x, at, label = r.random(64) * 0.05, int(r.integers(0, 58)), i % 2
        x[at:at + (1 if label else 4)] += 1.0 if label else 0.5
        rows.append(("c", "a", "b", i, float(label), *map(float, x)))
    schema = "capture string, src string, dst string, spi bigint, label double, " + ", ".join(f"{c} double" for c in SHARE_NAMES)
    df = spark.createDataFrame(rows, schema).repartition(3)
    net, losses = CO.fit_profile_net(df, 2, str(tmp_path), epochs=60)
    assert losses[-1] < 0.2 < losses[0]
    scored = CO.score_profiles(net, df)
    assert scored.columns == [*KEYS, "p_net"]
    right = sum(int(np.argmax(s.p_net)) == s.spi % 2 for s in scored.collect())
    assert right > 225
    assert CO.score_profiles(net, df.limit(0)).count() == 0
