from collections import Counter

from veilgauge.operators.flows import KEYS
from veilgauge.operators.ml import stratified


def test_every_label_is_split_to_the_row(spark):
    sizes = {0.0: 1, 1.0: 2, 2.0: 3, 3.0: 6, 4.0: 41, None: 5}
    rows = [(label, i) for label, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "label double, row long").selectExpr("*", *[f"concat('{k}', row) AS {k}" for k in KEYS])
    train, test = (x.collect() for x in stratified(df))
    assert Counter(r.label for r in test) == {1.0: 1, 2.0: 1, 3.0: 2, 4.0: 10, None: 1}
    assert Counter((r.label, r.row) for r in train + test) == Counter(rows)
    assert {(r.label, r.row) for r in stratified(df.repartition(5))[1].collect()} == {(r.label, r.row) for r in test}
