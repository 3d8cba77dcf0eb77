import os
from collections import Counter

import pytest

from veilgauge.llm import token_counts as tc
from veilgauge.llm.queries import QUERIES

from .rows import DOCS, awkward, extra

pytestmark = pytest.mark.skipif(not os.path.exists(tc.RANKS), reason="no vocabulary file")


def lengths(rows):
    encode = tc.encoder(tc.RANKS).encode_ordinary
    return [len(encode(r[1] or "")) for r in rows]


def test_histogram_counts_every_document(spark):
    df = extra(spark.createDataFrame(awkward(), DOCS), "n_tokens", "docs")
    assert {r.n_tokens: r.docs for r in tc.length_histogram(df).collect()} == Counter(lengths(awkward()))
    assert {r.n_tokens: r.docs for r in tc.length_histogram(df, special=2).collect()} == Counter(x + 2 for x in lengths(awkward()))


def test_suffix_sums_against_plain_sums(spark, tmp_path):
    spark.createDataFrame(awkward(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    n = lengths(awkward())
    got = QUERIES["op9_token_counts"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(
        (x, n.count(x), x * n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x), sum(y <= x for y in n), sum(min(y, x) for y in n), len(n), sum(n)) for x in set(n))


def test_totals_and_quantiles_for_any_limit(spark):
    n = sorted(lengths(awkward()))
    sums = tc.suffix_sums(tc.length_histogram(spark.createDataFrame(awkward(), DOCS)))
    limits = [0, 1, 50, 128, n[-1], n[-1] + 5]
    got = {r.context_limit: (r.docs_over, r.tokens_kept, r.tokens_lost) for r in tc.totals_at(sums, limits).collect()}
    assert got == {x: (sum(y > x for y in n), sum(min(x, y) for y in n), sum(max(0, y - x) for y in n)) for x in limits}
    for r in tc.quantiles(sums, [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == min(x for x in n if sum(y <= x for y in n) >= max(1, r.q * len(n)))


def test_no_documents(spark):
    empty = tc.suffix_sums(tc.length_histogram(spark.createDataFrame([], DOCS)))
    assert empty.count() == 0
    assert [tuple(r) for r in tc.totals_at(empty, [5]).collect()] == [(5, 0, 0, 0)]
