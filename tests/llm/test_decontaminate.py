import random

import pytest
from hypothesis import given, settings, strategies as st

from veilgauge.llm import decontaminate as dc

from .rows import DOCS, awkward, extra, prose

ITEMS = "item_id long, text string"


def tile_by_hand(doc, item, shortest):
    """Greedy string tiling as defined: mark the longest unmarked matches again and again."""
    shortest = min(shortest, len(item))
    a, b, out = [False] * len(doc), [False] * len(item), []
    while True:
        best, found = shortest - 1, []
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n] and not a[q + n] and not b[p + n]:
                    n += 1
                if n > best:
                    best, found = n, [(p, q)]
                elif n == best and n >= shortest:
                    found.append((p, q))
        if best < shortest or not found:
            return sum(n for _, _, n in out)
        for p, q in found:
            if not any(a[q:q + best]) and not any(b[p:p + best]):
                a[q:q + best] = [True] * best
                b[p:p + best] = [True] * best
                out.append((q, p, best))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), min_size=1, max_size=20))
def test_tiling_covers_what_the_definition_covers(doc, item):
    got = dc.tiles([(0, doc)], item, 3)
    assert sum(n for _, _, n in got) == tile_by_hand(doc, item, 3)
    for q, p, n in got:
        assert doc[q:q + n] == item[p:p + n] and n >= min(3, len(item))
    assert len({i for _, p, n in got for i in range(p, p + n)}) == sum(n for _, _, n in got)
    assert len({i for q, _, n in got for i in range(q, q + n)}) == sum(n for _, _, n in got)


def test_leaks_reordered_passages_and_clean_documents(spark):
    item = prose(500, 40)
    w = item.split()
    moved = " ".join(w[20:] + prose(3, 7).split() + w[:20])
    rows = [(1, prose(1, 200) + " " + item.upper() + "! " + prose(2, 30)), (2, moved), (3, " ".join(w[:10]) + " " + prose(4, 60)), (4, prose(5, 300)), (5, ", ".join(w[:24])), (None, item), (7, None), (8, ""), (9, "pi ka"), (10, "x pi ka y")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "pi, ka"), (None, prose(900, 30)), (1, item)], ITEMS)
    got = {(r.doc, r.item): (r.covered, r.n_tiles) for r in dc.matches(docs, items).collect()}
    assert got == {(1, 1): (40, 1), (2, 1): (40, 2), (5, 1): (24, 1), (None, 1): (40, 1), (9, 4): (2, 1), (10, 4): (2, 1)}
    kept = extra(docs, "_leak", "item")
    left = dc.decontaminate(kept, items)
    assert left.columns == kept.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 7, 8]


def test_query_rows_against_tiling_of_all_pairs(spark):
    r = random.Random(4)
    items = [(i, prose(i, r.randint(3, 40))) for i in range(12)]
    rows = []
    for d in range(60):
        text = prose(1000 + d, r.randint(0, 80)).split()
        if d % 3 == 0:
            w = items[r.randrange(12)][1].split()
            cut = r.randint(1, len(w))
            text[len(text) // 2:len(text) // 2] = w[:cut]
        rows.append((d, " ".join(text)))
    got = {(x.doc, x.item): x.covered for x in dc.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()}
    want = {}
    for d, t in rows:
        for i, x in items:
            n = tile_by_hand(t.split(), x.split(), dc.MIN_MATCH)
            if n / len(x.split()) >= dc.COVERAGE:
                want[d, i] = n
    assert got == want and len(want) > 5


def test_awkward_rows_and_empty_tables(spark):
    docs, items = spark.createDataFrame(awkward(), DOCS), spark.createDataFrame([(1, prose(13, 63))], ITEMS)
    assert {(r.doc, r.item) for r in dc.matches(docs, items).collect()} == {(3, 1)}
    assert dc.decontaminate(docs, items).count() == len(awkward()) - 3
    none = spark.createDataFrame([], ITEMS)
    assert dc.matches(docs, none).count() == 0 and dc.decontaminate(docs, none).count() == len(awkward())
    assert dc.matches(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_a_full_filter_loses_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(dc, "FILTER_BITS", bits)
    docs, items = spark.createDataFrame(awkward(), DOCS), spark.createDataFrame([(1, prose(13, 63)), (2, prose(14, 64))], ITEMS)
    assert {(r.doc, r.item) for r in dc.matches(docs, items).collect()} == {(3, 1), (4, 2)}
