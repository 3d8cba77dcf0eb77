import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veilgauge.llm import near_dup as nd

from .rows import DOCS, awkward, extra, prose

TWO = "doc_id long, text string"


def profile(text):
    w = [x.lower() for x in text.replace("\n", " ").split(" ") if x]
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    a, b = profile(a), profile(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a | b) for i in a.keys() & b.keys())


def classes_of(rows):
    """Classes by comparing all pairs of texts with words."""
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] and rows[j][1] and rows[i][1].split() and (rows[i][1] == rows[j][1] or jaccard(rows[i][1], rows[j][1]) >= nd.SIMILARITY):
                top[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return Counter((d, ids.get(find(i))) for i, (d, _) in enumerate(rows))


def varied(seed, text, share):
    r = random.Random(seed)
    return " ".join(prose(r.random(), 1) if r.random() < share else w for w in text.split())


def test_probability_jaccard_of_weights():
    r = random.Random(5)
    pack = lambda x: (np.array(sorted(x), np.uint32), None if set(x.values()) == {1} else np.array([x[k] for k in sorted(x)], np.float32))
    for _ in range(200):
        top = r.choice([1, 3])
        a, b = ({k: r.randint(1, top) for k in r.sample(range(12), r.randint(1, 9))} for _ in range(2))
        want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
        assert nd.probability_jaccard(pack(a), pack(b)) == pytest.approx(want)
    assert nd.probability_jaccard(pack(a), pack({k: 5 * v for k, v in a.items()})) == pytest.approx(1)
    assert nd.probability_jaccard(pack({}), pack(a)) == 0 if a else True


def test_profiles_are_counted_shingles():
    got = nd.profiles(pa.array(["a b c d e f", None, "x y", "a b c d e a b c d e"])).to_pylist()
    assert [len(r["marks"]) // 4 for r in got] == [2, 0, 1, 5] and [r["weights"] is None for r in got] == [True, True, True, False]
    assert np.frombuffer(got[3]["weights"], np.float32).sum() == 6


def test_sketches_estimate_it():
    base = prose(3, 200)
    texts = [base, varied(1, base, 0.01), varied(2, base, 0.04), varied(3, base, 0.1), base + " " + base, prose(4, 200), "one two", None]
    estimate = []
    for k in range(12):  # texts that differ in one added word each have sketches of their own
        signs = nd.sketches(pa.array([None if t is None else " ".join(f"{w}{k}" for w in t.split()) for t in texts]))
        estimate.append([(signs[0] == s).mean() for s in signs])
    want = [jaccard(base, t or "") for t in texts]
    assert np.abs(np.mean(estimate, axis=0) - want).max() < 0.05


def test_sketch_does_not_depend_on_the_batch():
    texts = [prose(i, n) for i, n in enumerate((1, 4, 5, 6, 50, 400, 3000))]
    together = nd.sketches(pa.array(texts))
    assert all((nd.sketches(pa.array([t]))[0] == together[i]).all() for i, t in enumerate(texts))


def test_classes_against_all_pairs(spark):
    rows = [(d, t) for d, t, *_ in awkward() if t is None or len(t) < 100_000]
    for g in range(8):
        base = prose(200 + g, 120)
        rows += [(1000 + 50 * g + k, varied(k, base, 0.004 * k)) for k in range(9)]
    rows += [(2000 + k, prose(7, 20) + " " + prose(300 + k, 20)) for k in range(40)]  # a passage in many documents
    got = nd.near_duplicates(spark.createDataFrame(rows, TWO)).collect()
    assert Counter((r.doc, r.class_id) for r in got) == classes_of(rows)


def test_chain_is_one_class_of_verified_links(spark):
    words = prose(1, 400).split()
    rows = [(k, " ".join(words[4 * k:4 * k + 100])) for k in range(40)]  # neighbours similar, ends disjoint
    got = nd.near_duplicates(spark.createDataFrame(rows, TWO)).collect()
    assert {r.class_id for r in got} == {0} and all(r.linked_doc != r.doc and r.similarity >= nd.SIMILARITY for r in got)


def test_every_text_of_a_class_has_a_verified_link(spark):
    rows = []
    for g in range(3):  # plain and repeated shingles, in classes where not every pair is linked
        base = prose(400 + g, 70) + (" " + prose(500, 7)) * (3 * g)
        rows += [(100 * g + k, varied(k, base, 0.008 * (k % 5))) for k in range(14)]
    rows += [(900, prose(600, 50)), (901, prose(600, 50) + " more"), (902, prose(600, 50)), (903, " "), (904, prose(601, 50)), (905, prose(601, 50))]
    text = dict(rows)
    got = nd.near_duplicates(spark.createDataFrame(rows, TWO)).collect()
    assert Counter((r.doc, r.class_id) for r in got) == classes_of(rows)
    class_of = {r.doc: r.class_id for r in got}
    for r in got:
        others = [t for d, t in rows if class_of[d] == r.class_id and t != text[r.doc]]
        assert (r.linked_doc is None) == (r.similarity is None) == (not others)
        if others:
            assert class_of[r.linked_doc] == r.class_id and text[r.linked_doc] != text[r.doc]
            assert r.similarity == pytest.approx(jaccard(text[r.doc], text[r.linked_doc])) and r.similarity >= nd.SIMILARITY


def test_buckets_too_large_for_a_task_are_compared_in_blocks(spark, monkeypatch):
    rows = []
    for g in range(6):  # groups that share most of a passage, so that buckets hold several classes
        base = prose(50, 60) + " " + prose(60 + g, 25)
        rows += [(100 * g + k, varied(k, base, 0.002 * k)) for k in range(8)]
    df = spark.createDataFrame(rows, TWO)
    whole = Counter(map(tuple, nd.near_duplicates(df).select("doc", "class_id").collect()))
    monkeypatch.setattr(nd, "TASK_PAIRS", 3)
    monkeypatch.setattr(nd, "FIRST_BANDS", 1)
    assert Counter(map(tuple, nd.near_duplicates(df).select("doc", "class_id").collect())) == whole == classes_of(rows)


def test_one_of_each_class_stays_with_its_columns(spark):
    df = extra(spark.createDataFrame(awkward(), DOCS), "node", "text_key", "_row_key")
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = Counter(dict.fromkeys([*range(12), 100, 101, 102, 103, 104, 107, 108], 1))
    want[None], want[3] = 2, 2  # the other text of id 3; a null id with and one without a text
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert nd.drop_near_duplicates(df.limit(0)).count() == 0


def test_no_documents(spark):
    assert nd.near_duplicates(spark.createDataFrame([], TWO)).count() == 0
    assert nd.near_duplicates(spark.createDataFrame([(1, None), (2, " ")], TWO)).count() == 2


def test_components_of_links(spark):
    links = spark.createDataFrame([(5, 6), (6, 9), (1, 2), (2, 3), (3, 4), (9, 20), (30, 31)], "a long, b long")
    got = {r.node: r.class_node for r in nd.components(links).collect()}
    assert got == {5: 5, 6: 5, 9: 5, 20: 5, 1: 1, 2: 1, 3: 1, 4: 1, 30: 30, 31: 30}


def test_texts_that_nobody_asks_for_do_not_move(spark, tmp_path):
    """The join that reads texts again exchanges the texts asked for, not all, where it is no broadcast."""
    from veilgauge.llm import near_dup as N

    rows = [(i, " ".join(f"w{i}x{j}" for j in range(400))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    texts = N.distinct_texts(docs, "doc_id", "text")
    spark.conf.set(key, "-1")
    try:
        at = moved()
        known = N.text_profiles(texts.where("first_doc < 4").select("node"), texts, docs, "doc_id", "text")
        assert known.count() == 4
        assert moved() - at < 200_000
    finally:
        spark.conf.set(key, before)
