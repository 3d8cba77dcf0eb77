import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilgauge.llm import mixing
from veilgauge.llm.queries import QUERIES

from .rows import DOCS, awkward, extra, prose


def reshared(sizes, weights, share, most):
    """Targets by literal rounds: cap, share the excess by weight among the others, again."""
    target, free = {}, set(sizes)
    rest = share * sum(sizes.values())
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / total > most * sizes[s]}
        if not over:
            return target | {s: rest * weights[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        rest -= sum(target[s] for s in over)
        free -= over
    return target


def test_targets_against_literal_rounds():
    r = random.Random(2)
    for _ in range(200):
        names = range(r.randint(1, 9))
        sizes, weights = {s: r.choice([0, r.randint(1, 1000)]) for s in names}, {s: r.choice([1.0, 2.0, 3.0]) for s in names}
        assert mixing.capped_targets(sizes, weights, 1.5, 2) == pytest.approx(reshared(sizes, weights, 1.5, 2))
        assert sum(mixing.capped_targets(sizes, weights, 1.5, 2).values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_targets_from_aggregates_equal_those_of_one_pass(spark):
    r = random.Random(4)
    for share in (0.4, 1.5, 2.0, 3.0):
        sizes = {s: r.choice([0, r.randint(1, 5), r.randint(1, 1000)]) for s in range(40)}
        weights = {s: r.choice([1.0, 2.0, 3.0, 50.0]) for s in sizes}
        sources = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source int, size long, weight double")
        got = {x.source: x.target for x in mixing.source_targets(sources, share, 2).collect()}
        assert got == pytest.approx(mixing.capped_targets(sizes, weights, share, 2))
    assert mixing.source_targets(sources.limit(0), 1.5, 2).count() == 0
    with pytest.raises(ValueError):
        mixing.source_targets(sources.withColumn("weight", F.lit(None).cast("double")), 1.5, 2)


def test_more_sources_than_one_network_holds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_MEMBERSHIPS", 20)
    df = spark.range(600).select("id", F.array(F.concat(F.lit("s"), (F.col("id") % 300).cast("string"))).alias("pattern"), (1 + F.col("id") % 7).alias("size"))
    chosen, flows, sources = mixing.mixed(df, mixing.by_turns())
    assert flows.count() == sources.count() == 300 and chosen.count() == 600
    names = sorted(f"s{i}" for i in range(300))
    assert [(x.source, x.weight) for x in sources.sort("at").collect()] == [(n, (3, 1, 2)[i % 3]) for i, n in enumerate(names)]
    ring = spark.range(30).select("id", F.array(*[F.concat(F.lit("s"), ((F.col("id") + k) % 30).cast("string")) for k in (0, 1)]).alias("pattern"), F.lit(5).cast("long").alias("size"))
    with pytest.raises(ValueError):
        mixing.mixed(ring, mixing.by_turns())


def test_connected_parts_flow_as_one_network(spark):
    r = random.Random(6)
    rows = [(i, [f"{g}{s}" for s in r.sample("abcd", r.randint(0, 3))] or None, r.randint(1, 9)) for i, g in ((i, i % 4) for i in range(160))]
    df = spark.createDataFrame(rows, "id long, pattern array<string>, size long")
    total = Counter()
    for _, p, n in rows:
        total[tuple(p or ())] += n
    held = sorted(total)
    names = sorted({s for p in held for s in p})
    chosen, flows, target, _ = mixing.mix(df, {s: 1.0 + (s[1] == "a") for s in names}, share=0.9)
    whole = mixing.min_cost_flow([total[p] for p in held], [[names.index(s) for s in p] for p in held], [round(target[s]) for s in names], 2)
    got = {tuple(f.pattern): f for f in flows.collect()}
    assert sum(f.words for f in got.values()) == sum(sum(f.values()) for f in whole)
    repeats = lambda used: sum(max(0, n - total[p]) for p, n in used.items())
    assert repeats({p: f.words for p, f in got.items()}) == repeats({p: sum(f.values()) for p, f in zip(held, whole)})
    assert chosen.count() == len(rows) and not chosen.filter("size(pattern) = 0 and copies > 0").count()


def test_equal_rows_are_numbered_over_pieces(spark):
    text = prose(3, 30)
    df = spark.range(0, 900, 1, 6).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.col("id").alias("n_chars"))
    other = spark.createDataFrame([(i, prose(i, 30), "en", "b", None) for i in range(2, 400)], DOCS)
    got = Counter(r.n_chars for r in mixing.take_mix(df.union(other)).filter("doc_id = 1").collect())
    want = sum(r.copies for r in mixing.mix_documents(df.union(other)).filter("doc_id = 1").collect())
    assert sum(got.values()) == want and want % 900 and max(got.values()) - min([got[i] for i in range(900)]) == 1


def test_flow_costs_no_more_than_any_other_flow():
    r = random.Random(3)
    for _ in range(60):
        n, m, epochs = r.randint(1, 3), r.randint(1, 3), 2
        capacity = [r.randint(0, 3) for _ in range(n)]
        member = [r.sample(range(m), r.randint(1, m)) for _ in range(n)]
        quota = [r.randint(0, 3) for _ in range(m)]
        flow = mixing.min_cost_flow(capacity, member, quota, epochs)
        cost = lambda used, c: sum(2 * (i // c) + 1 for i in range(used)) if used else 0
        got = (sum(sum(f.values()) for f in flow), -sum(cost(sum(f.values()), c) for f, c in zip(flow, capacity)))
        pairs = [(p, s) for p in range(n) for s in member[p]]
        best = max(((sum(x), -sum(cost(sum(v for (p, _), v in zip(pairs, x) if p == k), capacity[k]) for k in range(n)))
                    for x in itertools.product(range(4), repeat=len(pairs))
                    if all(sum(v for (p, _), v in zip(pairs, x) if p == k) <= epochs * capacity[k] for k in range(n))
                    and all(sum(v for (_, s), v in zip(pairs, x) if s == j) <= quota[j] for j in range(m))), default=(0, 0))
        assert got == best
        assert all(sum(f.get(j, 0) for f in flow) <= quota[j] for j in range(m))


def check(rows, got):
    """rows: (size, source); got: op7 columns with source."""
    sizes = defaultdict(int)
    for n, s in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = reshared(dict(sizes), {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5, 2)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    return target, taken


def test_awkward_rows(spark):
    rows = awkward()
    df = extra(spark.createDataFrame(rows, DOCS), "pattern", "size", "copies")
    got = mixing.mix_documents(df).collect()
    assert len(got) == len(rows)
    check([(len([w for w in (r[1] or "").replace("\n", " ").replace("\t", " ").split(" ") if w]), r[3]) for r in rows], got)
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in mixing.mix_documents(df.repartition(7)).collect())
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_sources_come_near_their_targets(spark):
    r = random.Random(1)
    rows = [(i, prose(i, r.randint(1, 120)), "en", f"s{i % 7}" if i % 3 else "hot", None) for i in range(900)]
    got = mixing.mix_documents(spark.createDataFrame(rows, DOCS)).collect()
    target, taken = check([(len(x[1].split()), x[3]) for x in rows], got)
    assert all(abs(taken[s] - t) <= 0.01 * t + 1 for s, t in target.items())


def best_exchange(sizes, copies, words, epochs=2):
    """Least distance to `words` that dropping one document, adding one, or both, can still bring."""
    taken = sum(n * c for n, c in zip(sizes, copies))
    add = [0] + [n for n, c in zip(sizes, copies) if n and c < epochs]
    drop = [0] + [n for n, c in zip(sizes, copies) if c]
    return min(abs(words - taken - a + b) for a in add for b in drop)


def test_small_sources_end_where_no_exchange_helps(spark):
    r = random.Random(11)
    rows = [(i, prose(i, r.choice([3, 40, 300, 800, 5, 90])), "en", f"s{i % 9}", None) for i in range(90)]
    got = mixing.mix_documents(spark.createDataFrame(rows, DOCS)).collect()
    target, taken = check([(len(x[1].split()), x[3]) for x in rows], got)
    for s, t in target.items():
        own = [x for x in got if x.source == s]
        full = min(x.copies for x in own)  # whole passes stay
        assert abs(round(t) - taken[s]) <= best_exchange([x.size for x in own], [x.copies - full for x in own], round(t) - full * sum(x.size for x in own), 2 - full)


def test_null_and_empty_source_are_two(spark):
    df = spark.createDataFrame([(1, [None, ""], 10), (2, [None], 10), (3, [""], 10)], "id long, pattern array<string>, size long")
    _, flows, _, _ = mixing.mix(df, {None: 1.0, "": 1.0}, share=1.0, epochs=2)
    assert sum(r.words for f in flows.collect() for r in f.routes) == sum(f.words for f in flows.collect()) > 20


def test_overlapping_sources_share_their_documents(spark):
    rows = [(i, ["a"], 10) for i in range(40)] + [(100 + i, ["a", "b"], 10) for i in range(40)] + [(200 + i, ["b"], 10) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, pattern array<string>, size long")
    chosen, flows, target, sizes = mixing.mix(df, {"a": 1.0, "b": 1.0}, share=0.6, epochs=2)
    assert sizes == {"a": 800, "b": 450} and target == {"a": 375.0, "b": 375.0}
    routes = {tuple(f.pattern): f for f in flows.collect()}
    assert all(sum(r.words for f in routes.values() for r in f.routes if r.source == s) == 375 for s in "ab")
    assert all(f.words <= f.total for f in routes.values())  # nothing repeats while anything is unread
    taken = {tuple(k): v for k, v in chosen.groupBy("pattern").agg(F.sum(F.col("copies") * F.col("size"))).collect()}
    assert all(abs(taken[p] - f.words) < 10 for p, f in routes.items())


def test_mix_of_rows_has_each_as_often_as_planned(spark):
    rows = awkward() + [(500 + i, prose(i, 40), "en", f"s{i % 3}", i) for i in range(60)]
    df = extra(spark.createDataFrame(rows, DOCS), "key", "_copies", "_mix_key")
    want = Counter()
    for r in mixing.mix_documents(df).collect():
        want[r.doc_id, r.size] += r.copies
    out = mixing.take_mix(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, len((r.text or "").split(" "))) for r in out.collect() if (r.text or "").strip())
    assert sum(got.values()) == sum(want.values())
    assert {k[0] for k in got} == {k[0] for k, v in want.items() if v}
    assert mixing.take_mix(df.limit(0)).count() == 0


def test_query_columns(spark, tmp_path):
    spark.createDataFrame(awkward(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op7_mixing"](spark, str(tmp_path)).columns == ["doc_id", "size", "source_size", "target", "taken"]
