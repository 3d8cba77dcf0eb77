"""Stores that several writers share, the cap on new links in a stream, and places in orders that no prefix cuts."""

import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tests.test_fleet import table
from veilgauge.operators.posture import positioned_by_range
from veilgauge.sources.commit_log import CommitLog, Conflict
from veilgauge.streaming import peers as PE

ROW = "id bigint"


def ids(log, name="rows", version=None):
    return sorted(r.id for r in log.read(name, ROW, version).collect())


def test_interleaved_writers_lose_and_double_nothing(spark, tmp_path):
    a, b = CommitLog(spark, str(tmp_path)), CommitLog(spark, f"file://{tmp_path}")
    assert ids(a) == [] and not list(tmp_path.iterdir())  # reading creates nothing
    seen, folders = a.latest(), a.write({"rows": spark.range(3)})
    assert ids(b) == []  # not committed
    assert b.append("b", {"rows": spark.range(10, 12)}) == 1
    assert a.commit("a", folders, seen) == 2 and a.commit("a", folders, seen) is None
    assert b.append("a", {"rows": spark.range(3)}) is None
    assert ids(a) == ids(b) == [0, 1, 2, 10, 11] and ids(a, version=1) == [10, 11]


def test_many_writers_at_once(spark, tmp_path):
    def write(i):
        return CommitLog(spark, str(tmp_path)).append(f"t{i % 12}", {"rows": spark.range(i % 12, i % 12 + 1)})

    with ThreadPoolExecutor(8) as pool:
        got = [v for v in pool.map(write, range(24)) if v]
    assert sorted(got) == list(range(1, 13)) and ids(CommitLog(spark, str(tmp_path))) == list(range(12))


def test_a_snapshot_that_was_overtaken_is_made_again(spark, tmp_path):
    log, other = CommitLog(spark, str(tmp_path)), CommitLog(spark, str(tmp_path))
    log.append("1", {"rows": spark.range(4)})
    made = []

    def build(rows):
        made.append(rows.count())
        other.append("2", {"rows": spark.range(4, 9)})
        return rows.agg(F.max("id").alias("id"))

    log.derive("top", "rows", build, ROW)
    assert made == [4, 9] and ids(other, "top") == [8]
    log.derive("top", "rows", lambda rows: rows.agg(F.min("id").alias("id")), ROW)
    assert ids(log, "top") == [0]  # replaced
    with pytest.raises(Conflict):
        log.commit("late", log.write({"rows": spark.range(1)}), seen=1, depends=("rows",))


def test_filter_never_loses_a_link(spark):
    links = spark.range(3000).select(F.concat(F.lit("c"), F.col("id") % 7).alias("capture"), F.col("id").cast("string").alias("peer_key"))
    words = PE.filter_bits(links.where("cast(peer_key AS int) < 1000"), 10).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    able = {int(r.peer_key) for r in PE.maybe_seen(links, words, 10).collect()}
    assert set(range(1000)) <= able and len(able) < 1400


def test_cap_of_a_replayed_stream_is_that_of_the_batch(spark, tmp_path):
    r = random.Random(6)
    rows = [(f"p{r.randrange(40)}", i, r.choice("abc"), 128, 0) for i in range(300)]
    df = table(spark, rows)
    known = spark.createDataFrame([("p0",), ("p1",)], "peer_key string")
    log = CommitLog(spark, str(tmp_path))
    for part, txn in [(0, "x-0"), (0, "x-0"), (1, "x-1"), (2, "x-2"), (1, "x-1")]:
        PE.cap_batch(df.where(f"observed_us >= {part * 100} AND observed_us < {part * 100 + 100}"), txn, log, known, 5, word_bits=4)
    order, want = {}, Counter()
    for p, _, c, *_ in rows:
        place = order.setdefault(c, {}).setdefault(p, len([q for q in order[c] if q not in ("p0", "p1")]) + 1)
        want[c, p, p not in ("p0", "p1") and place > 5] += 1
    got = Counter((x.capture, x.peer_key, x.withheld) for x in log.read("rows", "capture string, peer_key string, withheld boolean").collect())
    assert got == want


def test_places_where_all_names_begin_alike(spark, tmp_path):
    rows = [("hot", "the-same-long-prefix-" + str(i)) for i in random.Random(7).sample(range(10 ** 6), 4000)] + [("cold", "x"), (None, "y"), (None, "z")]
    df = spark.createDataFrame(rows, "k string, name string")
    root = str(tmp_path)
    got = positioned_by_range(df, ["k"], [F.asc("name")], root, partitions=16)
    want = {(k, n): i + 1 for key in ("hot", "cold", None) for i, (k, n) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1]))}
    assert {(r.k, r.name): r.pos for r in got.collect()} == want
    # the largest piece of the hot key: twice an even share
    pieces = spark.read.parquet(f"{root}/*").groupBy("range_part").count().agg(F.max("count")).first()[0]
    assert pieces <= 2 * len(rows) / 16
