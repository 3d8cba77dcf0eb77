"""Near-duplicate documents by ProbMinHash: sketch, banding, exact verification, connected classes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import forget, free_name, settings, written
from .words import BLANK_SEPARATED, mix, slices, windows, words

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 24 bands of 5 registers: a pair of similarity 0.8 shares a band with probability 0.99993, of 0.85 with 0.9999992.
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Registers two texts must share to be verified: four standard deviations under the threshold.
MIN_SHARED = int(REGISTERS * SIMILARITY - 4 * (REGISTERS * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
#: Pairs across classes that one task compares; larger buckets are compared in blocks.
TASK_PAIRS = 1 << 18
#: Bands whose buckets are tried first, every text with one leader. What they connect needs no further links in the other bands.
FIRST_BANDS = 8

#: Spark's Bloom filter in front of the join that reads texts again, whatever the sizes: of 4 MB, so 2 million texts pass all but exactly, more let others through to the join.
TEXT_FILTER = {f"spark.sql.optimizer.runtime.bloomFilter.{key}": value for key, value in {
    "enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "64g", "expectedNumItems": "2000000", "maxNumItems": "2000000", "numBits": str(1 << 25)}.items()}


def weighted_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight): windows of five words with their counts; fewer words are one shingle."""
    w = words(texts, BLANK_SEPARATED, lower=True)
    first, value = windows(w, SHINGLE_WORDS, short=True)
    owner = w.text[first] if len(first) else np.zeros(0, np.int64)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(value))).astype(np.float64)


def sketches(texts: pa.Array) -> np.ndarray:
    """One ProbMinHash signature of REGISTERS 32-bit values per text.

    Every shingle is a Poisson process whose rate is its weight; each arrival
    falls into a random register, which keeps the shingle that arrives first.
    A shingle stops once its next arrival is later than every register of its
    text. Registers of two texts agree with their probability Jaccard.
    """
    n = len(texts)
    owner, value, weight = weighted_shingles(texts)
    best, who = np.full(n * REGISTERS, np.inf), np.zeros(n * REGISTERS, np.uint32)
    time, turn, last = np.zeros(len(value)), 0, np.full(n, np.inf)
    while len(value):
        turn += 1
        random = mix(value + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((random >> np.uint64(32)).astype(np.float64) + 0.5) / 2.0**32) / weight
        place = owner * REGISTERS + ((random & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        early = np.flatnonzero(time < best[place])
        if len(early):
            order = early[np.lexsort((value[early], time[early]))[::-1]]  # the earliest is written last and stays
            best[place[order]] = time[order]
            who[place[order]] = (value[order] >> np.uint64(32)).astype(np.uint32)
            changed = owner[early]
            changed = changed[np.concatenate([[True], changed[1:] != changed[:-1]])]
            last[changed] = best.reshape(n, REGISTERS)[changed].max(axis=1)
        live = time < last[owner]
        if not live.all():
            owner, value, weight, time = owner[live], value[live], weight[live], time[live]
    return who.reshape(n, REGISTERS)


def profiles(texts: pa.Array) -> pa.StructArray:
    """Sorted 32-bit fingerprints of a text's shingles and their weights, as bytes; weights are null where all are 1."""
    owner, value, weight = weighted_shingles(texts)
    mark = (value >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((mark, owner))
    mark, weight = mark[order], weight[order].astype(np.float32)
    split = np.searchsorted(owner, np.arange(len(texts) + 1))
    parts = [(mark[a:b], weight[a:b]) for a, b in zip(split[:-1], split[1:])]
    return pa.StructArray.from_arrays([pa.array([m.tobytes() for m, _ in parts], pa.binary()), pa.array([None if (w == 1).all() else w.tobytes() for _, w in parts], pa.binary())], ["marks", "weights"])


def probability_jaccard(a: tuple[np.ndarray, np.ndarray | None], b: tuple[np.ndarray, np.ndarray | None]) -> float:
    """Sum over common shingles i of 1 / sum over j of max(a_j / a_i, b_j / b_i), from (sorted marks, weights or None for ones)."""
    (ma, wa), (mb, wb) = a, b
    if not len(ma) or not len(mb):
        return 0.0
    place = np.minimum(np.searchsorted(ma, mb), len(ma) - 1)
    common = ma[place] == mb
    n = int(common.sum())
    if wa is None and wb is None:
        return n / (len(ma) + len(mb) - n)
    wa = np.ones(len(ma)) if wa is None else wa.astype(np.float64)
    wb = np.ones(len(mb)) if wb is None else wb.astype(np.float64)
    only_a = np.ones(len(ma), bool)
    only_a[place[common]] = False
    rest_a, rest_b, both = wa[only_a].sum(), wb[~common].sum(), np.stack([wa[place[common]], wb[common]])
    kinds, counts = np.unique(both, axis=1, return_counts=True)
    return float(sum(c / (rest_a / x + rest_b / y + (counts * np.maximum(kinds[0] / x, kinds[1] / y)).sum()) for (x, y), c in zip(kinds.T, counts)))


def _profile(marks: bytes, weights: bytes | None) -> tuple[np.ndarray, np.ndarray | None]:
    return np.frombuffer(marks, np.uint32), None if weights is None else np.frombuffer(weights, np.float32)


def distinct_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per distinct text with words: node, text_key, first_doc, sketch. Written once, so that node ids are fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(2)):
                part = batch.slice(low, high - low)
                signs = sketches(part.column(2))
                empty = words(part.column(2), hashed=False).counts == 0
                raw = pa.array([None if e else s.tobytes() for e, s in zip(empty, signs)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), raw], ["doc", "text_key", "sketch"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("text_key"), F.col(text).cast("string").alias("text"))
    signed = rows.mapInArrow(run, "doc long, text_key binary, sketch binary").filter(F.col("sketch").isNotNull())
    once = signed.groupBy("text_key").agg(F.min("doc").alias("first_doc"), F.first("sketch").alias("sketch"))
    return written(once.withColumn("node", F.monotonically_increasing_id()), "texts")


def buckets(texts: DataFrame) -> DataFrame:
    """(band, key, node): a 64-bit key of each band of registers."""
    keys = [F.xxhash64(F.lit(b), F.substring("sketch", b * ROWS * 4 + 1, ROWS * 4)) for b in range(BANDS)]
    return texts.select("node", F.posexplode(F.array(*keys)).alias("band", "key"))


def _plausible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches share MIN_SHARED registers."""

    @F.arrow_udf("int")
    def shared(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(-1, REGISTERS) for x in (a, b))
        return pa.array((left == right).sum(axis=1), pa.int32())

    left = texts.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    right = texts.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(left, "a").join(right, "b").filter(shared("sketch_a", "sketch_b") >= MIN_SHARED).select("a", "b")


def text_profiles(nodes: DataFrame, texts: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, marks, weights) of the given nodes, written once; every text is read from its first document."""
    needed = nodes.distinct().join(texts.select("node", "text_key", "first_doc"), "node")
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("key"), F.col(text).cast("string").alias("text"))
    needed = written(needed.select("node", _row_key(F.hex("text_key"), F.col("first_doc")).alias("row")), "needed")
    # most texts are alone in their buckets. Spark filters the scan by the rows asked for, if one side of the join is told to be selective; else all texts would be exchanged
    found = source.withColumn("row", _row_key(F.hex("key"), F.col("doc"))).join(needed.filter("row > ''"), "row").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(0), *profiles(part.column(1)).flatten()], ["node", "marks", "weights"])

    with settings(docs.sparkSession, TEXT_FILTER):
        done = written(found.mapInArrow(run, "node long, marks binary, weights binary").dropDuplicates(["node"]), "profiles")
    forget(needed)
    return done


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b, similarity): pairs whose profiles have a probability Jaccard of SIMILARITY or more."""

    @F.arrow_udf("double")
    def likeness(marks_a: pa.Array, weights_a: pa.Array, marks_b: pa.Array, weights_b: pa.Array) -> pa.Array:
        rows = zip(*[x.to_pylist() for x in (marks_a, weights_a, marks_b, weights_b)])
        return pa.array([probability_jaccard(_profile(ma, wa), _profile(mb, wb)) for ma, wa, mb, wb in rows], pa.float64())

    left = known.select(F.col("node").alias("a"), F.col("marks").alias("marks_a"), F.col("weights").alias("weights_a"))
    right = known.select(F.col("node").alias("b"), F.col("marks").alias("marks_b"), F.col("weights").alias("weights_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", likeness("marks_a", "weights_a", "marks_b", "weights_b").alias("similarity"))
    return written(both.filter(F.col("similarity") >= SIMILARITY), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, class_node): the least node that a chain of links reaches, for every linked node.

    Rounds of neighbour minimum and pointer jumping on written tables; a round
    is a few joins and the number of rounds grows with the logarithm of the longest chain.
    """
    both = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "edges")
    label = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("u").alias("v"), F.col("label").alias("seen")), "v").groupBy("u").agg(F.min("seen").alias("seen"))
        low = label.select("u", "label").join(near, "u").select("u", "label", F.least("label", "seen").alias("low"))
        # what a node has found is also told to the node that was its label
        told = low.select("u", "low", "label").union(low.select("label", "low", F.lit(None).cast("long"))).groupBy("u").agg(F.min("low").alias("low"), F.max("label").alias("label"))
        jump = told.join(told.select(F.col("u").alias("low"), F.col("low").alias("next")), "low")
        new = written(jump.select("u", F.least("low", "next").alias("new"), "label").select("u", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")), "labels")
        forget(label)
        label = new
        if not new.filter("moved").limit(1).count():
            forget(both)
            return label.select(F.col("u").alias("node"), F.col("label").alias("class_node"))


def _open_buckets(table: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of buckets that still hold more than one class, with class and the number of pairs across classes."""
    known = table.join(classes, "node", "left").withColumn("class_node", F.coalesce("class_node", "node"))
    sizes = known.groupBy("band", "key", "class_node").agg(F.count(F.lit(1)).alias("n")).groupBy("band", "key").agg(
        F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("inner"))
    crossing = written(sizes.select("band", "key", ((F.col("all") * F.col("all") - F.col("inner")) / 2).cast("long").alias("across")).filter("across > 0"), "crossing")
    return known.join(crossing, ["band", "key"])


def _stars(table: DataFrame) -> DataFrame:
    """Pairs of every text of a bucket with the bucket's leader, if of another class; each band has leaders of its own."""
    # Small results are written before they are joined: the join can then split a bucket of very many texts.
    order = F.xxhash64("band", "node")
    leaders = written(table.groupBy("band", "key").agg(F.min_by("node", order).alias("leader"), F.min_by("class_node", order).alias("leader_class")), "leaders")
    led = table.join(leaders, ["band", "key"]).filter("class_node <> leader_class")
    return led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _pieces(rows: DataFrame, pairs, *columns: str) -> DataFrame:
    """Rows of a group with `block`, `low` and `high`: once for every pair of blocks that a row takes part in."""
    blocks = F.ceil(F.sqrt(pairs / TASK_PAIRS)).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks)
    pieces = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(block, j).alias("low"), F.greatest(block, j).alias("high")))
    return rows.select(*columns, block.alias("block"), F.explode(pieces).alias("piece")).select(*columns, "block", "piece.low", "piece.high")


def _across(rows: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b, similarity) between different classes of a bucket.

    A task compares one bucket, or two blocks of a bucket with more than
    TASK_PAIRS pairs across classes. Pairs that share an earlier band are left
    to it, and pairs of classes that a link has just connected need no more
    links. Nothing but links leaves the task.
    """
    dealt = _pieces(rows, F.col("across"), "band", "key", "node", "class_node")

    def compare(table: pa.Table) -> pa.Table:
        signs = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(-1, REGISTERS)
        node, group, block = (table.column(c).to_numpy().copy() for c in ("node", "class_node", "block"))
        low, high, band = (table.column(c)[0].as_py() for c in ("low", "high", "band"))
        marks = [_profile(m, w) for m, w in zip(table.column("marks").to_pylist(), table.column("weights").to_pylist())]
        out = []
        for i in range(len(node) - 1):
            other = group[i + 1:] != group[i]
            if low != high:
                other &= block[i + 1:] != block[i]
            j = np.flatnonzero(other) + i + 1
            equal = signs[j] == signs[i]
            j = j[(equal.sum(axis=1) >= MIN_SHARED) & ~equal[:, :band * ROWS].reshape(len(j), band, ROWS).all(axis=2).any(axis=1)]
            for k in j.tolist():
                if group[k] != group[i] and (likeness := probability_jaccard(marks[i], marks[k])) >= SIMILARITY:
                    out.append((min(node[i], node[k]), max(node[i], node[k]), likeness))
                    group[group == group[k]] = group[i]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64()), "similarity": pa.array([x[2] for x in out], pa.float64())})

    full = dealt.join(texts.select("node", "sketch"), "node").join(known, "node")
    return full.groupBy("band", "key", "low", "high").applyInArrow(compare, "a long, b long, similarity double").distinct()


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(texts, classes, verified links) over the distinct texts of `docs`; see near_duplicates. The caller forgets the links."""
    texts = distinct_texts(docs, doc_id, text)
    table = buckets(texts)
    several = written(table.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size"), "several")
    shared = written(table.join(several, ["band", "key"]), "buckets")
    known = text_profiles(shared.select("node"), texts, docs, doc_id, text)
    alone = shared.filter(F.col("band") < FIRST_BANDS).select("band", "key", "node", F.col("node").alias("class_node"))
    found = [_verified(_plausible(_stars(alone), texts), known)]
    classes = written(components(found[0]), "classes")
    # then all bands, but only buckets that still hold several classes
    rest = written(_open_buckets(shared, classes), "open")
    found.append(_verified(_plausible(_stars(rest), texts), known))
    classes = _joined(classes, found[1])
    rest = written(_open_buckets(rest.select("band", "key", "node"), classes), "open")
    found.append(written(_across(rest, texts, known), "links"))
    classes = _joined(classes, found[2])
    forget(several, shared, known)
    return texts, classes, found


def nearest_links(found: list[DataFrame], texts: DataFrame) -> DataFrame:
    """(node, linked_doc, similarity): of the verified links of every text the closest, ties by the other text's document.

    A text joins a class by a verified link, so every text of a class of several has one.
    """
    both = [x.select(F.col(u).alias("node"), F.col(v).alias("other"), "similarity") for x in found for u, v in (("a", "b"), ("b", "a"))]
    named = functools.reduce(DataFrame.union, both).join(texts.select(F.col("node").alias("other"), F.col("first_doc").alias("linked_doc")), "other")
    # least negated similarity first, then the least document
    return named.groupBy("node").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "linked_doc")).alias("m")).select("node", "m.linked_doc", (-F.col("m.s")).alias("similarity"))


def _joined(classes: DataFrame, more: DataFrame) -> DataFrame:
    """Classes after more links: only links between classes are walked, so late rounds are small."""
    if not more.limit(1).count():
        return classes
    of = lambda side, name: classes.select(F.col("node").alias(side), F.col("class_node").alias(name))
    lifted = more.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b")
    merged = written(components(lifted), "merged")
    known = classes.join(merged.select(F.col("node").alias("class_node"), F.col("class_node").alias("top")), "class_node", "left").select("node", F.coalesce("top", "class_node").alias("class_node"))
    fresh = merged.join(known.select("node"), "node", "left_anti").select("node", "class_node")
    return written(known.union(fresh), "classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc, class_id, linked_doc, similarity.

    Texts are sets of five-word shingles weighted by their counts (blank-separated
    words, ASCII case folded; a text of fewer words is one shingle). Texts of
    probability Jaccard 0.8 or more are linked; a class is what links connect,
    and class_id its least doc_id. linked_doc is the first document of the text
    that the closest verified link leads to, similarity what was computed for
    it; both are null for a text without links. Equal texts are one text before
    anything is compared, so copies cost no pairs. Documents without words are
    alone: class_id is their own id. Null ids stay null unless the class has
    another. Repeated rows come back as often as they came.
    """
    texts, classes, found = links(docs, doc_id, text)
    nearest = written(nearest_links(found, texts), "nearest")
    forget(*found)
    known = texts.select("node", "text_key", "first_doc").join(classes, "node", "left").withColumn("class_node", F.coalesce("class_node", "node"))
    first = known.groupBy("class_node").agg(F.min("first_doc").alias("class_id"))
    judged = known.join(first, "class_node").join(nearest, "node", "left").select("text_key", "class_id", "linked_doc", "similarity")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("key"))
    return rows.join(judged, F.col("key") == F.col("text_key"), "left").select("doc", F.coalesce("class_id", "doc").alias("class_id"), "linked_doc", "similarity")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class stays, that of the least doc_id; documents without words all stay.

    Of rows with that id and text one stays. The columns are those of `docs`.
    """
    texts, classes, found = links(docs, doc_id, text)
    forget(*found)
    known = texts.select("node", "text_key", "first_doc").join(classes, "node", "left").withColumn("class_node", F.coalesce("class_node", "node"))
    first = known.groupBy("class_node").agg(F.min(F.struct(F.coalesce("first_doc", F.lit((1 << 63) - 1)).alias("o"), "text_key", "first_doc")).alias("f"))
    row, wordless, chosen_row = free_name(docs, "_row_key"), free_name(docs, "_wordless"), free_name(docs, "_chosen_row")
    kept = written(first.select(_row_key(F.hex("f.text_key"), F.col("f.first_doc")).alias(chosen_row)), "kept")
    marked = docs.withColumn(wordless, ~F.coalesce(F.col(text).cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))
    key = _row_key(F.upper(F.md5(F.col(text).cast("binary"))), F.col(doc_id).cast("long"))
    chosen = marked.filter(~F.col(wordless)).withColumn(row, key).join(kept, F.col(row) == F.col(chosen_row), "left_semi").dropDuplicates([row]).drop(row)
    return chosen.union(marked.filter(F.col(wordless))).drop(wordless)


def _row_key(text_key, doc):
    """Text and id as one value that is never null."""
    return F.concat_ws(" ", text_key, F.coalesce(doc.cast("string"), F.lit("-")))
