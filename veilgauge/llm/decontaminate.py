"""Benchmark decontamination by greedy string tiling.

Documents shrink in the scan to their runs of benchmark windows; all later
steps move only those runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import free_name, written
from .words import ALPHANUMERIC, SHINGLE, mix, slices, windows, words

#: Tokens of the shortest tile; also the length of the shared seeds.
MIN_MATCH = 5
#: Share of an item's tokens that tiles must cover.
COVERAGE = 0.5
#: Bits of the seed filter, whatever the size of the benchmark: a fuller filter lets more through, never less.
FILTER_BITS = 1 << 23
_RUN = "array<struct<at:long,tokens:array<long>>>"


def _tokens(texts: pa.Array):
    return words(texts, ALPHANUMERIC, lower=True)


def benchmark_tokens(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, tokens, seeds): hashes of an item's tokens and of its windows of MIN_MATCH tokens; a shorter item is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                w = _tokens(batch.column(1).slice(low, high - low))
                first, seed = windows(w, MIN_MATCH, short=True)
                cut = np.searchsorted(first, w.split)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low),
                    pa.ListArray.from_arrays(pa.array(w.split, pa.int32()), pa.array(w.hash.view(np.int64), pa.int64())),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(seed.view(np.int64), pa.int64()))], ["item", "tokens", "seeds"])

    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "item long, tokens array<long>, seeds array<long>").filter(F.size("tokens") > 0)


def seed_filter(bench: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits over all seeds; the driver gets at most FILTER_BITS / 64 words, for any benchmark."""
    places = F.explode(F.transform("seeds", lambda seed: F.pmod(seed, F.lit(FILTER_BITS))))
    bits = bench.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    for word, value in bits.collect():
        bitmap[word] = np.uint64(value & (1 << 64) - 1)
    return bitmap


def benchmark_runs(docs: DataFrame, bitmap: np.ndarray, short_lengths: tuple[int, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_key, n_tokens, runs, seeds) of every document with a window in the filter.

    A run is a longest stretch of tokens covered by such windows, `at` its
    place. Each tile lies in one run, since all windows of a tile are seeds, so
    nothing else of the text is needed. short_lengths: token counts under
    MIN_MATCH that items have; windows of these lengths are sought as well.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = pa.schema([("doc", pa.int64()), ("text_key", pa.string()), ("n_tokens", pa.int64()), ("runs", pa.list_(pa.struct([("at", pa.int64()), ("tokens", pa.list_(pa.int64()))]))), ("seeds", pa.list_(pa.int64()))])
    modulus = np.uint64(FILTER_BITS)

    def passing(first, seed, bits):
        place = seed % modulus  # FILTER_BITS is a power of two, so this agrees with pmod of the signed value
        keep = (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return first[keep], seed[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for low, high in slices(batch.column(2)):
                ids, keys = (batch.column(i).slice(low, high - low) for i in (0, 1))
                w = _tokens(batch.column(2).slice(low, high - low))
                found = [(*passing(*windows(w, MIN_MATCH), bits), MIN_MATCH)]
                for k in short_lengths:
                    first, seed = windows(w, k)
                    # a short item's window is salted by its length, see words.windows
                    found.append((*passing(first, _short_seed(w, first, k), bits), k))
                if not any(len(f) for f, _, _ in found):
                    continue
                cover = np.zeros(len(w.start) + 1, np.int64)
                for first, _, k in found:
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + k, -1)
                inside = np.cumsum(cover[:-1]) > 0
                text_of = w.text
                turn = np.ones(len(inside) + 1, bool)
                turn[1:-1] = (inside[1:] != inside[:-1]) | (text_of[1:] != text_of[:-1])
                at = np.flatnonzero(turn)
                held = inside[at[:-1]]
                rows: dict[int, dict] = {}
                for a, b in zip(at[:-1][held].tolist(), at[1:][held].tolist()):
                    t = int(text_of[a])
                    row = rows.setdefault(t, {"doc": ids[t].as_py(), "text_key": keys[t].as_py(), "n_tokens": int(w.counts[t]), "runs": [], "seeds": set()})
                    row["runs"].append({"at": int(a - w.split[t]), "tokens": w.hash[a:b].view(np.int64).tolist()})
                for first, seed, _ in found:
                    for f, s in zip(first.tolist(), seed.view(np.int64).tolist()):
                        rows[int(text_of[f])]["seeds"].add(s)
                yield pa.RecordBatch.from_pylist([r | {"seeds": sorted(r["seeds"])} for _, r in sorted(rows.items())], kind)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), text_key(text).alias("text_key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc long, text_key string, n_tokens long, runs {_RUN}, seeds array<long>")


def text_key(text: str):
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _short_seed(w, first: np.ndarray, k: int) -> np.ndarray:
    """Hash of k < MIN_MATCH tokens as a window of a short text has it."""
    value = np.zeros(len(first), np.uint64)
    for j in range(k):
        value = value * SHINGLE + w.hash[first + j]
    return mix(value + np.uint64(k))


def tiles(runs: list[tuple[int, list[int]]], item: list[int], shortest: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of an item with the runs of a document: (place in document, place in item, length).

    Running Karp-Rabin matching: windows of the search length are hashed on
    both sides by a rolling hash, equal ones compared token by token and
    extended; the longest unmarked matches are marked first, then shorter ones.
    Ties go to the earlier place in the item, then in the document.
    """
    shortest = min(shortest, len(item))
    mask, base = (1 << 61) - 1, 1_000_003
    free_item = [True] * len(item)
    free_run = [[True] * len(tokens) for _, tokens in runs]

    def rolling(tokens: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
        value, streak, top = 0, 0, pow(base, length, mask)
        for i, token in enumerate(tokens):
            value = (value * base + token) % mask
            if i >= length:
                value = (value - tokens[i - length] * top) % mask
            streak = streak + 1 if free[i] else 0
            if streak >= length:
                yield i - length + 1, value

    marked = []
    length = max(shortest, max((len(t) for _, t in runs), default=0) // 2)
    while True:
        index: dict[int, list[int]] = {}
        for p, value in rolling(item, free_item, length):
            index.setdefault(value, []).append(p)
        matches: list[tuple[int, int, int, int]] = []
        for r, (_, tokens) in enumerate(runs):
            for q, value in rolling(tokens, free_run[r], length):
                for p in index.get(value, ()):
                    if p and q and free_item[p - 1] and free_run[r][q - 1] and item[p - 1] == tokens[q - 1]:
                        continue  # part of a match that begins earlier
                    n = 0
                    while p + n < len(item) and q + n < len(tokens) and free_item[p + n] and free_run[r][q + n] and item[p + n] == tokens[q + n]:
                        n += 1
                    if n >= length:
                        matches.append((-n, p, r, q))
        if matches and -min(matches)[0] >= 2 * length:
            length = -min(matches)[0]  # a very long match: search again at its length
            continue
        cut = False
        for n, p, r, q in sorted(matches):
            n = -n
            if all(free_item[p:p + n]) and all(free_run[r][q:q + n]):
                free_item[p:p + n] = [False] * n
                free_run[r][q:q + n] = [False] * n
                marked.append((runs[r][0] + q, p, n))
            else:
                cut = True  # what is left of it may still be a match of this length
        if cut:
            continue
        if length == shortest:
            return sorted(marked)
        length = max(shortest, length // 2)


def _matches(docs: DataFrame, items: DataFrame, coverage: float, doc_id: str, text: str, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Tiles of every text of a document id with every item, `coverage` reached; see matches."""
    bench = written(benchmark_tokens(items, item_id, item_text).withColumn("item_row", F.monotonically_increasing_id()), "benchmark")
    short = tuple(r[0] for r in bench.select(F.size("tokens").alias("n")).filter(F.col("n") < MIN_MATCH).distinct().sort("n").collect())
    runs = written(benchmark_runs(docs, seed_filter(bench), short, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "benchmark-runs")
    seeds = bench.select("item_row", F.size("tokens").alias("size"), F.explode("seeds").alias("seed")).groupBy("item_row", "seed", "size").agg(F.count(F.lit(1)).alias("places"))
    shared = runs.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed")
    # a window covers MIN_MATCH tokens at most: pairs that cannot reach the coverage are not tiled
    pairs = shared.groupBy("row", "item_row").agg((F.sum("places") * MIN_MATCH / F.max("size")).alias("bound")).filter(F.col("bound") >= coverage).select("row", "item_row")
    texts = bench.select("item_row", "item", F.col("tokens").alias("item_tokens"))

    @F.arrow_udf("array<struct<at:long,item_at:long,length:long>>")
    def tiled(run: pa.Array, tokens: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("at", pa.int64()), ("item_at", pa.int64()), ("length", pa.int64())]))
        rows = []
        for r, t in zip(run.to_pylist(), tokens.to_pylist()):
            rows.append([{"at": a, "item_at": p, "length": n} for a, p, n in tiles([(x["at"], x["tokens"]) for x in r], t)])
        return pa.array(rows, kind)

    full = pairs.join(runs.select("row", "doc", "text_key", "runs"), "row").join(texts, "item_row").withColumn("tiles", tiled("runs", "item_tokens"))
    covered = F.aggregate("tiles", F.lit(0).cast("long"), lambda n, t: n + t["length"])
    judged = full.select("doc", "text_key", "item", F.size("tiles").cast("long").alias("n_tiles"), covered.alias("covered"), F.size("item_tokens").cast("long").alias("item_tokens"), "tiles")
    return judged.withColumn("coverage", F.col("covered") / F.col("item_tokens")).filter(F.col("coverage") >= coverage)


def matches(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, item, n_tiles, covered, item_tokens, coverage, tiles) of every document and item with `coverage` or more.

    Tokens are runs of letters, digits and non-ASCII characters, ASCII case
    folded. `coverage` is the share of the item's tokens that tiles of
    MIN_MATCH tokens cover, in any order; an item of fewer tokens must occur
    whole. Null and empty texts have no tokens and match nothing. Of documents
    with one id each text is tiled by itself and the best is kept; null ids
    are one id. Empty tables give no rows.
    """
    best = _matches(docs, items, coverage, doc_id, text, item_id, item_text).groupBy("doc", "item").agg(F.max(F.struct("covered", "n_tiles", "item_tokens", "coverage", "tiles")).alias("b"))
    return best.select("doc", "item", "b.n_tiles", "b.covered", "b.item_tokens", "b.coverage", "b.tiles")


def decontaminate(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that reach `coverage` of no item; all columns and repeated rows stay.

    Rows are told apart by id and text, so a clean text stays though another of its id goes.
    """
    row, leak = free_name(docs, "_row_key"), free_name(docs, "_leak")
    key = lambda k, d: F.concat_ws(" ", k, F.coalesce(d.cast("string"), F.lit("-")))
    found = written(_matches(docs, items, coverage, doc_id, text).select(key(F.col("text_key"), F.col("doc")).alias(leak)).distinct(), "leaks")
    return docs.withColumn(row, key(text_key(text), F.col(doc_id).cast("long"))).join(found, F.col(row) == F.col(leak), "left_anti").drop(row)
