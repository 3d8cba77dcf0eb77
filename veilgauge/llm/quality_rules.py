"""Quality rules: statistics of whole texts, base rules on them, and an isolation forest for what no single rule sees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import held_out
from .shared import forget, with_result, written
from .words import BLANK_SEPARATED, mix, slices, windows, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
LINE = np.ones(256, bool)
LINE[10] = False
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
MARKS = np.zeros(256, bool)
MARKS[[ord(c) for c in ".,;:!?'\"()-_/\\"]] = True
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")

FEATURES = 6
TREES, TREE_ROWS, DEPTH = 100, 256, 12
#: Places on the scale of scores at which labelled documents are counted; the threshold lies between two of them.
PLACES = 1 << 16
#: Share of documents labelled good that the threshold may reject.
MAX_FALSE_REJECTS = 0.004
FALSE_COST = 3.0
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _repeated(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over (owner, value) rows: value occurs twice or more in its owner; an equal row stands before it."""
    key = mix(value + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, again


def statistics(texts: pa.Array) -> np.ndarray:
    """Rows of STATISTICS, one per text; a null text is empty.

    Words are [^\\x20\\x09-\\x0D]+, lines are split at \\n. word_chars are code
    points in words; n_dup_lines are lines with a word that equal an earlier
    line; n_repeat_words are words in 3-word windows that the text has twice
    or more; n_lines counts lines with a word, n_upper A-Z, n_marks punctuation.
    """
    out = np.zeros((len(texts), len(STATISTICS)), np.int64)
    w = words(texts, BLANK_SEPARATED, lower=False)
    data = w.data

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(total[w.offsets])

    out[:, 0] = w.counts
    out[:, 1] = per_text(BLANK_SEPARATED[data] & ((data & 0xC0) != 0x80))
    out[:, 2] = per_text(SYMBOLS[data])
    lines = words(texts, LINE, lower=False)
    if len(lines.start):
        solid = np.concatenate([[0], np.cumsum(BLANK_SEPARATED[data])])
        worded = solid[lines.end] > solid[lines.start]
        owner = lines.text
        _, again = _repeated(owner[worded], lines.hash[worded])
        out[:, 3] = np.bincount(owner[worded][again], minlength=len(texts))
        out[:, 5] = np.bincount(owner[worded], minlength=len(texts))
    first, value = windows(w, 3)
    if len(first):
        twice, _ = _repeated(w.text[first], value)
        covered = np.zeros(len(w.start), bool)
        for j in range(3):
            covered[first[twice] + j] = True
        out[:, 4] = np.bincount(w.text[covered], minlength=len(texts))
    out[:, 6] = per_text(UPPER[data])
    out[:, 7] = per_text(MARKS[data])
    return out


def features(stats: np.ndarray) -> np.ndarray:
    """Length-free features of rows of STATISTICS, square roots of shares so that small shares count."""
    n, chars, symbols, dup, repeat, lines, upper, marks = stats.astype(np.float64).T
    n, chars = np.maximum(n, 1), np.maximum(chars, 1)
    return np.stack([np.log1p(chars / n), np.sqrt(symbols / n), np.sqrt(dup / np.maximum(lines, 1)), np.sqrt(repeat / n), np.sqrt(upper / chars), np.sqrt(marks / n)], axis=1)


@dataclass
class Forest:
    """Trees as flat arrays: node i of a tree splits on feature[i] at cut[i], or is a leaf whose path length is path[i]."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    normal: float
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / path of a usual search): near 1 for rows that random splits isolate at once."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = self.feature[t, at]
                step = self.left[t, at] + (x[rows, np.maximum(f, 0)] >= self.cut[t, at])
                at = np.where(f >= 0, step, at)
            total += self.path[t, at]
        return 2.0 ** (-total / len(self.feature) / self.normal)


def _usual_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary search tree of n keys."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 0) -> Forest:
    """A forest over random subsamples of the rows x.

    Splits are uniform over the box of a node, which begins as low..high; rows
    where x has none are isolated after few splits.
    """
    random = np.random.default_rng(seed)
    size = 1 << DEPTH + 1
    forest = Forest(np.full((TREES, size), -1, np.int16), np.zeros((TREES, size)), np.zeros((TREES, size), np.int32), np.zeros((TREES, size)), max(_usual_path(min(TREE_ROWS, len(x))), 1.0))
    wide = np.flatnonzero(high > low)
    for t in range(TREES):
        rows = x[random.permutation(len(x))[:TREE_ROWS]]
        used = 1
        stack = [(0, rows, low.copy(), high.copy(), 0)]
        while stack:
            node, part, a, b, depth = stack.pop()
            if depth == DEPTH or len(part) <= 1 or not len(wide):
                forest.path[t, node] = depth + _usual_path(len(part))
                continue
            f = int(random.choice(wide))
            cut = random.uniform(a[f], b[f])
            forest.feature[t, node], forest.cut[t, node], forest.left[t, node] = f, cut, used
            right = part[:, f] >= cut
            b_left, a_right = b.copy(), a.copy()
            b_left[f] = a_right[f] = cut
            stack += [(used, part[~right], a, b_left, depth + 1), (used + 1, part[right], a_right, b, depth + 1)]
            used += 2
    width = int((forest.left.max() + 2))
    forest.feature, forest.cut, forest.left, forest.path = (m[:, :width] for m in (forest.feature, forest.cut, forest.left, forest.path))
    return forest


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_false: float = MAX_FALSE_REJECTS) -> Forest:
    """Forest over documents labelled good; threshold calibrated on all labelled documents.

    The box of the splits, the counts and the threshold come from every labelled
    document that is not held out, whatever its length. The subsamples of the
    trees, which the method asks for, are drawn from all good ones by hash of
    the id. The driver gets those rows and at most PLACES counts. Without good
    labels nothing is anomalous and every document passes.
    """
    rows = labelled_features(docs, labels, doc_id, text)
    x, good = [F.get("x", F.lit(i)) for i in range(FEATURES)], F.col("label") == 1
    box = rows.agg(F.sum(good.cast("long")).alias("good"), *[f(c).alias(f"{n}{i}") for i, c in enumerate(x) for n, f in (("low", F.min), ("high", F.max))]).first()
    if not box["good"]:
        forget(rows)
        return Forest(np.full((1, 1), -1, np.int16), np.zeros((1, 1)), np.zeros((1, 1), np.int32), np.ones((1, 1)), 1.0)
    place = F.pmod(F.xxhash64("doc"), F.lit(1 << 32))
    # a tenth more than the trees can use, so that chance does not leave them short
    drawn = rows.filter(good & (place < int((1 << 32) * min(1.0, 1.1 * TREES * TREE_ROWS / box["good"])))).select(place.alias("place"), "doc", "x").collect()
    drawn = np.array([r["x"] for r in sorted(drawn, key=lambda r: (r["place"], r["doc"]))][:TREES * TREE_ROWS])
    forest = grow(drawn, *(np.array([box[f"{n}{i}"] for i in range(FEATURES)]) for n in ("low", "high")))
    forest.threshold = _cheapest_cut(*score_counts(rows, forest), max_false)
    forget(rows)
    return forest


def labelled_features(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, label, x): features of every labelled document with MIN_WORDS words that is not held out, written once.

    Only features move, no text. Of several labels of one id the least counts,
    of several texts the one of the greatest features.
    """

    @F.arrow_udf("array<double>")
    def featured(texts: pa.Array) -> pa.Array:
        parts = [statistics(texts.slice(a, b - a)) for a, b in slices(texts)]
        stats = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)), np.int64)
        at = pa.array(np.arange(len(stats) + 1) * FEATURES, pa.int32())
        return pa.ListArray.from_arrays(at, pa.array(features(stats).reshape(-1)), mask=pa.array(stats[:, 0] < MIN_WORDS))

    known = labels.select(F.col(doc_id).cast("long").alias("doc"), F.col("quality").cast("int").alias("label")).dropna().filter(~held_out("doc"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).filter(~held_out("doc"))
    told = texts.select("doc", featured("text").alias("x"))
    rows = told.join(known.groupBy("doc").agg(F.min("label").alias("label")), "doc").groupBy("doc", "label").agg(F.max("x").alias("x"))
    return written(rows.filter("x IS NOT NULL"), "labelled")  # a filter before the join would have texts read twice


def score_counts(rows: DataFrame, forest: Forest) -> tuple[np.ndarray, ...]:
    """(least score, greatest score, good rows, other rows) of every place of PLACES on the scale of scores that has rows, in order."""

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(forest.score(x.flatten().to_numpy().reshape(-1, FEATURES)))

    scored = rows.select(score("x").alias("score"), (F.col("label") == 1).cast("long").alias("good"))
    counts = scored.groupBy(F.floor(F.col("score") * PLACES).alias("place")).agg(F.min("score"), F.max("score"), F.sum("good"), F.sum(1 - F.col("good"))).collect()
    return tuple(np.array(c) for c in list(zip(*sorted(map(tuple, counts))))[1:])


def calibrate(scores: np.ndarray, good: np.ndarray, max_false: float) -> float:
    """The cut of least cost over rows of scores, good or not; see _cheapest_cut."""
    order = np.argsort(scores, kind="stable")
    return _cheapest_cut(scores[order], scores[order], good[order].astype(np.int64), (~good[order]).astype(np.int64), max_false)


def _cheapest_cut(least: np.ndarray, greatest: np.ndarray, good: np.ndarray, bad: np.ndarray, max_false: float) -> float:
    """The cut of least cost among those that reject a share `max_false` of good rows at most.

    Groups of rows stand in order of their scores; a cut lies between two groups.
    A rejected good row costs as much as FALSE_COST missed bad ones, by share.
    Of cuts of one cost the middle of the widest gap is taken; without bad rows
    the cut lies at the allowed share.
    """
    n_good, n_bad = good.sum(), bad.sum()
    rejected = n_good - np.concatenate([[0], np.cumsum(good)])  # good rows of group i and after
    missed = np.concatenate([[0], np.cumsum(bad)])
    low, high = np.concatenate([[0.0], greatest]), np.concatenate([least, [1.0]])
    cost = FALSE_COST * rejected / max(n_good, 1) + missed / max(n_bad, 1)
    allowed = (high > low) & (rejected <= max_false * n_good)
    if not n_bad:
        return float(low[allowed][0])
    cost = np.where(allowed, cost, np.inf)
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    i = best[np.argmax(high[best] - low[best])]
    return float((low[i] + high[i]) / 2) if high[i] < 1.0 else float(low[i])


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", forest: Forest | None = None) -> DataFrame:
    """Adds the STATISTICS, base_failed, anomaly and kept to every document; other columns stay.

    base_failed: fewer than MIN_WORDS words, or repeated words over
    MAX_REPEAT_PERCENT percent. kept: not base_failed, and the anomaly score is
    at most the calibrated threshold. Null and empty texts have no words and
    fail the base rules. Rows are judged one by one: repeated rows repeat, ties
    do not arise. Input columns named like a result are replaced.
    """
    forest = forest or fit(docs, labels, doc_id, text)
    kind = pa.struct([*[(s, pa.int64()) for s in STATISTICS], ("anomaly", pa.float64())])

    @F.arrow_udf(", ".join(f"{s} long" for s in STATISTICS) + ", anomaly double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [statistics(texts.slice(a, b - a)) for a, b in slices(texts)]
        stats = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)), np.int64)
        return pa.StructArray.from_arrays([*[pa.array(c) for c in stats.T], pa.array(forest.score(features(stats)))], fields=list(kind))

    out = with_result(docs, "_stats", scored(F.col(text).cast("string")))
    for name in (*STATISTICS, "anomaly"):
        out = with_result(out, name, F.col(f"_stats.{name}"))
    out = with_result(out, "base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    return with_result(out, "kept", ~F.col("base_failed") & (F.col("anomaly") <= forest.threshold)).drop("_stats")
