"""Hard negatives by angular triangle filtering: stored angles bound every score before it is computed.

Every row keeps its angles to a few reference directions and its norm. The angle
between two rows lies between the difference and the sum of their angles to a
reference, so its cosine lies in an interval, and the integer score in that
interval times both norms, rounded outwards. Anchors meet rows in cells of two
blocks; inside a cell a small run of anchors of like angles takes integer scores
of just those rows whose window of possible scores overlaps the wanted one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import forget, written
from .vectors import pack_rows, padded, unpack_rows, whole_numbers, widened

#: Reference directions, fitted on SAMPLE rows at most (those of the least hashes); every row is stored and searched.
REFERENCES, SAMPLE = 8, 4096
#: Rows of a block and anchors of a block: a cell holds one of each.
ROW_BLOCK, ANCHOR_BLOCK = 8192, 16384
#: Anchors whose angles share one window; they follow each other by label, nearest reference and angle.
RUN = 64
#: Angles are kept in 32 bits; both angles of a bound may be off by less than this in all.
SLACK = 1e-6
_BLOCK_COLUMNS = "block long, n int, label_low long, label_high long, angle_low array<double>, angle_high array<double>, norm_low double, norm_high double, ids binary, labels binary, rows binary, width int, angles binary"


# --- angles and bounds ---------------------------------------------------------------------------------

def fit_references(x: np.ndarray, count: int = REFERENCES, rounds: int = 8) -> np.ndarray:
    """Unit directions: spherical means of the sample, begun at rows far from each other. One at least."""
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    unit = x[norm > 0] / norm[norm > 0, None]
    if not len(unit):
        return np.eye(1, max(x.shape[1], 1))
    means, nearest = unit[:1], unit @ unit[0]
    while len(means) < min(count, len(unit)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-9:
            break
        means, nearest = np.vstack([means, unit[far]]), np.maximum(nearest, unit @ unit[far])
    for _ in range(rounds):
        own = (unit @ means.T).argmax(axis=1)
        sums = np.stack([unit[own == k].sum(axis=0) for k in range(len(means))])
        size = np.sqrt((sums**2).sum(axis=1))
        means = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], means)
    return means


def angles_of(x: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles to every reference); a row of zeros has angle 0, its scores are 0 whatever the angle."""
    dims = max(x.shape[1], references.shape[1])
    x, references = widened(x, dims).astype(np.float64), widened(references, dims)
    norm = np.sqrt((x**2).sum(axis=1))
    cosine = np.clip((x @ references.T) / np.where(norm > 0, norm, 1)[:, None], -1, 1)
    return norm, np.where(norm[:, None] > 0, np.arccos(cosine), 0.0)


def score_bounds(low: np.ndarray, high: np.ndarray, norm_low: float, norm_high: float, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score of each row with any anchor whose angles lie in [low, high] and norm in [norm_low, norm_high].

    Widened by more than the errors of stored angles and of floating point.
    """
    least = np.maximum(np.maximum(low - angles, angles - high), 0).max(axis=1) - SLACK
    greatest = np.minimum(high + angles, 2 * np.pi - low - angles).min(axis=1) + SLACK
    top, bottom = np.cos(np.clip(least, 0, np.pi)), np.cos(np.clip(greatest, 0, np.pi))
    slack = 1 + 1e-9 * norm_high * norms
    return norms * bottom * np.where(bottom > 0, norm_low, norm_high) - slack, norms * top * np.where(top > 0, norm_high, norm_low) + slack


def exact_scores(a: np.ndarray, b: np.ndarray, norm_a: float, norm_b: float) -> np.ndarray:
    """Integer inner products. No partial sum exceeds the product of norms, so below 2**24 (2**53) floats of 32 (64) bits are exact."""
    bound = norm_a * norm_b * (1 + 1e-9)
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    scores = a.astype(object).dot(b.astype(object).T)
    if max(abs(s) for s in scores.ravel()) >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits")
    return scores.astype(np.int64)


# --- blocks --------------------------------------------------------------------------------------------

def indexed(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """(id, label, x) with the nearest reference and the angle to it, by which rows are ordered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, angles = angles_of(unpack_rows(batch.column(2).to_pylist()), references)
            near = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(angles[np.arange(len(near)), near])], ["id", "label", "x", "near", "angle"])

    return rows.mapInArrow(run, "id long, label long, x binary, near int, angle double")


def blocks(rows: DataFrame, references: np.ndarray, size: int) -> DataFrame:
    """Rows in order of label, nearest reference and angle, `size` to a block. Repeated rows are kept once.

    Ranges end with id and vector, so one label or one vector may be most rows.
    """
    order = ["label", "near", "angle", "id", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, last = TaskContext.get().partitionId() << 32, [], None

        def close(part: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            x = unpack_rows([p[2] for p in part])
            labels = np.array([p[1] for p in part], np.int64)
            norm, angles = angles_of(x, references)
            kind = np.int16 if abs(x).max(initial=0) < 1 << 15 else np.int64
            number += 1
            return pa.RecordBatch.from_pylist([{
                "block": number, "n": len(part), "label_low": int(labels.min()), "label_high": int(labels.max()), "angle_low": angles.min(axis=0).tolist(), "angle_high": angles.max(axis=0).tolist(),
                "norm_low": float(norm.min()), "norm_high": float(norm.max()), "ids": np.array([p[0] for p in part], np.int64).tobytes(), "labels": labels.tobytes(),
                "rows": x.astype(kind).tobytes(), "width": np.dtype(kind).itemsize, "angles": angles.astype(np.float32).tobytes()}], schema)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row != last:
                    held.append(row)
                last = row
                if len(held) == size:
                    yield close(held)
                    held = []
        if held:
            yield close(held)

    doubles = pa.list_(pa.float64())
    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("label_low", pa.int64()), ("label_high", pa.int64()), ("angle_low", doubles), ("angle_high", doubles), ("norm_low", pa.float64()),
                        ("norm_high", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("rows", pa.binary()), ("width", pa.int32()), ("angles", pa.binary())])
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "label", "x")
    return written(ranged.mapInArrow(run, _BLOCK_COLUMNS), "vector-blocks")


class Block:
    """A block as arrays."""

    def __init__(self, row: dict):
        n = row["n"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.x = np.frombuffer(row["rows"], np.int16 if row["width"] == 2 else np.int64).reshape(n, -1) if row["rows"] else np.zeros((n, 0), np.int64)
        self.angles = np.frombuffer(row["angles"], np.float32).reshape(n, -1).astype(np.float64)
        self.norms = np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1))


def _meetings(anchors: DataFrame, rows: DataFrame, wanted: Column) -> DataFrame:
    """Pairs of an anchor block and a row block that may hold a wanted score, from the blocks' bounds alone.

    Every anchor is a stated query against all rows, so the pairs of blocks are
    listed, one row each without vectors, and thinned before any vector moves.
    """
    bound = ["block", "label_low", "label_high", "angle_low", "angle_high", "norm_high"]
    left = anchors.select(*[F.col(c).alias(f"a_{c}") for c in bound], *[F.col(c) for c in anchors.columns if c.startswith("need")])
    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in bound])
    numbers = [r[0] for r in anchors.select("block").collect()]
    listed = right.withColumn("a_block", F.explode(F.array(*[F.lit(i) for i in numbers]))) if numbers else right.withColumn("a_block", F.lit(0).cast("long")).limit(0)
    return listed.join(left, "a_block").filter(wanted).select("a_block", "r_block")


def _greatest_score() -> Column:
    """Upper bound of all scores between two blocks."""
    gap = F.array_max(F.transform(F.arrays_zip("a_angle_low", "a_angle_high", "r_angle_low", "r_angle_high"), lambda z: F.greatest(
        z["a_angle_low"] - z["r_angle_high"], z["r_angle_low"] - z["a_angle_high"], F.lit(0.0))))
    norms = F.col("a_norm_high") * F.col("r_norm_high")
    return F.greatest(F.cos(F.greatest(gap - SLACK, F.lit(0.0))), F.lit(0.0)) * norms + 1 + norms * 1e-9


def _cells(anchors: DataFrame, rows: DataFrame, meetings: DataFrame, work, schema: str) -> DataFrame:
    """`work(anchor block, row block)` for every meeting; both sides of a cell are one row."""
    payload = ["n", "ids", "labels", "rows", "width", "angles"]
    met = written(meetings, "meetings")
    left = met.join(anchors.select(F.col("block").alias("a_block"), *payload, *[c for c in anchors.columns if c == "known"]), "a_block")
    right = met.select(F.col("a_block").alias("a_cell"), F.col("r_block").alias("r_cell")).join(rows.select(F.col("block").alias("r_cell"), *payload), "r_cell")
    return left.groupBy("a_block", "r_block").cogroup(right.groupBy("a_cell", "r_cell")).applyInArrow(lambda a, r: work(a.to_pylist()[0], r.to_pylist()[0]), schema)


def _best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first `count` by falling score, then rising id."""
    if len(scores) > count:
        edge = np.partition(scores, len(scores) - count)[len(scores) - count]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:count]


def _runs(a: Block, use: np.ndarray) -> Iterator[tuple[np.ndarray, tuple]]:
    """Runs of at most RUN anchors of one label, with the bounds that score_bounds takes."""
    edges = np.flatnonzero(np.diff(a.labels[use])) + 1
    for part in np.split(use, edges):
        for at in range(0, len(part), RUN):
            i = part[at:at + RUN]
            yield i, (a.angles[i].min(axis=0), a.angles[i].max(axis=0), a.norms[i].min(), a.norms[i].max())


def _scored(a: Block, r: Block, i: np.ndarray, rows: np.ndarray) -> np.ndarray:
    dims = max(a.x.shape[1], r.x.shape[1])
    return exact_scores(widened(a.x[i], dims), widened(r.x[rows], dims), a.norms[i].max(initial=0), r.norms[rows].max(initial=0))


def _positives(count: int):
    """Work of a cell: the best `count` rows of an anchor's own label."""

    def work(left: dict, right: dict) -> pa.Table:
        a, r = Block(left), Block(right)
        found: dict[int, list] = {}
        for i, bounds in _runs(a, np.arange(len(a.ids))):
            label = a.labels[i[0]]
            same = np.arange(*np.searchsorted(r.labels, [label, label + 1]))  # rows stand in order of their labels
            if not len(same):
                continue
            # rows nearest in angle first: what they reach sets the window of the others
            _, top = score_bounds(*bounds, r.angles[same], r.norms[same])
            order = np.argsort(-top, kind="stable")
            at, need = 0, -np.inf
            scores, tried = np.zeros((len(i), 0), np.int64), same[:0]
            while at < len(order) and top[order[at]] >= need:
                rows = same[order[at:at + 4 * RUN]]
                rows = rows[top[order[at:at + 4 * RUN]] >= need]
                scores, tried = np.hstack([scores, _scored(a, r, i, rows)]), np.concatenate([tried, rows])
                at += 4 * RUN
                if scores.shape[1] > count:  # one more than wanted, as an anchor meets itself
                    need = np.partition(scores, scores.shape[1] - count - 1, axis=1)[:, scores.shape[1] - count - 1].min()
            for k, anchor in enumerate(i.tolist()):
                other = np.flatnonzero(r.ids[tried] != a.ids[anchor])
                best = other[_best(scores[k, other], r.ids[tried[other]], count)]
                found[anchor] = list(zip(r.ids[tried[best]].tolist(), scores[k, best].tolist()))
        rows = [(left["a_block"], anchor, int(a.ids[anchor]), p, s) for anchor, some in found.items() for p, s in some]
        return pa.Table.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate([pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])],
                                    names=["a_block", "place", "anchor_id", "positive_id", "positive_score"])

    return work


def _negatives(count: int, low: int, high: int):
    """Work of a cell: for every positive the first `count` rows of other labels in its window of scores."""

    def work(left: dict, right: dict) -> pa.Table:
        a, r = Block(left), Block(right)
        known = {k["place"]: sorted((p["positive_score"], p["positive_id"]) for p in k["positives"]) for k in left["known"]}
        out: list[tuple] = []
        for i, bounds in _runs(a, np.array(sorted(known), np.int64)):
            label = a.labels[i[0]]
            least = [[-(-low * s // 100) for s, _ in known[k]] for k in i.tolist()]
            most = [[high * s // 100 for s, _ in known[k]] for k in i.tolist()]
            bottom, top = score_bounds(*bounds, r.angles, r.norms)
            rows = np.flatnonzero((r.labels != label) & (top >= min(map(min, least))) & (bottom <= max(map(max, most))))
            if not len(rows):
                continue
            scores = _scored(a, r, i, rows)
            for k, anchor in enumerate(i.tolist()):
                s = scores[k]
                some = np.flatnonzero((s >= min(least[k])) & (s <= max(most[k])) & (r.ids[rows] != a.ids[anchor]))
                some = some[np.lexsort((r.ids[rows[some]], -s[some]))]
                falling = -s[some]
                for (score, positive), floor, ceiling in zip(known[anchor], least[k], most[k]):
                    first = int(np.searchsorted(falling, -ceiling, side="left"))
                    for j in some[first:first + count].tolist():
                        if s[j] < floor:
                            break
                        out.append((left["a_block"], anchor, int(a.ids[anchor]), positive, score, int(r.ids[rows[j]]), int(s[j])))
        return pa.Table.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate([pa.int64(), pa.int32(), *[pa.int64()] * 5])],
                                    names=["a_block", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return work


def packed(rows: DataFrame, id: str, label: str, vector: str) -> DataFrame:
    """(id, label, x) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, lengths, values = whole_numbers(batch.column(2))
            keep = pa.array(usable)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(pack_rows(padded(lengths, values)), pa.binary())], ["id", "label", "x"])

    named = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return named.filter(F.col("id").isNotNull() & F.col("label").isNotNull()).mapInArrow(run, "id long, label long, x binary")


def mine(rows: DataFrame, anchor: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         id: str = "vec_id", label: str = "label", vector: str = "embedding", row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where `anchor`, a condition on a column `id`, holds (by
    default ids divisible by 50). Scores are integer inner products of
    floor(256 * c); higher scores come first, ties by smaller id. Positives are
    an anchor's first rows of its own label; for each, the first rows of other
    labels with low * positive <= 100 * negative <= high * positive are
    returned, ranked from 1. Exact: windows only skip scores that cannot be wanted.

    Rows with a null label or id or a null vector, or with a null or not finite
    entry, take no part. Repeated rows (id, label and vector) count once; a row
    of the anchor's own id is no partner of it. Shorter vectors count as filled
    up with zeros. A positive without such negatives gives no row, nor does a
    negative positive score, whose window is empty. Scores beyond 64 bits fail.
    """
    # Written once: the sample, the ranges and both kinds of blocks read it.
    known = written(packed(rows, id, label, vector), "packed-vectors")
    sample = unpack_rows([r.x for r in known.orderBy(F.xxhash64("id", "x")).limit(SAMPLE).select("x").collect()])
    references = fit_references(sample)
    placed = indexed(known, references)
    row_blocks = blocks(placed, references, row_block)
    anchors = blocks(placed.filter(anchor if anchor is not None else F.col("id") % 50 == 0), references, anchor_block)
    forget(known)

    meet = _meetings(anchors, row_blocks, (F.col("a_label_low") <= F.col("r_label_high")) & (F.col("r_label_low") <= F.col("a_label_high")))
    near = _cells(anchors, row_blocks, meet, _positives(positives), "a_block long, place int, anchor_id long, positive_id long, positive_score long")
    first = W.partitionBy("a_block", "place").orderBy(F.desc("positive_score"), "positive_id")
    best = written(near.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= positives).drop("k"), "positives")

    live = best.filter("positive_score >= 0")  # the window of a negative score is empty
    each = live.groupBy("a_block", "place").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    of_block = each.groupBy("a_block").agg(F.collect_list(F.struct("place", "positives")).alias("known"), F.min(F.array_min("positives.positive_score")).alias("need"))
    told = written(anchors.join(of_block, F.col("block") == F.col("a_block")).drop("a_block"), "anchors")
    meet = _meetings(told, row_blocks, _greatest_score() >= F.floor(F.col("need") * low / 100))
    far = _cells(told, row_blocks, meet, _negatives(negatives, low, high), "a_block long, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = W.partitionBy("a_block", "place", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
