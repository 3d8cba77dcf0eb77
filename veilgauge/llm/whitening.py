"""Whitening of embeddings from an exact covariance: bit planes, AND and popcount, then one eigendecomposition."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import forget, written
from .vectors import pack_rows, padded, unpack_rows, whole_numbers, widened

#: Rows whose bit planes are held at once inside a task; a multiple of 64.
CHUNK = 4096
#: Exact sums leave a task as signed digits to this base (a power of two), which Spark adds as longs.
DIGIT_BITS, DIGITS = 30, 7
COMPONENTS = 4


def bit_sliced(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, products) of the columns of a chunk as exact Python integers.

    Every column is shifted by its minimum, so that its entries are not negative,
    and cut into bit planes; a plane is packed across rows into 64-bit words. The
    product of two columns is the sum over their planes p and q of 2**(p + q)
    times the number of ones in the AND of the words. The shift is undone in integers.
    """
    n, d = x.shape
    low = x.min(axis=0) if n else np.zeros(d, np.int64)
    shifted = x.astype(np.uint64) - low.astype(np.uint64)  # modulo 2**64, which the difference never reaches
    bits = int(shifted.max(initial=0)).bit_length()
    rows = np.zeros((-(-n // 64) * 64, d), np.uint64)
    rows[:n] = shifted
    words = np.zeros((d, bits, len(rows) // 64), np.uint64)
    for p in range(bits):
        plane = np.packbits((rows >> np.uint64(p) & np.uint64(1)).astype(np.uint8), axis=0)
        words[:, p] = np.ascontiguousarray(plane.T).view(np.uint64)
    kind = np.int64 if 2 * bits + n.bit_length() < 63 else object
    weight = np.array([1 << p for p in range(bits)], dtype=kind)
    u, uu = np.zeros(d, kind), np.zeros((d, d), kind)
    if bits:
        u = np.bitwise_count(words).sum(axis=2, dtype=np.int64).astype(kind) @ weight
        for i in range(d):
            for p in range(bits):
                ones = np.bitwise_count(words[i, p] & words[i:]).sum(axis=2, dtype=np.int64)
                uu[i, i:] += weight[p] * (ones.astype(kind) @ weight)
        uu = np.where(np.tri(d, k=-1, dtype=bool), uu.T, uu)
    u, uu = u.astype(object), uu.astype(object)
    m = low.astype(object)
    return u + n * m, uu + np.outer(m, u) + np.outer(u, m) + n * np.outer(m, m)


def _digits(value: int) -> list[int]:
    sign, value = (-1, -value) if value < 0 else (1, value)
    return [sign * (value >> DIGIT_BITS * k & (1 << DIGIT_BITS) - 1) for k in range(DIGITS)]


def exact_scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, cross-products) over packed vectors `x`, as Python integers.

    Every task gives one set of sums, whatever its rows; only sums, whose number
    depends on the number of dimensions alone, come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(0, object), np.zeros((0, 0), object)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for at in range(0, len(rows), CHUNK):
                x = unpack_rows(rows[at:at + CHUNK], len(sums))
                more = x.shape[1] - len(sums)
                sums, cross = np.pad(sums, (0, more)), np.pad(cross, (0, more))
                s, c = bit_sliced(x)
                n, sums, cross = n + len(x), sums + s, cross + c
        cells = [(-1, -1, n)] + [(i, -1, v) for i, v in enumerate(sums)] + [(i, j, cross[i, j]) for i in range(len(sums)) for j in range(i + 1)]
        digits = np.array([_digits(int(v)) for _, _, v in cells], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), *[pa.array(digits[:, k]) for k in range(DIGITS)]], names)

    names = ["i", "j", *[f"d{k}" for k in range(DIGITS)]]
    parts = fit.select("x").mapInArrow(run, "i int, j int, " + ", ".join(f"d{k} long" for k in range(DIGITS)))
    total = {(r.i, r.j): sum(r[f"d{k}"] << DIGIT_BITS * k for k in range(DIGITS)) for r in parts.groupBy("i", "j").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)]).collect()}
    d = max([i for i, _ in total], default=-1) + 1
    return total.get((-1, -1), 0), [total.get((i, -1), 0) for i in range(d)], [[total.get((max(i, j), min(i, j)), 0) for j in range(d)] for i in range(d)]


@dataclass
class Whitening:
    """The fit: exact counts and sums, eigenvalues by falling size and their unit vectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def scale(self) -> np.ndarray:
        """1 / sqrt(eigenvalue); 0 for directions without variance, which are not stretched to noise."""
        floor = max(self.trace, 0.0) * len(self.values) * np.finfo(float).eps
        return np.where(self.values > floor, 1 / np.sqrt(np.where(self.values > floor, self.values, 1)), 0.0)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        x = widened(x, len(self.sums))
        largest = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.sums), default=0)
        kind = np.int64 if largest * largest * max(len(self.sums), 1) < 1 << 63 else object
        return self.n * x.astype(kind) - np.array(self.sums, dtype=kind)

    def project(self, deviations: np.ndarray, components: int) -> np.ndarray:
        return (deviations.astype(np.float64) / max(self.n, 1)) @ (self.vectors * self.scale)[:, :components]


def fit(n: int, sums: list[int], cross: list[list[int]]) -> Whitening:
    """Covariance n * C - S S' over n * n, centred as integers; each entry is rounded once, by its division."""
    d = len(sums)
    central = [[n * cross[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    v = np.array([[central[i][j] / (n * n) for j in range(d)] for i in range(d)], np.float64).reshape(d, d)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0) if d else np.zeros(0, int)
    vectors = vectors * np.where(vectors[largest, np.arange(d)] < 0, -1.0, 1.0)
    return Whitening(n, sums, values, vectors, sum(central[i][i] for i in range(d)) / (n * n) if n else 0.0)


def identity_error(distinct: DataFrame, model: Whitening, components: int) -> float:
    """Largest absolute entry of the whitened list's covariance minus the identity, measured over all its rows."""
    live = [k for k in range(min(components, len(model.sums))) if model.scale[k] > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(live), len(live)))
        for batch in batches:
            w = model.project(model.deviations(unpack_rows(batch.column(0).to_pylist(), len(model.sums))), components)[:, live]
            total += w.T @ w  # projections of centred vectors have mean 0
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(live, len(live)), pa.int32()), pa.array(np.tile(live, len(live)), pa.int32()), pa.array(total.ravel())], ["a", "b", "s"])

    if not live:
        return 0.0
    error = F.abs(F.sum("s") / F.lit(float(model.n)) - F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0))
    return distinct.select("x").mapInArrow(run, "a int, b int, s double").groupBy("a", "b").agg(error.alias("e")).agg(F.max("e")).first()[0]


def packed(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, x) of the rows with a vector of finite entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, lengths, values = whole_numbers(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(usable)), pa.array(pack_rows(padded(lengths, values)), pa.binary())], ["id", "x"])

    return rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "id long, x binary")


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: id, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(256 * c). Rows whose vector is null or holds a null
    or an entry that is not finite are left out. The fit list is every distinct
    vector once, so copies change nothing; rows come back as often as they came,
    a null id stays null. Shorter vectors count as filled up with zeros. A
    direction without variance (one distinct vector, say) whitens to 0 and is no
    part of the identity error; `explained` is null where there is no variance at
    all. A deviation beyond 64 bits is null. No usable rows give no rows.
    """
    known = packed(rows, id, vector)
    distinct = written(known.select("x").distinct(), "distinct-vectors")
    model = fit(*exact_scatter(distinct))
    error = identity_error(distinct, model, components)
    forget(distinct)
    k = min(components, len(model.sums))
    explained = [model.values[c] / model.trace if model.trace > 0 else None for c in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                away = model.deviations(unpack_rows(part.column(1).to_pylist(), len(model.sums)))
                square = (away * away).sum(axis=1) if away.shape[1] else np.zeros(len(away), np.int64)
                far = pa.array([int(s) if s < 1 << 63 else None for s in square.tolist()], pa.int64())
                w = model.project(away, components)
                again = np.repeat(np.arange(part.num_rows), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1), part.num_rows), pa.int32()), pa.array(np.full(len(again), model.n, np.int64)),
                    far.take(pa.array(again)), pa.array(w.ravel()), pa.array(explained * part.num_rows, pa.float64()), pa.array(np.full(len(again), error))], names)

    names = [id, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return known.mapInArrow(run, f"`{id}` long, component int, n long, deviation long, whitened double, explained double, identity_error double")
