"""A convolution over the 64-value length profile, whose gradients are summed where the rows lie.

A peak in the profile means the same wherever the padding puts it, so filters
slide over it: every window of WIDTH neighbours is one row of an unfolded
matrix, a filter is a product with it, and its largest and its mean answer
are what the output layer sees. Rows are read from a written table in every
epoch; a task gives one gradient, Spark adds them by position, and the driver
holds weights only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .flows import KEYS, SHARE_NAMES

WIDTH, FILTERS = 5, 24


def unfolded(x: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """(rows, windows, width): all runs of neighbours of each row."""
    return np.lib.stride_tricks.sliding_window_view(x, width, axis=1)


@dataclass
class ProfileNet:
    """filters (F, WIDTH), bias (F), output (2 F, classes), offset (classes)."""

    filters: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    offset: np.ndarray

    @classmethod
    def start(cls, classes: int, filters: int = FILTERS, seed: int = 42) -> ProfileNet:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, (2 / WIDTH) ** 0.5, (filters, WIDTH)), np.zeros(filters), r.normal(0, filters**-0.5, (2 * filters, classes)), np.zeros(classes))

    def parts(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.output, self.offset]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def with_weights(self, flat: np.ndarray) -> ProfileNet:
        ends = np.cumsum([p.size for p in self.parts()])[:-1]
        return ProfileNet(*[f.reshape(p.shape) for f, p in zip(np.split(flat, ends), self.parts())])

    def answers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, filter answers over 0, what the output layer sees)."""
        w = unfolded(x)
        a = np.maximum(np.einsum("nwk,fk->nwf", w, self.filters, optimize=True) + self.bias, 0)
        return w, a, np.concatenate([a.max(axis=1), a.mean(axis=1)], axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.answers(x)[2] @ self.output + self.offset
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradient(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """(loss, gradient) summed over the rows, as flat as the weights."""
        w, a, seen = self.answers(x)
        z = seen @ self.output + self.offset
        z = z - z.max(axis=1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        rows = np.arange(len(x))
        loss = float(-(weight * np.log(np.maximum(p[rows, label], 1e-300))).sum())
        p[rows, label] -= 1
        p *= weight[:, None]
        back = p @ self.output.T
        f = len(self.bias)
        # the largest answer passes its share on to one window, the mean to all
        da = np.broadcast_to(back[:, None, f:] / a.shape[1], a.shape).copy()
        da[rows[:, None], a.argmax(axis=1), np.arange(f)] += back[:, :f]
        da *= a > 0
        parts = [np.einsum("nwf,nwk->fk", da, w, optimize=True), da.sum(axis=(0, 1)), seen.T @ p, p.sum(axis=0)]
        return loss, np.concatenate([g.ravel() for g in parts])


def _profiles(rows: DataFrame) -> DataFrame:
    return rows.withColumn("profile", F.array(*[F.coalesce(F.col(c), F.lit(0.0)).cast("double") for c in SHARE_NAMES]))


def fit_profile_net(train: DataFrame, classes: int, root: str, epochs: int = 120, rate: float = 0.03, seed: int = 42) -> tuple[ProfileNet, list[float]]:
    """(network, loss by epoch) from rows of `label` and the profile columns; labels weigh the same together, whatever their counts.

    Adam on full gradients. `root` is a folder that all executors reach.
    """
    sizes = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))  # a row per class
    share = sizes.agg(F.count(F.lit(1)).alias("labels"))
    weights = sizes.join(F.broadcast(share)).select(F.col("label").alias("of"), (1 / (F.col("labels") * F.col("n"))).alias("weight"))
    path = f"{root}/{uuid.uuid4().hex}"
    _profiles(train).join(F.broadcast(weights), F.col("label") == F.col("of")).select(F.col("label").cast("int").alias("label"), "weight", "profile").write.parquet(path)
    data = train.sparkSession.read.schema("label int, weight double, profile array<double>").parquet(path)
    net, losses = ProfileNet.start(classes, seed=seed), []
    flat = net.flat()
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for epoch in range(1, epochs + 1):
        held = net.with_weights(flat)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loss, total = 0.0, np.zeros(len(flat))
            for b in batches:
                if len(b):
                    more, g = held.gradient(np.stack(b["profile"].to_numpy()), b["label"].to_numpy(), b["weight"].to_numpy())
                    loss, total = loss + more, total + g
            yield pd.DataFrame({"place": np.arange(-1, len(total)), "value": np.concatenate([[loss], total])})

        summed = {r.place: r.value for r in data.mapInPandas(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()}
        losses.append(summed[-1])
        g = np.array([summed[k] for k in range(len(flat))])
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        flat = flat - rate * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.999**epoch)) + 1e-8)
    return net.with_weights(flat), losses


def score_profiles(net: ProfileNet, rows: DataFrame) -> DataFrame:
    """(flow keys, p_net): the probability of every class, for all rows."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = net.probabilities(np.stack(b["profile"].to_numpy())) if len(b) else np.zeros((0, 1))
            yield b[KEYS].assign(p_net=list(p))

    return _profiles(rows).select(*KEYS, "profile").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", p_net array<double>")
