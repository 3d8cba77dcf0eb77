"""Quality classifier: a convolutional network over the bytes of a whole text, in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import held_out, sample
from .shared import with_result
from .words import bytes_of, slices

#: Labelled documents the network is fitted on, and the longest of them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 1 << 17
#: Bytes a filter sees, bytes between filter positions, positions per chunk: chunks overlap by WIDTH - STRIDE bytes.
WIDTH, STRIDE, CHUNK = 12, 4, 128
EMBED, FILTERS = 6, 32
EPOCHS, BATCH, RATE = 14, 32, 0.006
PASS_SCORE = 0.3
PAD = 256
# Bytes of text laid out at once, and chunks that filters run over at once.
_SLICE, _BLOCK = 1 << 18, 512


def layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(padded bytes, first byte of every position, first position of every chunk, first chunk of every text).

    Positions lie every STRIDE bytes and cover each text to its last byte; an
    empty text is one position of padding.
    """
    data, offsets = bytes_of(texts)
    length = np.diff(offsets)
    n_pos = np.maximum(1, -(-(length - WIDTH) // STRIDE) + 1)
    room = (n_pos - 1) * STRIDE + WIDTH
    base = np.concatenate([[0], np.cumsum(room)])
    padded = np.full(int(base[-1]), PAD, np.int16)
    padded[np.arange(len(data)) + np.repeat(base[:-1] - offsets[:-1], length)] = data
    first = np.concatenate([[0], np.cumsum(n_pos)])
    position = np.repeat(base[:-1], n_pos) + (np.arange(int(first[-1])) - np.repeat(first[:-1], n_pos)) * STRIDE
    n_chunks = -(-n_pos // CHUNK)
    text = np.concatenate([[0], np.cumsum(n_chunks)])
    chunk = np.repeat(first[:-1], n_chunks) + (np.arange(int(text[-1])) - np.repeat(text[:-1], n_chunks)) * CHUNK
    return padded, position, chunk, text


class Network:
    """Byte embedding, filters, maximum over each chunk, then mean and maximum over chunks into one logistic unit."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.embed[PAD] = 0
        self.filters = r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(2 * FILTERS, np.float32)
        self.shift = np.zeros(1, np.float32)
        self.middle = np.zeros(2 * FILTERS, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.shift]

    def forward(self, texts: pa.Array):
        padded, position, chunk, text = layout(texts)
        seen = padded[position[:, None] + np.arange(WIDTH)]
        inputs, active = self._active(seen)
        pooled = np.maximum.reduceat(active, chunk, axis=0)
        document, logit = self._combined(pooled, text)
        return logit, (seen, inputs, active, pooled, document, chunk, text, np.diff(text).astype(np.float32)[:, None])

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probabilities of all texts. A text longer than a slice is pooled block by block, so filters never see it all at once."""
        out = []
        for low, high in slices(texts, _SLICE):
            padded, position, chunk, text = layout(texts.slice(low, high - low))
            pooled = np.empty((len(chunk), FILTERS), np.float32)
            for a in range(0, len(chunk), _BLOCK):
                b = min(a + _BLOCK, len(chunk))
                own = position[chunk[a]:chunk[b] if b < len(chunk) else len(position)]
                pooled[a:b] = np.maximum.reduceat(self._active(padded[own[:, None] + np.arange(WIDTH)])[1], chunk[a:b] - chunk[a], axis=0)
            logit = self._combined(pooled, text)[1]
            out.append(1 / (1 + np.exp(-logit.astype(np.float64))))
        return np.concatenate(out) if out else np.zeros(0)

    def _active(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inputs = self.embed[seen].reshape(len(seen), -1)
        return inputs, np.maximum(inputs @ self.filters + self.bias, 0)

    def _combined(self, pooled: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(text).astype(np.float32)[:, None]
        document = np.concatenate([np.add.reduceat(pooled, text[:-1], axis=0) / n, np.maximum.reduceat(pooled, text[:-1], axis=0)], axis=1)
        return document, (document - self.middle) @ self.out + self.shift

    def gradients(self, texts: pa.Array, wanted: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss. A maximum passes its gradient to the first place that has it."""
        logit, (seen, inputs, active, pooled, document, chunk, text, n) = self.forward(texts)
        slope = ((1 / (1 + np.exp(-logit)) - wanted) / len(wanted)).astype(np.float32)
        d_out, d_shift = (document - self.middle).T @ slope, slope.sum(keepdims=True)
        d_doc = slope[:, None] * self.out
        owner = np.repeat(np.arange(len(text) - 1), np.diff(text))
        d_pooled = (d_doc[:, :FILTERS] / n)[owner]
        top = document[:, FILTERS:][owner] == pooled
        c, f = np.nonzero(top)
        _, once = np.unique(owner[c] * FILTERS + f, return_index=True)
        d_pooled[c[once], f[once]] += d_doc[:, FILTERS:][owner[c[once]], f[once]]
        part = np.repeat(np.arange(len(chunk)), np.diff(np.append(chunk, len(active))))
        p, f = np.nonzero((active == pooled[part]) & (active > 0))
        _, once = np.unique(part[p] * FILTERS + f, return_index=True)
        p, f = p[once], f[once]
        value = d_pooled[part[p], f]
        d_filters, d_bias = np.zeros_like(self.filters), np.bincount(f, value, FILTERS).astype(np.float32)
        d_embed = np.zeros_like(self.embed)
        for k in range(FILTERS):
            own = f == k
            if own.any():
                d_filters[:, k] = inputs[p[own]].T @ value[own]
                back = value[own][:, None] * self.filters[:, k]
                np.add.at(d_embed, seen[p[own]].reshape(-1), back.reshape(-1, EMBED))
        d_embed[PAD] = 0
        return [d_embed, d_filters, d_bias, d_out, d_shift]

    def fit(self, texts: list[str], wanted: np.ndarray, seed: int = 0) -> "Network":
        """Adam over shuffled batches; the same rows in the same order give the same network."""
        random = np.random.default_rng(seed)
        column = pa.array(texts, pa.large_string())
        share = float(np.clip(wanted.mean(), 0.01, 0.99)) if len(wanted) else 0.5
        self.shift[0] = np.log(share / (1 - share))
        if not len(wanted) or wanted.min() == wanted.max():
            return self
        first = [self.forward(column.slice(a, b - a))[1][4] for a, b in slices(column, _SLICE)]
        self.middle = np.concatenate(first).mean(axis=0)
        moment = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        for epoch in range(EPOCHS):
            order = random.permutation(len(texts))
            for low in range(0, len(order), BATCH):
                rows = order[low:low + BATCH]
                step += 1
                rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
                for p, g, (m, v) in zip(self.parameters(), self.gradients(column.take(pa.array(rows)), wanted[rows]), moment):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Network:
    """A network fitted on the driver from a bounded sample of labelled rows that are not held out.

    Without labels, or with labels of one kind only, every score is the share
    of label 1 (a half without any).
    """
    rows = sorted(tuple(r) for r in sample(docs, labels, SAMPLE_ROWS, SAMPLE_BYTES, doc_id, text).select("doc", "label", "text").collect())
    return Network().fit([r[2] for r in rows], np.array([float(r[1] == 1) for r in rows], np.float32))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", network: Network | None = None) -> DataFrame:
    """Adds held_out, score (probability of label 1, from the bytes of the whole text alone) and predicted.

    All rows and other columns stay; columns named like a result are replaced.
    Null and empty texts are scored as padding. Equal texts get equal scores.
    """
    network = network or fit(docs, labels, doc_id, text)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(network.score(texts), pa.float64())

    out = with_result(docs, "held_out", held_out(doc_id))
    out = with_result(out, "score", score(F.col(text).cast("string")))
    return with_result(out, "predicted", (F.col("score") >= PASS_SCORE).cast("int"))


def drop_poor(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the classifier passes, with their own columns only."""
    network = fit(docs, labels, doc_id, text)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(network.score(texts), pa.float64())

    return docs.filter(score(F.col(text).cast("string")) >= PASS_SCORE)
