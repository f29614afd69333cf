"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Inputs of a text: the shares of its words by hash bucket (square roots, unit length),
statistics of its structure (shares of character classes, word and line lengths,
repetition) and the stored length. Every pair of inputs interacts through low-rank
factors; by the identity sum_{i<j} <v_i, v_j> x_i x_j = (|sum v x|^2 - sum |v x|^2) / 2
a text is scored in time linear in its distinct words.

Null text counts as empty and gets a score from its structure alone. Texts of any
length are read whole. Repeated rows get equal scores, a null doc_id is not held out.
Without labels of both classes every score is the share of ones seen (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import map_batches
from lexspark.llm.labels import fold, training_rows
from lexspark.llm.tokens import Hashed, mix, spans

BITS = 15
DENSE = 14

_CLASS = np.full(256, 5, np.uint8)  # other symbols
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:], _CLASS[:33] = 0, 1, 2, 3, 6
_CLASS[[33, 39, 40, 41, 44, 45, 46, 58, 59, 63, 34]] = 4  # common punctuation
_CLASS[10] = 7


def inputs(column: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """CSR (row starts, bucket, value) of word inputs, and the dense inputs."""
    h = Hashed(column)
    rows = len(h.offsets) - 1
    size = np.diff(h.offsets)
    start, end, at = h.words()
    count = np.diff(at)
    bucket = (mix(h.of(start, end)) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.repeat(np.arange(rows, dtype=np.int64), count) << BITS | bucket
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(key)])
    owner, bucket = key[first] >> BITS, key[first] & (1 << BITS) - 1
    value = np.sqrt(times / np.maximum(count, 1)[owner]).astype(np.float32)
    begin = np.searchsorted(owner, np.arange(rows + 1))

    dense = np.zeros((rows, DENSE), np.float32)
    kind = _CLASS[h.data]
    whole = np.maximum(size, 1)
    lines = np.zeros(rows)
    for c in range(8):
        sums = np.concatenate([[0], np.cumsum(kind == c, dtype=np.int64)])
        n = sums[h.offsets[1:]] - sums[h.offsets[:-1]]
        dense[:, c] = n / whole
        if c == 7:
            lines = n
    words = np.maximum(count, 1)
    dense[:, 8] = np.diff(begin) / words  # distinct words
    dense[:, 9] = np.log1p(size)
    dense[:, 10] = np.log1p(np.where(np.isnan(n_chars), size, n_chars)) - np.log1p(size)
    dense[:, 11] = np.log1p(count / (lines + 1))
    sums = np.concatenate([[0], np.cumsum(end - start)])
    dense[:, 12] = (sums[at[1:]] - sums[at[:-1]]) / words
    # Words whose last byte is neither a letter nor common punctuation.
    odd = np.concatenate([[0], np.cumsum(kind[end - 1] == 5)])
    dense[:, 13] = (odd[at[1:]] - odd[at[:-1]]) / words
    return begin, bucket, value, dense


@dataclass
class FactorisationMachine:
    """Weights of a fitted model; ``w`` and ``v`` hold word buckets, then dense inputs."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, begin: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray) -> np.ndarray:
        rows = len(begin) - 1
        z = np.clip((dense - self.mean) / self.scale, -5, 5)
        words = 1 << BITS
        lin = z @ self.w[words:] + self.bias
        s = z @ self.v[words:]
        q = (z * z) @ (self.v[words:] ** 2).sum(1)
        some = np.flatnonzero(np.diff(begin))
        if len(some):
            vx = self.v[bucket] * value[:, None]
            at = begin[some]
            lin[some] += np.add.reduceat(self.w[bucket] * value, at)
            s[some] += np.add.reduceat(vx, at)
            q[some] += np.add.reduceat((vx * vx).sum(1), at)
        assert len(s) == rows
        return lin + 0.5 * ((s * s).sum(1) - q)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], rank: int = 8, epochs: int = 8, rate: float = 0.02, decay: float = 1e-4, prior: float = 0.5, seed: int = 7) -> FactorisationMachine:
    """Adam on the logistic loss; ``parts``: (bucket, value, dense, label) of each text.
    The sample is balanced by class; ``prior`` restores the share of ones in the scores."""
    rng = np.random.default_rng(seed)
    y = np.array([p[3] for p in parts], np.float32)
    dense = np.stack([p[2] for p in parts])
    mean, scale = dense.mean(0), dense.std(0) + 1e-3
    words = 1 << BITS
    theta = np.concatenate([np.zeros((words + DENSE, 1)), rng.normal(0, 0.05, (words + DENSE, rank))], 1).astype(np.float32)
    m1, m2, bias, b1, b2, step = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0.0, 0
    z = np.clip((dense - mean) / scale, -5, 5).astype(np.float32)
    ones = max(y.mean(), 1e-3)
    # Weights so that both classes carry their true share of the loss.
    cost = np.where(y == 1, prior / ones, (1 - prior) / max(1 - ones, 1e-3)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(parts))
        for k in range(0, len(order), 128):
            pick = order[k : k + 128]
            n = [len(parts[i][0]) for i in pick]
            bucket = np.concatenate([parts[i][0] for i in pick] or [np.zeros(0, int)]).astype(np.int64)
            value = np.concatenate([parts[i][1] for i in pick])
            row = np.repeat(np.arange(len(pick)), n)
            allrow = np.concatenate([row, np.repeat(np.arange(len(pick)), DENSE)])
            index = np.concatenate([bucket, np.tile(np.arange(words, words + DENSE), len(pick))])
            x = np.concatenate([value, z[pick].ravel()])
            t = theta[index]
            vx = t[:, 1:] * x[:, None]
            s = np.stack([np.bincount(allrow, vx[:, f], len(pick)) for f in range(rank)], 1)
            lin = np.bincount(allrow, t[:, 0] * x, len(pick)) + bias
            q = np.bincount(allrow, (vx * vx).sum(1), len(pick))
            err = (_sigmoid(lin + 0.5 * ((s * s).sum(1) - q)) - y[pick]) * cost[pick] / len(pick)
            e = (err[allrow] * x)[:, None]
            grads = np.concatenate([e, e * (s[allrow] - vx)], 1)
            seen, back = np.unique(index, return_inverse=True)
            g = np.stack([np.bincount(back, grads[:, f], len(seen)) for f in range(rank + 1)], 1).astype(np.float32) + decay * theta[seen]
            step += 1
            # Adam on the rows seen.
            m1[seen] = 0.9 * m1[seen] + 0.1 * g
            m2[seen] = 0.99 * m2[seen] + 0.01 * g * g
            theta[seen] -= rate * (m1[seen] / (1 - 0.9**step)) / (np.sqrt(m2[seen] / (1 - 0.99**step)) + 1e-6)
            gb = float(err.sum())
            b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
            bias -= rate * (b1 / (1 - 0.9**step)) / ((b2 / (1 - 0.99**step)) ** 0.5 + 1e-6)
    return FactorisationMachine(bias, theta[:, 0].copy(), theta[:, 1:].copy(), mean.astype(np.float32), scale.astype(np.float32))


def _constant(share: float) -> FactorisationMachine:
    share = min(max(share, 0.01), 0.99)
    n = (1 << BITS) + DENSE
    return FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(n, np.float32), np.zeros((n, 1), np.float32), np.zeros(DENSE, np.float32), np.ones(DENSE, np.float32))


def _chars(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([np.nan if x is None or x < 0 else x for x in batch.column("n_chars").to_pylist()], np.float64)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2500, **options) -> FactorisationMachine:
    """Fit on a bounded sample of labelled rows outside fold 0 (``per_class`` of each class)."""

    def run(batches):
        for batch in batches:
            for part in spans(batch):
                begin, bucket, value, dense = inputs(part.column("text"), _chars(part))
                cut = range(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([bucket[begin[i] : begin[i + 1]].astype(np.int32).tobytes() for i in cut], pa.binary()),
                        pa.array([value[begin[i] : begin[i + 1]].tobytes() for i in cut], pa.binary()),
                        pa.array([dense[i].tobytes() for i in cut], pa.binary()),
                        part.column("y").cast(pa.int32()),
                    ],
                    names=["doc_id", "bucket", "value", "dense", "y"],
                )

    rows = map_batches(training_rows(docs, labels, label, per_class), run, "doc_id long, bucket binary, value binary, dense binary, y int").collect()
    rows.sort(key=lambda r: r.doc_id)
    y = [r.y for r in rows]
    if len(set(y)) < 2:
        return _constant(float(np.mean(y)) if y else 0.5)
    # The share of ones among all labelled training rows, not in the balanced sample.
    share = labels.where(F.col(label).isin(0, 1)).where(fold(F.col("doc_id")) != 0).agg(F.avg(label)).first()[0]
    parts = [(np.frombuffer(r.bucket, np.int32), np.frombuffer(r.value, np.float32), np.frombuffer(r.dense, np.float32), r.y) for r in rows]
    return fit(parts, prior=float(share), **options)


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """``doc_id, score`` of every row."""

    def run(batches):
        for batch in batches:
            for part in spans(batch):
                p = _sigmoid(model.logits(*inputs(part.column("text"), _chars(part))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(p, pa.float64())], names=["doc_id", "score"])

    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return map_batches(docs.select("doc_id", "text", chars.alias("n_chars")), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """The rows, with all columns, whose text scores ``threshold`` or more."""
    known = "n_chars" in docs.columns

    def run(batches):
        for batch in batches:
            for part in spans(batch):
                chars = _chars(part) if known else np.full(part.num_rows, np.nan)
                p = _sigmoid(model.logits(*inputs(part.column("text"), chars)))
                yield part.filter(pa.array(p >= threshold))

    return map_batches(docs, run, docs.schema)


def predict(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    return score(docs, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
