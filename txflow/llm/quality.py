"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model that minimises the non-negative
unbiased risk: pi * R(positives as 1) + max(0, R(unlabelled as 0) - pi * R(positives as 0)) with the
logistic loss. The class prior pi is estimated from the data: a first model tells positives from
unlabelled text, and the smallest ratio, over its thresholds, of unlabelled to positive rows above a
threshold bounds the share of positives from above (thresholds with few rows give way by their
confidence interval). Negative labels are not used.

Features are figures of the text alone: shares of character classes, word and line statistics,
repetition, and hashed pairs of bytes. The fit takes a bounded sample (``ROWS`` of each kind, all
if there are fewer); scoring covers every whole text.

Defined cases: a null text is empty; an empty text has a score like any other; without positives or unlabelled rows
the score is the prior (0.5); repeated rows and ids each get a row; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txflow.llm.common import filled, sampled, slices, with_struct

ROWS = 12_000
PAIRS = 128
ROUNDS = 400
RATE = 0.05
DECAY = 1e-4
THRESHOLD = 0.7

_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:'\"", b"!?", b"#*$%&", b"|", b"<>{}[]()", b"/\\@_=+-~^`")
_CLASS = np.full(256, len(_CLASSES), np.int64)  # the last class: everything else
for _k, _members in enumerate(_CLASSES):
    _CLASS[list(_members)] = _k
N_STATS = len(_CLASSES) + 1 + 9
WIDTH = N_STATS + PAIRS


def features(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(data))
    shares = np.bincount(_CLASS[data], minlength=len(_CLASSES) + 1) / n
    words = text.split()
    threes = len(words) - 2
    lines = [x for x in text.split("\n") if x.strip()]
    stats = [
        np.log1p(len(words)) / 10, np.log1p(len(data)) / 12, len(text) / max(1, len(words)) / 20,
        len(set(words)) / max(1, len(words)), len(set(zip(words, words[1:], words[2:]))) / threes if threes > 0 else 1.0,
        len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)) / 8,
        np.log1p(n / max(1, len(lines))) / 12, float(not words),
    ]
    pairs = np.zeros(PAIRS)
    if len(data) > 1:
        code = (data[:-1].astype(np.int64) * 31 + data[1:]) * 40503 >> 4 & PAIRS - 1
        pairs = np.sqrt(np.bincount(code, minlength=PAIRS) / (len(data) - 1))
    return np.concatenate((np.sqrt(shares), stats, pairs)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(grad, size: int, rounds: int) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def nn_pu_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Of the non-negative risk; where its second part is below zero, that part alone is pushed up again."""
    zp, zu = p @ w, u @ w
    decay = DECAY * np.append(w[:-1], 0)
    as_one = -prior * p.T @ (1 - _sigmoid(zp)) / len(p)
    as_zero = u.T @ _sigmoid(zu) / len(u) - prior * p.T @ _sigmoid(zp) / len(p)
    left = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return as_one + as_zero + decay if left >= 0 else -as_zero + decay


def estimate_prior(p: np.ndarray, u: np.ndarray, rounds: int = 200, confidence: float = 0.1) -> float:
    """Share of positives among the unlabelled rows, from above."""
    half_p, half_u = p[::2], u[::2]

    def grad(w):
        a = -half_p.T @ (1 - _sigmoid(half_p @ w)) / len(half_p)
        return a + half_u.T @ _sigmoid(half_u @ w) / len(half_u) + 1e-3 * np.append(w[:-1], 0)

    w = _adam(grad, p.shape[1], rounds)
    sp, su = np.sort(p[1::2] @ w), np.sort(u[1::2] @ w)
    if not len(sp) or not len(su):
        return 0.5
    cuts = sp[:: max(1, len(sp) // 200)]
    above_p = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    above_u = 1 - np.searchsorted(su, cuts, "left") / len(su)
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit_arrays(p: np.ndarray, u: np.ndarray, prior: float | None = None, rounds: int = ROUNDS) -> Model:
    mean, scale = np.zeros(WIDTH), np.ones(WIDTH)
    if not len(p) or not len(u):
        return Model(mean, scale, np.zeros(WIDTH), 0.0, 0.5)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-3
    p, u = (np.column_stack(((x - mean) / scale, np.ones(len(x)))) for x in (p, u))
    prior = estimate_prior(p, u) if prior is None else prior
    w = _adam(lambda w: nn_pu_gradient(w, p, u, prior), p.shape[1], rounds)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def _arrays(docs: DataFrame, text: str) -> np.ndarray:
    """Feature rows of a bounded table, computed in the tasks."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                rows = [features(t).tobytes() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["x"])

    raw = docs.select(filled(text).alias("text")).mapInArrow(run, "x binary").toArrow().column("x").to_pylist()
    return np.frombuffer(b"".join(raw), np.float32).reshape(-1, WIDTH)


def fit(positives: DataFrame, unlabelled: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS, prior: float | None = None) -> Model:
    chosen = [_arrays(sampled(x, rows, key).limit(2 * rows), text) for x in (positives, unlabelled)]
    return fit_arrays(*chosen, prior=prior)


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, model: Model, out: str = "quality", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct ``out``: score and predicted."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list) -> list:
        if not texts:
            return [[], []]
        s = known.value.score(np.stack([features(t or "") for t in texts]))
        return [s, (s >= threshold).astype(np.int32)]

    return with_struct(docs, out, SCORED, compute, text)
