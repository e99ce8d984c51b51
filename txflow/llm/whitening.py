"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers x = floor(scale * entry). The fit list holds each distinct x once, written in
blocks of rows. Nothing of the size of d x d is ever built: each pass over the blocks gives V Q for a slim
matrix Q, where V is the covariance of the fit list: every task centres its blocks and adds up
Xc'(Xc Q), and the driver adds one d x k matrix of each task. A polynomial of V, the Chebyshev
recurrence mapped to the unwanted part of the spectrum, damps that part; QR and Rayleigh-Ritz follow.
A few Lanczos steps bound the spectrum from below. Some columns of every block are new random vectors, so a direction that the
first block missed comes up later. Components are certified when in two rounds running their
residuals |Vq - eq| are below ``TOLERANCE`` of the largest eigenvalue and the eigenvalues agree.

Defined cases: rows whose vector is null or empty or holds null or non-finite entries are dropped, and so
are vectors of another length than the most frequent one (of two such, the longer); entries beyond the range of a long
stop at its ends; repeated rows and ids each get a row, equal vectors count once in the fit; components without
spread (eigenvalue 0 to rounding) are left out, so a table with one distinct vector, or an empty one, gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txflow.session import cut

SCALE = 256
COMPONENTS = 4
GUARD, FRESH = 12, 4  # further columns of the block; those that are new in each round
DEGREE = 12
LANCZOS = 8
TOLERANCE = 2e-13
FLAT = 1e-12  # share of the largest eigenvalue under which a component has no spread
ROUNDS = 200
BLOCK_BYTES = 2 << 20
FAN = 128  # matrices the driver adds up; more tasks than this are added in groups first

_PARTIAL = "part int, payload binary"


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: the fit list's size and sums, and one column of ``components`` for each of ``values``."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if len(self.values) else self.values


def integers(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * entry) of every entry; NULL for a vector that is dropped."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.when((F.size(v) > 0) & finite, F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))))


def _kept(df: DataFrame, vector: str, *cols: Column) -> DataFrame:
    return df.select(*cols, integers(vector).alias("_x")).filter("_x IS NOT NULL")


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _pack_blocks(dim: int):
    rows = max(1, BLOCK_BYTES // (8 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            x = _matrix(b.column("_x"))
            while len(x):
                held.append(x[: rows - n])
                n += len(held[-1])
                x = x[len(held[-1]) :]
                if n == rows:
                    yield _block(held)
                    held, n = [], 0
        if held:
            yield _block(held)

    return run


def _block(held: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).astype("<i8").tobytes()], pa.binary())], names=["block"])


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]


class _Blocks:
    """The written fit list; ``total`` adds up what a function gives for each block."""

    def __init__(self, blocks: DataFrame, dim: int):
        self.blocks, self.dim, self.passes = blocks, dim, 0
        self.tasks = blocks.rdd.getNumPartitions()

    def total(self, of: Callable[[np.ndarray], list[np.ndarray]], shapes: list[tuple[tuple[int, ...], str]]) -> list[np.ndarray]:
        """Sums over blocks, in the order of the tasks; ``shapes`` names shape and type of each sum."""
        dim = self.dim

        def unpack(raw: bytes) -> list[np.ndarray]:
            out, at = [], 0
            for shape, kind in shapes:
                size = int(np.prod(shape))
                out.append(np.frombuffer(raw, kind, size, at).reshape(shape))
                at += 8 * size
            return out

        def pack(sums: list[np.ndarray]) -> bytes:
            return b"".join(np.ascontiguousarray(s, kind).tobytes() for s, (_, kind) in zip(sums, shapes, strict=True))

        def row(part: int, sums: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack(sums)], pa.binary())], names=["part", "payload"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for b in batches:
                for raw in b.column("block"):
                    x = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dim)
                    own = of(x)
                    sums = own if sums is None else _add(sums, own)
            if sums is not None:
                yield row(TaskContext.get().partitionId(), sums)

        def merge(table: pa.Table) -> pa.Table:
            sums = None
            for part in table.sort_by("part").column("payload").to_pylist():
                sums = unpack(part) if sums is None else _add(sums, unpack(part))
            return pa.Table.from_batches([row(table.column("part")[0].as_py(), sums)])

        partial = self.blocks.mapInArrow(run, _PARTIAL)
        if self.tasks > FAN:
            partial = partial.groupBy((F.col("part") % FAN).alias("fan")).applyInArrow(merge, _PARTIAL)
        self.passes += 1
        sums = [np.zeros(shape, kind) for shape, kind in shapes]
        for _, raw in sorted((r.part, r.payload) for r in partial.collect()):
            sums = _add(sums, unpack(bytes(raw)))
        return sums


def _column_sums(x: np.ndarray) -> list[np.ndarray]:
    """Rows, and the sums of the high and the low 24 bits, which cannot overflow."""
    return [np.array([len(x)]), (x >> 24).sum(axis=0), (x & 0xFFFFFF).sum(axis=0)]


def _product(mean: np.ndarray, q: np.ndarray):
    def of(x: np.ndarray) -> list[np.ndarray]:
        c = x - mean
        return [c.T @ (c @ q), np.array([np.einsum("ij,ij->", c, c)])]

    return of


def _lower_bound(times: Callable[[np.ndarray], np.ndarray], dim: int, rng: np.random.Generator) -> float:
    """A value under (nearly) all eigenvalues: the smallest Ritz value of a Lanczos run less its residual."""
    q, before, beta = rng.standard_normal((dim, 1)), np.zeros((dim, 1)), 0.0
    q /= np.linalg.norm(q)
    basis, diagonal, off = [q], [], []
    for _ in range(min(LANCZOS, dim)):
        w = times(q) - beta * before
        diagonal.append(float((q * w).sum()))
        w -= diagonal[-1] * q
        for b in basis:
            w -= b * float((b * w).sum())
        beta, before = float(np.linalg.norm(w)), q
        off.append(beta)
        if beta <= 1e-14 * abs(diagonal[0]):
            break
        q = w / beta
        basis.append(q)
    t = np.diag(diagonal) + np.diag(off[: len(diagonal) - 1], 1) + np.diag(off[: len(diagonal) - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - off[-1])


def _filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """p(V) q for the scaled Chebyshev polynomial that is small on [low, high]; V q is known already."""
    centre, half = (low + high) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    older, y = q, (vq - centre * q) * (sigma / half)
    for _ in range(DEGREE - 1):
        after = 1 / (2 / first - sigma)
        older, y = y, (times(y) - centre * y) * (2 * after / half) - older * (sigma * after)
        sigma = after
    return y


def _subspace(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues of V, their vectors and the largest residual."""
    rng = np.random.default_rng(11)
    width = min(dim, wanted + GUARD + FRESH)
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    low = _lower_bound(times, dim, rng) if width < dim else 0.0
    good, last = 0, None
    for _ in range(ROUNDS):
        vq = times(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        off = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0)
        residual = float(off.max() / values[0]) if values[0] > 0 else 0.0
        same = last is not None and np.abs(last - values[:wanted]).max() <= 10 * TOLERANCE * values[0]
        good, last = (good + 1 if residual <= TOLERANCE else 0), values[:wanted]
        if values[0] <= 0 or (width == dim and residual <= TOLERANCE) or (good >= 2 and same):
            return values[:wanted], q[:, :wanted], residual
        if width == dim:
            q = np.linalg.qr(q)[0]
            continue
        high = max(values[width - FRESH - 1], low + 1e-9 * values[0])
        y = _filtered(times, q, vq, low, high, values[0])
        y[:, width - FRESH :] = rng.standard_normal((dim, FRESH))
        q = np.linalg.qr(y / np.linalg.norm(y, axis=0))[0]
    raise ArithmeticError(f"not certified after {ROUNDS} rounds: residual {residual}")


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The leading components of the distinct vectors of ``df``."""
    kept = _kept(df, vector)
    lengths = kept.groupBy(F.size("_x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    none = Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0.0, 0)
    if lengths is None:
        return none
    dim = lengths["dim"]
    distinct = kept.filter(F.size("_x") == dim).distinct()
    data = _Blocks(cut(distinct.mapInArrow(_pack_blocks(dim), "block binary")), dim)
    (n,), high, low = data.total(_column_sums, [((1,), "<i8"), ((dim,), "<i8"), ((dim,), "<i8")])
    n = int(n)
    sums = tuple((int(h) << 24) + int(v) for h, v in zip(high, low, strict=True))
    mean = np.array([s / n for s in sums])
    trace = 0.0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal trace
        product, spread = data.total(_product(mean, q), [(q.shape, "<f8"), ((1,), "<f8")])
        trace = float(spread[0]) / n
        return product / n

    values, vectors, residual = _subspace(times, dim, min(components, dim))
    has = values > FLAT * max(values[0], 0.0) if trace > 0 else np.zeros(len(values), bool)
    values, vectors = values[has], vectors[:, has]
    # One sign on every run: the largest entry of a component is positive.
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)
    error = _identity_error(data, n, mean, vectors / np.sqrt(values))
    return Whitening(n, sums, vectors, values, trace, error, residual, data.passes)


def _identity_error(data: _Blocks, n: int, mean: np.ndarray, weights: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k = weights.shape[1]
    if not k:
        return 0.0
    (centre,) = data.total(lambda x: [((x - mean) @ weights).sum(axis=0)], [((k,), "<f8")])
    centre = centre / n

    def squares(x: np.ndarray) -> list[np.ndarray]:
        z = (x - mean) @ weights - centre
        return [z.T @ z]

    (found,) = data.total(squares, [((k, k), "<f8")])
    return float(np.abs(found / n - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """sum((n x - S)^2) = n^2 sum(x^2) - 2 n sum(x S) + sum(S^2) of each row, exactly."""
    most = max(int(x.max()), -int(x.min()), 1)
    s = np.array(sums, object)
    if most * max(most, *(abs(v) for v in sums)) * len(sums) >= 1 << 62:
        x = x.astype(object)
    else:
        s = s.astype(np.int64)
    own, both, fixed = (x * x).sum(axis=1).tolist(), (x * s).sum(axis=1).tolist(), sum(v * v for v in sums)
    return [n * n * a - 2 * n * b + fixed for a, b in zip(own, both, strict=True)]


def whiten(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, whitened array<double>, deviation decimal(38,0)) of every row that is not dropped."""
    dim = max(len(model.sums), 1)
    kept = _kept(df, vector, F.col(key).alias("_key")).filter(F.size("_x") == dim)
    own = kept.schema["_key"].dataType
    weights, mean = (model.components / np.sqrt(model.values), model.mean) if len(model.values) else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and weights is not None:
                x = _matrix(b.column("_x"))
                z = (x - mean) @ weights
                deviation = [Decimal(v) for v in _deviations(x, model.n, model.sums)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("_key"), pa.array(list(z), pa.list_(pa.float64())), pa.array(deviation, pa.decimal128(38, 0))],
                    names=["_key", "whitened", "deviation"])

    schema = T.StructType([T.StructField("_key", own), T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.DecimalType(38, 0))])
    return kept.mapInArrow(run, schema).withColumnRenamed("_key", key)
