"""Whitening against numpy's eigenvectors of the whole covariance, exact integers and the defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txflow.llm import whitening
from txflow.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, component string, _x long, _key string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, "a", "b", 1, "k") for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def expected(vectors, k=4):
    x = np.array(sorted({tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for v in vectors}), object)
    n, s = len(x), x.sum(axis=0)
    c = x.astype(float) - np.array([v / n for v in s])
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    return n, s, e[::-1][:k], v[:, ::-1][:, :k], np.trace(cov)


def assert_same(spark, vectors, k=4):
    df = frame(spark, vectors)
    model = whitening.fit(df)
    n, s, e, v, trace = expected(vectors, k)
    assert model.n == n and list(model.sums) == list(s)
    np.testing.assert_allclose(model.values, e, rtol=1e-11)
    np.testing.assert_allclose(model.explained, e / trace, rtol=1e-11)
    np.testing.assert_allclose(np.abs((model.components * v).sum(axis=0)), 1, atol=1e-11)
    assert model.identity_error < 1e-9 and model.residual <= whitening.TOLERANCE
    rows = {r.vec_id: r for r in whitening.whiten(df, model).collect()}
    assert len(rows) == len(vectors)
    for i in range(0, len(vectors), max(1, len(vectors) // 50)):
        x = [int(np.floor(256 * float(np.float32(c)))) for c in vectors[i]]
        assert int(rows[i].deviation) == sum((n * a - b) ** 2 for a, b in zip(x, s))
        z = (np.array(x, float) - np.array([q / n for q in s])) @ model.components / np.sqrt(model.values)
        np.testing.assert_allclose(rows[i].whitened, z, rtol=1e-9, atol=1e-9)
    return model


def test_flat_spectrum_wider_than_the_block(spark):
    x = np.random.default_rng(1).standard_normal((700, 48)) * 0.16
    x = np.concatenate([x, x[:300], np.repeat(x[:1], 500, axis=0)])  # copies count once
    model = assert_same(spark, [list(v) for v in x])
    assert model.n == 700 and model.passes > whitening.DEGREE


def test_close_and_equal_eigenvalues(spark):
    """Signed unit vectors: all eigenvalues are equal, so any basis is right."""
    vectors = [list(sign * row) for row in np.eye(40) for sign in (1, -1)]
    model = whitening.fit(frame(spark, vectors))
    assert model.identity_error < 1e-9
    np.testing.assert_allclose(model.values, 65536 * 2 / 80, rtol=1e-9)


def test_fewer_dimensions_than_components(spark):
    x = np.random.default_rng(2).standard_normal((60, 3)) * [1, 2, 3]
    assert_same(spark, [list(v) for v in x], 3)


def test_no_spread_in_some_directions(spark):
    x = np.zeros((30, 30))
    x[:, 4], x[:, 9] = np.arange(30), np.arange(30) % 7
    model = whitening.fit(frame(spark, [list(v) for v in x]))
    assert len(model.values) == 2 and model.identity_error < 1e-9


def test_dropped_rows_ids_and_other_lengths(spark):
    good = [[0.1, 0.5, -0.2], [0.9, -0.4, 0.3], [0.0, -0.0, 0.7], [-3.0, 2.0, 1.0]]
    odd = [None, [], [None, 1.0, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 1.0], [1.0, 2.0]]
    df = frame(spark, good + odd + good[:1], [0, 1, None, 3, 4, 5, 6, 7, 8, 9, 0])
    model = whitening.fit(df)
    assert model.n == 4
    found = whitening.whiten(df, model)
    assert sorted(str(r.vec_id) for r in found.collect()) == ["0", "0", "1", "3", "None"]


def test_great_entries_stay_exact(spark):
    vectors = [[1e9, 3.0], [-2e9, 5.0], [7e8, -1.0], [1e6, 8e6]]
    assert_same(spark, vectors, 2)


@pytest.mark.parametrize("vectors", [[], [None, []], [[0.5, 0.25]] * 3])
def test_nothing_to_whiten(spark, vectors):
    df = frame(spark, vectors)
    model = whitening.fit(df)
    assert len(model.values) == 0 and whitening.whiten(df, model).count() == 0


def test_many_tasks_are_added_in_groups(spark, monkeypatch):
    x = np.random.default_rng(3).standard_normal((200, 24))
    df = frame(spark, [list(v) for v in x])
    plain = whitening.fit(df)
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 24 * 8 * 5)
    np.testing.assert_allclose(whitening.fit(df).values, plain.values, rtol=1e-12)


def test_query(spark, sf):
    out = op11_whitening(spark, sf)
    given = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                "explained": "double", "identity_error": "double"}
    assert out.count() == 4 * given and out.agg(F.max("identity_error")).first()[0] < 1e-4
