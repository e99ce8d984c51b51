import numpy as np

from txflow.llm import quality
from txflow.llm.queries import op7_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label")
    got = op7_quality(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    score, label = np.array([r.score for r in got]), np.array([r.label for r in got])
    assert (score[label == 1][:, None] > score[label == 0][None]).mean() > 0.97
    assert np.mean([r.predicted == r.label for r in got]) > 0.97


def blobs(n, share, seed):
    rng = np.random.default_rng(seed)
    good = rng.random(n) < share
    x = rng.normal(size=(n, quality.WIDTH)).astype(np.float32)
    x[:, 0] += np.where(good, 2.5, -2.5)
    return x, good


def test_prior_and_risk():
    p = blobs(4_000, 1.0, 1)[0]
    u, good = blobs(6_000, 0.3, 2)
    model = quality.fit_arrays(p, u)
    assert 0.25 < model.prior < 0.45
    assert ((model.score(u) > 0.5) == good).mean() > 0.95


def test_the_risk_turns_where_its_second_part_is_negative():
    p = np.column_stack((np.full((10, 1), 3.0), np.ones(10)))
    u = np.column_stack((np.full((10, 1), -3.0), np.ones(10)))
    w = np.array([2.0, 0.0])  # positives are sure, so as negatives they cost more than all unlabelled rows
    step = quality.nn_pu_gradient(w, p, u, 0.9)
    away = u.T @ quality._sigmoid(u @ w) / 10 - 0.9 * p.T @ quality._sigmoid(p @ w) / 10
    assert np.allclose(step, -away, atol=1e-3)


def test_odd_rows(odd, empty):
    model = quality.fit(odd.filter("doc_id < 6"), odd)
    got = quality.score(odd.select("doc_id", "text", "score"), model).collect()
    assert len(got) == odd.count() and all(0 <= r.quality.score <= 1 and r.quality.predicted == (r.quality.score >= 0.7) for r in got)
    assert len({r.quality.score for r in got if not r.text}) == 1  # null as empty
    blank = quality.fit(empty, odd)
    assert {r.quality.score for r in quality.score(odd.select("text"), blank).collect()} == {0.5}
    assert quality.score(empty.select("text"), model).collect() == []
