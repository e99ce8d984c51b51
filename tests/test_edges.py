"""Rows that used to be lost or to change a result: constant keys, NULL scores and strata, deep positions, bad messages."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_io_and_stream import CASE, drain, messages, put
from txflow.operators import calibration, metrics, ordered, reports, sampling
from txflow.operators.encode import dense_index
from txflow.operators.history import Moments, PriorCount, Trailing, heavy_keys, prior, split_heavy
from txflow.streaming import verdicts as st

T0 = datetime(2025, 1, 1)


@pytest.mark.parametrize("hot_rows", [3, 7])
def test_constant_and_nearly_constant_keys(spark, hot_rows):
    rows = [(i, i % 3, T0 + timedelta(minutes=i // 5), {0: 0.1, 1: 1e9 + 0.1, 2: 0.1 if i != 62 else 0.5}[i % 3] if i % 11 else None) for i in range(66)]
    df = spark.createDataFrame(rows, "tx_id long, user long, ts timestamp, amount double")
    for sample in (True, False):
        spec = [Moments("amount", n="n", mean="mean", std="std", max="top", sample=sample)]
        plain = {r.tx_id: r for r in prior(df, "user", spec).collect()}
        sliced = prior(df, "user", spec, hot_rows=hot_rows).collect()
        assert len(sliced) == len(rows)
        for r in sliced:
            p = plain[r.tx_id]
            assert (r.n, r.top) == (p.n, p.top) and (r.std is None, r.std == 0) == (p.std is None, p.std == 0)
            assert r.std is None or math.isclose(r.std, p.std, rel_tol=1e-6)
            assert r["mean"] is None or math.isclose(r["mean"], p["mean"], rel_tol=1e-12)


def test_every_heavy_key_is_sliced(spark):
    df = spark.createDataFrame([(i, i % 40, T0 + timedelta(minutes=i), 1.0 * i) for i in range(400)], "tx_id long, user long, ts timestamp, amount double")
    out = prior(df, "user", [Moments("amount", n="n")], hot_rows=4)
    assert {(r.tx_id, r.n) for r in out.collect()} == {(i, i // 40) for i in range(400)}


def test_percentiles_have_the_same_digits_on_every_path(spark):
    df = spark.range(3_000).select((F.hash("id") % 1_000 / 7.0).alias("v"), (F.col("id") % 3).alias("g"))
    probs = [0.013, 0.25, 0.5, 0.9137]
    a = {r.g: r.pcts for r in ordered.percentiles(df, "v", probs, ["g"]).collect()}
    b = {r.g: r.pcts for r in ordered.percentiles(df, "v", probs, ["g"], accuracy=50).collect()}
    c = {r.g: r.pcts for r in ordered.percentiles_of_counts(ordered.value_counts(df, "v", ["g"]), "v", probs, ["g"], part_rows=50).collect()}
    assert a == b == c


def test_isotonic_fit_weighs_tied_scores(spark):
    rows = [(0.1, 1.0)] * 2 + [(0.2, 0.0)] * 98 + [(0.9, 1.0)] * 5
    df = spark.createDataFrame(rows, "p double, y double")
    merged = calibration._merge_equal(df)
    fit = calibration.IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(merged)
    got = dict(zip(fit.boundaries.toArray().tolist(), fit.predictions.toArray().tolist(), strict=True))
    assert got[0.1] == pytest.approx(0.02) and got[0.2] == pytest.approx(0.02) and got[0.9] == 1.0


def test_deep_positions_are_counted(spark):
    df = spark.createDataFrame([(n, 1) for n in (0, 9, 999, 1_000, 100_000, 10**9)], "user_tx_count long, label int")
    got = {r.bucket: r.n for r in reports.depth_table(df).collect()}
    assert sum(got.values()) == 6 and got["1000+"] == 3


def test_null_strata_stay(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 2) for i in range(100)], "tx_id long, label int")
    split = sampling.stratified_split(df, "label", "tx_id")
    assert split.count() == 100 and split.filter("label IS NULL AND part = 'a'").count() == 5
    assert sampling.ratio_subsample(df, "label", "tx_id", 10).count() == 100


def test_null_scores_are_no_threshold(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.1, 0), (None, 1), (None, 0)], "score double, label int")
    out = metrics.score_summary(df).first()
    assert out.n == 3 and out.best_threshold == 0.9 and out.best_f1 == 1.0 and out.average_precision == 1.0
    assert metrics.unscored(df).first().unscored == 2


@pytest.mark.parametrize("kind", ["string", "long"])
def test_dense_index_of_values_with_a_common_prefix(spark, kind):
    values = [f"user-{i:05d}" for i in range(500)] if kind == "string" else list(range(-250, 250))
    df = spark.createDataFrame([(v,) for v in [*values, *values, None]], f"v {kind}").repartition(7)
    out = dense_index(df, "v")
    assert {(r.v, r.code) for r in out.collect()} == {(v, i) for i, v in enumerate(values)}
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "left(v" not in plan


def test_unreadable_messages_and_missing_amounts(spark, tmp_path):
    good = messages(CASE[:5])
    missing = good[2].replace('"amount": 30.0', '"amount": null')
    put(tmp_path, "a.txt", [*good[:2], missing, '{"user_id": "stream-test-user", "timestamp": "not a time", "amount": 5}', "no json", *good[3:]])
    rows = {r["tx_id"]: r for r in drain(spark, tmp_path, st.stream_features).collect() if r["user"] == "stream-test-user"}
    assert set(rows) == {f"txn-{i}" for i in range(5)}
    assert rows["txn-4"]["user_hist_mean"] == pytest.approx((20 + 25 + 22) / 3) and rows["txn-4"]["user_hist_max"] == 25
    assert rows["txn-2"]["amount"] is None and rows["txn-4"]["user_tx_count"] == 4


def test_rows_of_one_moment_go_by_number(spark, tmp_path):
    put(tmp_path, "a.txt", [m.replace("txn-", "") for m in messages([(0, "M-A", "5411", 1 + i, "Chip") for i in range(12)])])
    rows = {r["tx_id"]: r["user_tx_count"] for r in drain(spark, tmp_path, st.stream_features).collect()}
    assert rows == {str(i): i for i in range(12)}


def test_slices_hold_equally_many_rows(spark):
    # All but a few rows lie in one hour, and one moment alone holds 60.
    times = [i * 86_400 for i in range(20)] + [3 * 86_400 + i for i in range(300)] + [3 * 86_400 + 500] * 60
    df = spark.createDataFrame([(i, 1, T0 + timedelta(seconds=s), 1.0 * i) for i, s in enumerate(times)], "tx_id long, user long, ts timestamp, amount double")
    _, hot = split_heavy(df, ["user"], heavy_keys(df, ["user"], hot_rows=40))
    sizes = sorted(r["count"] for r in hot.groupBy("_slice").count().collect())
    assert sum(sizes) == len(times) and sizes[-1] <= 80 and len(sizes) >= 8
    spec = [Moments("amount", n="n", mean="mean", std="std", max="top"), PriorCount("c"), Trailing("t", "c", 3_600)]
    plain = {r.tx_id: tuple(r) for r in prior(df, "user", spec).collect()}
    for r in prior(df, "user", spec, hot_rows=40).collect():
        assert all(x == y or math.isclose(x, y, rel_tol=1e-9) for x, y in zip(tuple(r), plain[r.tx_id], strict=True))
