"""Jobs on the whole model vector, held against numpy."""

import inspect

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from txflow.catalog import learning as jobs
from txflow.operators import learning as ml
from txflow.plans import flows
from txflow.sources.tables import raw_events as tx_events_raw
from txflow.sources.tables import tx_events

NAMES = [f"a_t{t}" for t in range(10)] + [f"b_t{t}" for t in range(10)] + ["h", "k"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(5)
    x = rng.normal(size=(600, len(NAMES)))
    y = (x[:, 9] + 0.5 * x[:, 20] + 0.3 * rng.normal(size=600) > 0.8).astype(int)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "tx_id long, label int, x array<double>")
    return df.select("tx_id", "label", array_to_vector("x").alias("inputs")).cache(), x, y


def test_ablation_equals_the_masked_linear_score(spark, rows):
    df, x, _ = rows
    model = ml.train(df, "inputs", kind="linear")
    stage = model.stages[-1]
    groups = {"full": [], "no_a": NAMES[:10], "no_h": ["h"], "nothing": NAMES}
    out = ml.ablate(model, df, groups, NAMES)
    assert out.count() == 600 * 4 and sorted(out.columns) == ["label", "model", "score", "tx_id"]
    for r in out.collect():
        z = np.where([n in groups[r.model] for n in NAMES], 0.0, x[r.tx_id]) @ stage.coefficients.toArray() + stage.intercept
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)


def test_vector_attributions_and_top_slots(spark, rows):
    df, x, _ = rows
    coef, means = np.linspace(-1, 1, len(NAMES)), x.mean(axis=0)
    holes = df.select("tx_id", F.transform(vector_to_array("inputs"), lambda v, i: F.when(i != 3, v)).alias("x"))
    shares = ml.vector_attributions("x", coef, means)
    out = holes.select("tx_id", shares.alias("s"), ml.top_slots(shares, NAMES, 3).alias("top"))
    for r in out.collect():
        want = coef * (x[r.tx_id] - means)
        want[3] = 0.0
        np.testing.assert_allclose(r.s, want, atol=1e-12)
        best = sorted(range(len(NAMES)), key=lambda i: (-abs(want[i]), i))[:3]
        assert [t.feature for t in r.top] == [NAMES[i] for i in best]
    # Three expressions, whatever the width.
    assert len(out._jdf.queryExecution().analyzed().expressions().mkString()) < 30 * len(NAMES) * 40


def test_augmented_vectors_place_slots_and_fill_with_positive_means(spark, rows):
    df, x, y = rows
    fake = spark.createDataFrame([(1.5, None), (2.5, 9.0)], "a double, h double")
    out = ml.augment_slots(df, fake, NAMES, evaders=df.filter("tx_id < 3"))
    got = [(r.source, r.label, np.array(r.inputs.toArray())) for r in out.collect()]
    assert len(got) == 605 and {s for s, _, _ in got} == {"real", "synthetic", "evader"}
    mean = x[y == 1].mean(axis=0)
    for a, h in ((1.5, None), (2.5, 9.0)):
        want = mean.copy()
        want[9] = a
        want[20] = mean[20] if h is None else h
        assert any(s == "synthetic" and label == 1 and np.allclose(v, want) for s, label, v in got)
    assert all(label == 1 for s, label, _ in got if s == "evader")


def test_refit_on_a_vector(spark, rows):
    df, _, _ = rows
    df = df.withColumn("ts", F.timestamp_seconds(F.col("tx_id") * 3600))
    model = ml.train(df, "inputs", kind="linear")
    calm = flows.refit_on_drift(model, df, df, df, "inputs", NAMES, 0.5, kind="linear")
    assert calm.gate is None and calm.trigger.first()["retrain"] == 0
    moved = df.withColumn("inputs", array_to_vector(F.transform(vector_to_array("inputs"), lambda v, i: F.when(i == 20, v + 3).otherwise(v))))
    out = flows.refit_on_drift(model, df, moved, df, "inputs", NAMES, 0.5, kind="trees", rounds=2)
    assert out.trigger.first()["retrain"] == 1 and "feature h " in out.trigger.first()["reason"]
    assert out.promoted == (out.gate.first()["decision"] == "promote")


def test_drift_of_the_whole_model_input_equals_the_long_form(spark, sf):
    from txflow.operators import drift
    from txflow.schema import slot_names
    from txflow.session import cut
    from txflow.sources.tables import raw_events

    names = slot_names()
    rows = cut(flows.model_input(raw_events(spark, sf)).filter("vector IS NOT NULL").select("split", F.col("vector").alias("_x")))
    sides = [rows.filter(F.col("split") == s) for s in ("train", "test")]
    got = {r["feature"]: r.asDict() for r in drift.psi_of_arrays(*sides, names).collect()}
    called = F.array(*[F.lit(n) for n in names])
    long = rows.select(F.when(F.col("split") == "train", "ref").otherwise("mon").alias("side"), F.posexplode("_x").alias("i", "value"))
    want = {r["feature"]: r.asDict() for r in drift.psi(long.select("side", F.get(called, F.col("i")).alias("feature"), "value")).collect()}
    assert got.keys() == want.keys() == set(names)
    for f, w in want.items():
        assert {k: v for k, v in got[f].items() if k != "psi"} == {k: v for k, v in w.items() if k != "psi"}, f
        assert got[f]["psi"] == pytest.approx(w["psi"], abs=1e-9), f


def _grouped(spark, groups):
    rng = np.random.RandomState(9)
    n = 400 * groups
    x = rng.normal(size=(n, 6)) * [1, 5, 0.1, 1, 1, 2] + [0, 100, 0, -3, 0, 0]
    x[:, 4] = 7.0
    bank = rng.choice(groups, size=n, p=[0.4, *[0.6 / (groups - 1)] * (groups - 1)])
    y = (x[:, 0] * (1 + bank) - 4 * x[:, 2] + 0.3 * x[:, 5] + rng.normal(size=n) > 1).astype(int)
    df = spark.createDataFrame([(int(b), int(c), v.tolist()) for b, c, v in zip(bank, y, x)], "bank int, label int, x array<double>")
    return df.select("bank", "label", array_to_vector("x").alias("inputs"))


def test_grouped_fit_equals_separate_fits(spark):
    df = _grouped(spark, 3).cache()
    got = ml.train_grouped(df, "bank", "inputs", rounds=100, tol=1e-8)
    assert sorted(got) == [0, 1, 2]
    for b, m in got.items():
        own = ml.with_weight(df.filter(F.col("bank") == b))
        want = LogisticRegression(maxIter=500, tol=1e-12, regParam=1e-4, featuresCol="inputs", weightCol="weight").fit(own)
        theirs = want.coefficients.toArray().copy()
        constant = theirs[4] * 7.0  # rounding may leave the constant input a spread, then it shares the intercept
        theirs[4] = 0.0
        np.testing.assert_allclose(m.coefficients, theirs, rtol=1e-3, atol=1e-4)
        assert m.intercept == pytest.approx(want.intercept + constant, rel=1e-3, abs=1e-2)
        assert m.coefficients[4] == 0
    scored = ml.linear_scores(list(got.values()), df, "inputs")
    for r in scored.limit(50).collect():
        assert r.score == pytest.approx(np.mean([1 / (1 + np.exp(-(m.coefficients @ r.inputs.toArray() + m.intercept))) for m in got.values()]), rel=1e-9)


def test_grouped_fit_odd_groups(spark):
    df = _grouped(spark, 3)
    odd = df.filter("bank = 1").selectExpr("10 AS bank", "0 AS label", "inputs").unionByName(
        df.filter("bank = 2").selectExpr("11 AS bank", "1 AS label", "inputs")).unionByName(
        df.limit(5).selectExpr("CAST(NULL AS INT) AS bank", "label", "inputs")).unionByName(
        df.limit(5).selectExpr("0 AS bank", "CAST(NULL AS INT) AS label", "inputs"))
    got, plain = ml.train_grouped(df.unionByName(odd), "bank", "inputs"), ml.train_grouped(df, "bank", "inputs")
    assert got[10].intercept == -np.inf and got[11].intercept == np.inf and not got[10].coefficients.any()
    for b in plain:
        np.testing.assert_allclose(got[b].coefficients, plain[b].coefficients, rtol=1e-4, atol=1e-6)
    assert set(got) == {0, 1, 2, 10, 11}
    assert ml.train_grouped(df.limit(0), "bank", "inputs") == {}
    holes = spark.createDataFrame([(None,), ([0.0] * 6,)], "x array<double>").select(F.when(F.col("x").isNotNull(), array_to_vector(F.coalesce("x", F.array(F.lit(0.0))))).alias("inputs"))
    scores = [r.score for r in ml.linear_scores([got[10], got[11]], holes, "inputs").collect()]
    assert None in scores and 0.5 in scores


def test_grouped_fit_jobs_do_not_grow_with_the_groups(spark, monkeypatch):
    passes = []
    plain = ml._sums_by_group
    monkeypatch.setattr(ml, "_sums_by_group", lambda *a: passes.append(1) or plain(*a))
    counts = []
    for groups in (2, 12):
        passes.clear()
        assert len(ml.train_grouped(_grouped(spark, groups), "bank", "inputs", rounds=12)) == groups
        counts.append(len(passes))
    assert counts[1] < 2 * counts[0]


def test_fits_get_rows_in_small_blocks(spark, sf, monkeypatch):
    df, inputs = ml.with_indicators(tx_events(spark, sf).coalesce(1), ["amount", "merchant"])
    monkeypatch.setattr(ml, "BLOCK_BYTES", 4_000)
    out = ml.in_blocks(df, inputs, "label")
    assert out.rdd.getNumPartitions() == -(-df.count() * len(inputs) * 8 // 4_000) and out.exceptAll(df.select("label", *inputs)).count() == 0
    vectors = df.select("label", F.array(*inputs).alias("x")).select("label", ml.array_to_vector("x").alias("inputs"))
    assert ml.in_blocks(vectors, "inputs", "label").rdd.getNumPartitions() == out.rdd.getNumPartitions()


@pytest.mark.parametrize("job", [jobs.m01, jobs.m02, jobs.m04])
def test_tree_queries_fit_all_rounds(spark, sf, job, monkeypatch):
    whole, asked = ml.train, []

    def train(*a, **kw):
        call = inspect.signature(whole).bind(*a, **kw)
        call.apply_defaults()
        asked.append([call.arguments[k] for k in ("kind", "rounds", "depth", "step")])
        return whole(*a, **{**kw, "rounds": 1})

    monkeypatch.setattr(ml, "train", train)
    assert job(spark, sf).count() > 0
    assert asked == [["trees", 300, 6, 0.1]]


def test_packed_rows_are_the_model_input(spark, sf):
    raw = tx_events_raw(spark, sf)
    want = {r["tx_id"]: r for r in flows.model_input(raw).filter("vector IS NOT NULL").collect()}
    slots = {r["tx_id"]: np.frombuffer(r["x"]) for r in flows.packed_slots(raw).collect()}
    both = {r["tx_id"]: (r["label"], r["user_tx_count"], r["inputs"].toArray()) for r in flows.training_rows(raw).collect()}
    assert slots.keys() == both.keys() == want.keys() and len(want) > 500
    for tx, w in want.items():
        x = np.array([np.nan if v is None else v for v in w["vector"]])
        np.testing.assert_array_equal(slots[tx], x)
        label, position, inputs = both[tx]
        assert (label, position) == (w["label"], w["user_tx_count"])
        np.testing.assert_array_equal(inputs, [*np.where(np.isnan(x), 0.0, x), *np.isnan(x[210:])])


def test_drift_report_aggregates_no_wide_sketches(spark, monkeypatch):
    """Sketches of all features met in one task; the passes send bins, whose number does not grow with the rows."""
    from txflow.operators import drift

    rng = np.random.RandomState(2)
    sent, plain = [], drift._places
    monkeypatch.setattr(drift, "_places", lambda *a: sent.append(plain(*a)) or sent[-1])
    for n in (3_000, 30_000):
        df = spark.createDataFrame([(v.tolist(),) for v in rng.normal(size=(n, 3))], "_x array<double>")
        assert drift.psi_of_arrays(df, df, ["a", "b", "c"]).agg(F.max("psi")).first()[0] == 0
    few, many = (sum(len(k) for bins, _ in sent[i : i + 2] for k, _ in bins) for i in (0, 2))
    assert many < 4 * few


def test_a_cut_leaves_no_shuffle_files(spark):
    import os

    from txflow.session import cut

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    stored = lambda: {f for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}
    before = stored()
    out = cut(spark.range(20_000).repartition(7, "id").groupBy((F.col("id") % 1000).alias("k")).count())
    assert not [f for f in stored() - before if f.endswith(".data")]
    assert out.count() == 1000


def test_packed_linear_fit_takes_the_steps_of_sparks(spark, sf):
    """After the default 25 rounds, far from convergence, both fits hold the same model."""
    from txflow.operators import packed
    from txflow.session import cut

    df = cut(flows.packed_inputs(tx_events_raw(spark, sf)))
    got = ml.train_linear(df, "x")
    rows = packed.as_vectors(df, "x", "inputs").cache()
    model = ml.train(rows, "inputs", kind="linear")
    theirs = model.stages[-1]
    np.testing.assert_allclose(got.coefficients, theirs.coefficients.toArray(), rtol=1e-4, atol=1e-6)
    assert got.intercept == pytest.approx(theirs.intercept, rel=1e-4, abs=1e-6)
    want = {r.tx_id: r.score for r in ml.score(model, rows).select("tx_id", "score").collect()}
    scores = {r.tx_id: r.score for r in ml.packed_scores({"score": [got]}, df, "x").select("tx_id", "score").collect()}
    assert scores == pytest.approx(want, abs=1e-5) and len(want) > 500
    groups = {"full": [], "no_window": flows.SLOTS}
    one = {(r.tx_id, r.model): r.score for r in ml.packed_ablate(got, df.select("tx_id", "x"), groups, flows.INPUTS, "x").collect()}
    two = {(r.tx_id, r.model): r.score for r in ml.ablate(model, rows.select("tx_id", "inputs"), groups, flows.INPUTS).collect()}
    assert one == pytest.approx(two, abs=1e-5) and len(one) == 2 * len(want)
    means = ml.packed_means(df, "x")
    shares = ml.vector_attributions(vector_to_array("inputs"), got.coefficients, means)
    plain = {r.tx_id: r.top for r in rows.select("tx_id", ml.top_slots(shares, flows.INPUTS, 3).alias("top")).collect()}
    for r in ml.packed_top_slots(got, means, df.select("tx_id", "x"), flows.INPUTS, "x", 3).collect():
        assert [(t.feature, t.shap_value) for t in r.top_features] == [(t.feature, pytest.approx(t.shap_value)) for t in plain[r.tx_id]]


def test_grouped_fit_with_all_rows_as_one_more_group(spark):
    df = _grouped(spark, 3).withColumn("bank", F.col("bank").cast("bigint"))
    odd = df.unionByName(df.limit(50).withColumn("bank", F.lit(None).cast("bigint")))
    got, alone = ml.train_grouped(odd, "bank", "inputs", whole=-1), ml.train_grouped(df, "bank", "inputs")
    assert set(got) == {-1, 0, 1, 2}
    for b in alone:
        np.testing.assert_allclose(got[b].coefficients, alone[b].coefficients, rtol=1e-6, atol=1e-9)
    every = ml.train_grouped(odd.withColumn("bank", F.lit(7)), "bank", "inputs")[7]
    np.testing.assert_allclose(got[-1].coefficients, every.coefficients, rtol=1e-6, atol=1e-9)


def test_a_linear_fit_keeps_no_blocks_and_shuffles_no_rows(spark, sf):
    from txflow.session import cut

    df = cut(flows.packed_inputs(tx_events_raw(spark, sf)))
    kept = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    ml.train_linear(df, "x", rounds=2)
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= kept


def test_banks_by_count_are_ranges_of_users(spark):
    from txflow.operators.split import banks

    users = [f"u{i:02}" for i in range(7)]
    df = spark.createDataFrame([(u,) for u in users for _ in range(3)] + [(None,)], "user string")
    got = banks(df, "user", count=3)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.user, r.bank) for r in got.collect()} == {(u, i * 3 // 7) for i, u in enumerate(users)} | {(None, None)}
    assert [r.bank for r in banks(df.filter("user IS NULL"), "user", count=3).collect()] == [None]
