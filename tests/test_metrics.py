"""Curves, ranks, percentiles, drift and sampling: small and divided forms against direct computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from txflow.operators import calibration as cal
from txflow.operators import drift, evaluate, metrics, ordered, sampling
from txflow.operators.ordered import percentiles, percentiles_of_counts, running_totals, spearman, value_counts

RNG = np.random.RandomState(7)


def table(spark, n=400, digits=2):
    s = np.round(RNG.rand(n), digits)
    y = (RNG.rand(n) < 0.2 + 0.5 * s).astype(int)
    return spark.createDataFrame([(int(i), float(a), int(b), "ab"[i % 2]) for i, (a, b) in enumerate(zip(s, y))], "id long, score double, label int, g string"), s, y


def direct_ap(s, y):
    out, tp, seen, last = 0.0, 0, 0, 0.0
    for t in sorted(set(s), reverse=True):
        tp += y[s == t].sum()
        seen += (s == t).sum()
        rc = tp / y.sum()
        out += (rc - last) * tp / seen
        last = rc
    return out


@pytest.mark.parametrize("part_rows", [10**6, 7])
def test_summary_equals_direct_computation(spark, part_rows):
    df, s, y = table(spark)
    got = metrics.score_summary(df, part_rows=part_rows).first()
    assert got["average_precision"] == pytest.approx(direct_ap(s, y))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert got["roc_auc"] == pytest.approx(auc)
    f1 = {t: 2 * y[s >= t].sum() / ((s >= t).sum() + y.sum()) for t in set(s)}
    top = max(f1.values())
    assert got["best_f1"] == pytest.approx(top) and got["best_threshold"] == min(t for t, v in f1.items() if v >= top - 1e-12)


@pytest.mark.parametrize("part_rows", [10**6, 7])
def test_grouped_summary(spark, part_rows):
    df, s, y = table(spark)
    for r in metrics.score_summary(df, groups=["g"], part_rows=part_rows).collect():
        pick = np.arange(len(s)) % 2 == "ab".index(r["g"])
        assert r["average_precision"] == pytest.approx(direct_ap(s[pick], y[pick]))


def test_no_positive_gives_null(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, label int")
    r = metrics.score_summary(df).first()
    assert r["average_precision"] is None and r["roc_auc"] is None and r["best_f1"] == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_in_parts(spark, descending):
    df, s, _ = table(spark, digits=3)
    counts = value_counts(df, "score", ["g"])
    a = {(r["g"], r["score"]): r["u"] for r in running_totals(counts, "score", {"u": "n"}, ["g"], descending).collect()}
    b = {(r["g"], r["score"]): (r["u"], r["t"]) for r in running_totals(counts, "score", {"u": "n"}, ["g"], descending, part_rows=5, totals={"t": "n"}).collect()}
    assert a == {k: v[0] for k, v in b.items()} and {v[1] for v in b.values()} == {200}


@pytest.mark.parametrize("accuracy", [10**4, 20, 12])
def test_percentiles_equal_numpy(spark, accuracy):
    vals = np.concatenate([RNG.lognormal(size=300), np.zeros(150)])
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(vals)] + [(None, 0)], "v double, g int")
    probs = [0, .1, .25, .5, .9, .995, 1]
    assert percentiles(df, "v", probs, accuracy=accuracy).first()["pcts"] == pytest.approx(list(np.percentile(vals, [p * 100 for p in probs])))
    for r in percentiles(df, "v", probs, ["g"], accuracy).collect():
        assert r["pcts"] == pytest.approx(list(np.percentile(vals[np.arange(450) % 3 == r["g"]], [p * 100 for p in probs])))
    many = percentiles_of_counts(value_counts(df, "v", ["g"]), "v", probs, ["g"], part_rows=20).collect()
    for r in many:
        assert r["pcts"] == pytest.approx(list(np.percentile(vals[np.arange(450) % 3 == r["g"]], [p * 100 for p in probs])))


def test_percentile_bands_on_a_long_column(spark):
    n = 250_000
    df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(100_003)) * 1.0).alias("v"))
    probs = [0.05, 0.5, 0.8, 0.99]
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs]))).first()[0]
    assert percentiles(df, "v", probs).first()["pcts"] == pytest.approx(want)


@pytest.mark.parametrize("part_rows", [10**6, 6])
def test_spearman_with_ties(spark, part_rows):
    a, b = RNG.randint(0, 20, 200), RNG.randint(0, 20, 200)
    b = np.where(RNG.rand(200) < 0.6, a, b)

    def ranks(x):
        return np.array([np.mean(np.where(np.sort(x) == v)[0]) for v in x])

    df = spark.createDataFrame([(int(x), int(z)) for x, z in zip(a, b)] + [(None, 3)], "a int, b int")
    got = spearman(df, {"ab": ("a", "b")}, part_rows).first()
    assert got["n"] == 200 and got["rho"] == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1])


def test_spearman_of_frequent_values_spreads_their_rows(spark):
    """A value with most of the rows is joined to its rank where its rows are, not in one task of a shuffle."""
    df = spark.range(4_000).select((F.col("id") % 100 == 0).cast("int").alias("a"), (F.col("id") % 7).alias("b"))
    plans, join = [], ordered.same
    ordered.same = lambda l, r, cols, how: plans.append((cols, how, out := join(l, r, cols, how))) or out
    try:
        got = ordered.spearman(df, {"ab": ("a", "b")}, 1_000).first()
    finally:
        ordered.same = join
    a, b = (np.array([r[c] for r in df.collect()], float) for c in "ab")
    rank = lambda x: np.array([np.mean(np.where(np.sort(x) == v)[0]) for v in x])
    assert got["n"] == 4_000 and got["rho"] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    joined = [d for cols, how, d in plans if cols == ["_rank", "_v"] and how == "inner"]
    assert sorted(d.count() for d in joined) == [3_960, 4_040]
    assert sum("BroadcastHashJoin" in d._jdf.queryExecution().executedPlan().toString() for d in joined) >= 1


@pytest.mark.parametrize("part_rows", [10**6, 9])
def test_spearman_ranks_each_column_once(spark, part_rows, monkeypatch):
    rng = np.random.RandomState(3)
    a, b, c = rng.randint(0, 30, 300), rng.rand(300).round(2), rng.randint(0, 2, 300)
    gap = rng.rand(300) < 0.2  # d has holes, so a is ranked twice: on all rows and on those with d
    rows = [(int(x), float(y), int(z), None if g else float(x + y)) for x, y, z, g in zip(a, b, c, gap)]
    df = spark.createDataFrame(rows, "a int, b double, c int, d double").withColumn("none", F.lit(None).cast("double"))
    pairs = {"ab": ("a", "b"), "ac": ("a", "c"), "bc": ("b", "c"), "ad": ("a", "d"), "aa": ("a", "a"), "gone": ("a", "none")}
    seen = []
    plain = ordered.running_totals
    monkeypatch.setattr(ordered, "running_totals", lambda counts, *x, **y: seen.append(counts) or plain(counts, *x, **y))
    got = {r["pair"]: r for r in ordered.spearman(df, pairs, part_rows).collect()}

    def rho(x, y):
        r = [np.array([np.mean(np.where(np.sort(v) == e)[0]) for e in v]) for v in (x, y)]
        return np.corrcoef(*r)[0, 1]

    kept = ~gap
    want = {"ab": (a, b), "ac": (a, c), "bc": (b, c), "ad": (a[kept], (a + b)[kept]), "aa": (a, a)}
    assert set(got) == set(want)
    for name, (x, y) in want.items():
        assert got[name]["n"] == len(x) and got[name]["rho"] == pytest.approx(rho(x, y))
    assert len(seen) == 1
    counts = dict(seen[0].groupBy("_rank").agg(F.sum("n")).collect())
    assert sorted(counts.values()) == sorted([300, 300, 300, kept.sum(), kept.sum()])


def test_sweep_and_report(spark):
    df, s, y = table(spark)
    curve = metrics.pr_curve(df)
    for r in metrics.threshold_sweep(curve, [0.3, 2.0]).collect():
        t = min((v for v in set(s) if v >= r["target"]), default=max(s))
        assert r["threshold"] == t and r["recall"] == pytest.approx(y[s >= t].sum() / y.sum())
    rows = {r["class"]: r for r in metrics.class_report(df, 0.5).collect()}
    assert rows["1"]["support"] == y.sum() and rows["weighted avg"]["support"] == len(y)


def test_psi_of_equal_tables_is_zero_and_types(spark):
    df = spark.createDataFrame([(float(i % 50), float(i % 2), 1.0, None, None if i % 5 else float(i)) for i in range(400)],
                               "cont double, flag double, const double, gone double, holes double")
    same = drift.psi(drift.long_sides(df, df, df.columns)).collect()
    assert all(r["psi"] == pytest.approx(0) and r["category"] == "stable" for r in same)
    assert {r["feature"]: r["feature_type"] for r in same} == {
        "cont": "continuous", "flag": "binary", "const": "constant", "gone": "all_missing_in_reference", "holes": "continuous"}
    moved = df.withColumn("cont", F.col("cont") + 30)
    table_ = drift.psi(drift.long_sides(df, moved, ["cont", "flag"]))
    edges = np.unique(np.quantile([i % 50 for i in range(400)], np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    r_, m_ = (np.maximum(np.histogram([v + d for v in (i % 50 for i in range(400))], edges)[0] / 400, 1e-4) for d in (0, 30))
    got = {r["feature"]: r["psi"] for r in table_.collect()}
    assert got["cont"] == pytest.approx(np.sum((m_ - r_) * np.log(m_ / r_)))
    fire = drift.should_retrain(table_).first()
    assert fire["retrain"] == 1 and "cont" in fire["reason"]
    assert drift.should_retrain(drift.psi(drift.long_sides(df, df, ["cont"]))).first()["retrain"] == 0


def wide_input(spark):
    rng = np.random.RandomState(3)
    n = 3_000
    x = rng.lognormal(size=(n, 12))
    x[:, 1], x[:, 2], x[:, 3] = np.round(x[:, 1], 1), rng.randint(0, 2, n), 4.0
    x[:, 4] = rng.randint(0, 3, n)
    x[rng.rand(n) < 0.2, 5] = np.nan
    x[:, 6] = np.nan
    x[:2000, 7] = np.nan
    x[2000:, 8] *= 2
    x[2500:, 3] = 5.0
    x[:, 9] = np.where(rng.rand(n) < 0.95, 0.0, x[:, 9])
    names = [f"f{i}" for i in range(12)]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    return df.filter("id < 2000"), df.filter("id >= 2000"), names


@pytest.mark.parametrize("accuracy", [10**4, 60])
def test_wide_psi_equals_the_long_form(spark, accuracy):
    ref, mon, names = wide_input(spark)
    want = {r["feature"]: r.asDict() for r in drift.psi(drift.long_sides(ref, mon, names)).collect()}
    got = {r["feature"]: r.asDict() for r in drift.psi_between(ref, mon, names, accuracy=accuracy).collect()}
    assert got.keys() == want.keys()
    for f, w in want.items():
        assert {k: v for k, v in got[f].items() if k != "psi"} == {k: v for k, v in w.items() if k != "psi"}, f
        assert got[f]["psi"] == pytest.approx(w["psi"], abs=1e-12), f


def test_wide_psi_of_empty_tables(spark):
    df = spark.createDataFrame([], "a double, b double")
    got = drift.psi_between(df, df, ["a", "b"]).collect()
    assert [(r["feature_type"], r["psi"]) for r in got] == [("all_missing_in_reference", 0.0)] * 2


def test_wide_psi_reads_its_input_once_and_the_written_table_three_times(spark, tmp_path):
    ref, mon, names = wide_input(spark)
    ref.write.parquet(str(tmp_path / "ref"))
    ref, seen = spark.read.parquet(str(tmp_path / "ref")), []
    taken = drift.cut

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return taken(df)

    drift.cut = noted
    try:
        drift.psi_between(ref, ref, names)
    finally:
        drift.cut = taken
    assert sum(p.count("tmp") > 0 and p.count("/ref]") for p in seen) == 2  # each side once
    assert not any("Generate" in p for p in seen)


def test_calibration_bounds_and_deciles(spark):
    df, s, y = table(spark)
    bins = cal.reliability_deciles(df, "score")
    assert sum(r["n"] for r in bins.collect()) == len(s)
    assert 0 <= cal.ece(bins).first()["ece"] <= 1
    perfect = df.withColumn("p", F.col("label").cast("double"))
    assert cal.ece(cal.reliability_fixed(perfect, "p")).first()["ece"] == 0
    assert cal.brier(perfect, "p").first()["skill"] == 1


def test_monotone_rows(spark):
    df = spark.createDataFrame([([0.0, 0.1, 0.2],), ([0.0, 0.5, 0.2],), ([0.1, 0.1 - 1e-6, 0.3],)], "curve array<double>")
    got = [(r["violations"], r["strict"]) for r in cal.monotone_rows(df.withColumn("grid", F.col("curve"))).collect()]
    assert got == [(0, 0), (1, 1), (0, 1)]


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    assert sampling.sample_rows(df, "id", 50).count() == 50
    assert sampling.sample_rows(df, "id", 50).exceptAll(sampling.sample_rows(df.repartition(7), "id", 50)).count() == 0
    assert sampling.sample_rows(df, "id", 50, seed=1).exceptAll(sampling.sample_rows(df, "id", 50)).count() > 0
    parts = sampling.stratified_split(df, "label", "id").groupBy("label", "part").count().collect()
    assert {(r["label"], r["part"]): r["count"] for r in parts} == {(0, "a"): 333, (0, "b"): 333, (1, "a"): 167, (1, "b"): 167}
    few = sampling.ratio_subsample(df, "label", "id", 1, epoch=3).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in few} == {0: 334, 1: 334}
    assert sampling.stratified_sample(df, "label", "id", 20).count() == 40


def test_gate_and_evidence(spark):
    row = lambda ap, f1: spark.createDataFrame([(ap, f1)], "average_precision double, f1 double")
    assert evaluate.gate(row(.8, .7), row(.796, .695)).first()["decision"] == "promote"
    bad = evaluate.gate(row(.8, .7), row(.7, .6)).first()
    assert bad["decision"] == "reject" and "AUC-PR" in bad["reasons"] and "F1" in bad["reasons"]
    one = lambda **kw: spark.createDataFrame([tuple(kw.values())], list(kw))
    got = evaluate.evidence(one(verdict="uniform"), one(n=0), one(rho=0.01), one(verdict="no_significant_skew")).first()
    assert (got["n_for"], got["n_against"]) == (0, 4) and got["verdict"].startswith("NO")


def test_slices_cover_all_rows(spark, sf):
    from txflow.catalog.base import scored_history

    df = scored_history(spark, sf)
    assert df.filter("rare_any = ordinary").count() == 0
    assert not math.isnan(df.count())
