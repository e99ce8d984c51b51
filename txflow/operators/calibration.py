"""Reliability tables, calibration errors, recalibration and response curves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txflow.functions.clean import bin_index
from txflow.operators.joining import with_row
from txflow.operators.learning import without_summary
from txflow.operators.ordered import percentiles, spearman
from txflow.operators.sampling import stratified_split
from txflow.session import cut

# Reliability bins and monotonicity limits.
FIXED_EDGES = (0.0, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 3e-2, 0.1, 0.3, 0.5, 0.7, 0.9, 0.97, 1.0 + 1e-9)
EPS_ABS, EPS_REL, EPS_STRICT = 1e-4, 0.01, 1e-9
GRID_POINTS, GRID_LOW, GRID_HIGH = 41, 0.005, 0.995
# Scores an isotonic fit can tell apart.
SCORE_GRID = 100_000


def brier(df: DataFrame, prob: str, label: str = "label", *groups: str) -> DataFrame:
    """Brier score, the base-rate score p(1-p), and the skill against it."""
    out = df.groupBy(*groups).agg(
        F.avg(F.pow(F.col(prob) - F.col(label), 2)).alias("brier"), F.avg(label).alias("base_rate"))
    base = F.col("base_rate") * (1 - F.col("base_rate"))
    return out.withColumn("baseline", base).withColumn(
        "skill", F.when(F.col("baseline") > 0, 1 - F.col("brier") / F.when(F.col("baseline") > 0, F.col("baseline"))))


def _bins(df: DataFrame, prob: str, label: str, *groups: str) -> DataFrame:
    return df.groupBy(*groups, "bin").agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives"),
        F.avg(prob).alias("mean_predicted"), F.avg(label).alias("observed"))


def quantile_bin(df: DataFrame, value: str, n: int = 10) -> DataFrame:
    """Add ``bin``: population quantiles, duplicate edges merged, bins (a, b], lowest value included."""
    q = percentiles(df, value, [i / n for i in range(n + 1)]).select(F.array_distinct("pcts").alias("_edges"))
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    b = F.size(F.filter(inner, lambda e: e < F.col(value)))
    return with_row(df, q).withColumn("bin", b).drop("_edges")


def reliability_deciles(df: DataFrame, prob: str, label: str = "label", n: int = 10) -> DataFrame:
    return _bins(quantile_bin(df.filter(F.col(prob).isNotNull()), prob, n), prob, label)


def reliability_fixed(df: DataFrame, prob: str, label: str = "label", edges: Sequence[float] = FIXED_EDGES, *groups: str) -> DataFrame:
    return _bins(df.withColumn("bin", bin_index(prob, edges)), prob, label, *groups)


def ece(bins: DataFrame, *groups: str) -> DataFrame:
    gap = F.abs(F.col("observed") - F.col("mean_predicted"))
    return bins.groupBy(*groups).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def calibration_verdict(bins: DataFrame) -> DataFrame:
    """Direction of the highest bin (+-.01) and poor / reasonable (ECE > .01)."""
    top = F.max_by(F.struct("mean_predicted", "observed"), F.col("bin")).alias("top")
    gap = F.abs(F.col("observed") - F.col("mean_predicted"))
    out = bins.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), top)
    p, o = F.col("top.mean_predicted"), F.col("top.observed")
    way = F.when(p > o + 0.01, "overconfident").when(p < o - 0.01, "underconfident").otherwise("approximately calibrated")
    poor = (F.col("ece") > 0.01) | (F.col("direction") != "approximately calibrated")
    return out.withColumn("direction", way).withColumn("verdict", F.when(poor, "poor").otherwise("reasonable")).drop("top")


def recalibration(df: DataFrame, prob: str, label: str = "label", key: str = "tx_id", seed: int = 42) -> DataFrame:
    """Platt and isotonic fits on one stratified half, judged on the other: (method, brier, skill, ece, best)."""
    parts = stratified_split(df.select(key, F.col(prob).alias("p"), F.col(label).cast("double").alias("y")), "y", key, 0.5, seed)
    parts = cut(VectorAssembler(inputCols=["p"], outputCol="x").transform(parts))
    fit, hold = parts.filter("part = 'a'"), parts.filter("part = 'b'")
    platt = without_summary(LogisticRegression(featuresCol="x", labelCol="y", probabilityCol="q", regParam=1e-4).fit(fit))
    iso = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w", predictionCol="isotonic").fit(_merge_equal(fit))
    judged = iso.transform(platt.transform(hold)).withColumn("platt", vector_to_array("q")[1])
    long = judged.select("y", F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(c).alias("prob")) for m, c in (("raw", "p"), ("platt", "platt"), ("isotonic", "isotonic"))
    ])).alias("e")).select("y", "e.*")
    table = brier(long, "prob", "y", "method").join(ece(reliability_fixed(long, "prob", "y", FIXED_EDGES, "method"), "method"), "method")
    raw = F.max(F.when(F.col("method") == "raw", F.col("ece")))
    p, i = (F.max(F.when(F.col("method") == m, F.col("ece"))) for m in ("platt", "isotonic"))
    best = F.when((raw - p > 0.001) | (raw - i > 0.001), F.when(i <= p, "isotonic").otherwise("platt")).otherwise("none")
    return with_row(table.select("method", "brier", "skill", "ece"), table.agg(best.alias("best")))


def _merge_equal(fit: DataFrame) -> DataFrame:
    """Mean label per score on a grid of 1 / SCORE_GRID: the isotonic fit, whose last step pools on the driver, sees at most that many weighted rows."""
    merged = fit.groupBy((F.round(F.col("p") * SCORE_GRID) / SCORE_GRID).alias("p")).agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("w"))
    return VectorAssembler(inputCols=["p"], outputCol="x").transform(merged)


def response_grid(df: DataFrame, feature: str, points: int = GRID_POINTS) -> DataFrame:
    """One row with ``grid``: evenly spaced values from p0.5 to p99.5 of the feature."""
    q = percentiles(df, feature, [GRID_LOW, GRID_HIGH])
    step = (F.col("pcts")[1] - F.col("pcts")[0]) / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("pcts")[0] + i * step)
    return q.select(grid.alias("grid"))


def response_curves(df: DataFrame, grid: DataFrame, score_at: Callable[[Column], Column]) -> DataFrame:
    """Add ``curve``: the row's score with the feature set to each grid value, other columns unchanged.

    Evaluated inside the row, so rows are not multiplied and nothing is shuffled.
    """
    return with_row(df, grid).withColumn("curve", F.transform("grid", score_at))


def monotone_rows(curves: DataFrame) -> DataFrame:
    """Violations of an increasing response per row: tolerant, strict, and the worst drop."""
    steps = F.transform(F.sequence(F.lit(1), F.size("curve") - 1), lambda i: F.col("curve")[i] - F.col("curve")[i - 1])
    tol = F.greatest(F.lit(EPS_ABS), F.lit(EPS_REL) * (F.array_max("curve") - F.array_min("curve")))
    out = curves.withColumns({"_d": steps, "_tol": tol})
    return out.withColumns({
        "violations": F.size(F.filter("_d", lambda d: d < -F.col("_tol"))),
        "strict": F.size(F.filter("_d", lambda d: d < -EPS_STRICT)),
        "worst_drop": F.greatest(-F.array_min("_d"), F.lit(0.0)), "steps": F.size("_d"),
    }).drop("_d", "_tol")


def monotone_summary(rows: DataFrame) -> DataFrame:
    ok = F.avg((F.col("violations") == 0).cast("double")) * 100
    out = rows.agg(
        F.count("*").alias("n"), ok.alias("monotone_pct"), (F.avg((F.col("strict") == 0).cast("double")) * 100).alias("strict_pct"),
        F.avg("violations").alias("mean_violations"), F.avg("worst_drop").alias("mean_worst_drop"),
        F.coalesce(F.avg(F.when(F.col("violations") > 0, F.col("worst_drop"))), F.lit(0.0)).alias("violators_worst_drop"),
        (F.sum("violations") * 100 / F.sum("steps")).alias("violating_steps_pct"))
    sev = F.when(F.col("monotone_pct") < 90, "material").when(F.col("monotone_pct") < 99, "minor").otherwise("none")
    return out.withColumn("severity", sev)


def mean_curve(curves: DataFrame) -> DataFrame:
    """(step, value, mean_score): the partial dependence over the grid."""
    pairs = curves.select(F.posexplode(F.arrays_zip("grid", "curve")).alias("step", "e"))
    return pairs.groupBy("step").agg(F.max("e.grid").alias("value"), F.avg("e.curve").alias("mean_score"))


def decile_trend(df: DataFrame, feature: str, prob: str, label: str = "label", n: int = 10) -> DataFrame:
    """(bin, n, mean_value, mean_predicted, observed) by deciles of a feature."""
    binned = quantile_bin(df.filter(F.col(feature).isNotNull()), feature, n)
    return binned.groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(feature).alias("mean_value"), F.avg(prob).alias("mean_predicted"), F.avg(label).alias("observed"))


def trend_correlation(trend: DataFrame) -> DataFrame:
    return spearman(trend, {"predicted": ("mean_value", "mean_predicted"), "observed": ("mean_value", "observed")})
