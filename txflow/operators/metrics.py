"""Precision-recall and ROC metrics of a score, per group, at any number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txflow.operators.ordered import PART_ROWS, running_totals
from txflow.operators.reports import ratio


def score_counts(df: DataFrame, score: str = "score", label: str = "label", groups: Sequence[str] = ()) -> DataFrame:
    """(groups, score, n, p): rows and positives per distinct score, combined map-side; rows without a score are left out."""
    return df.filter(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("p"))


def unscored(df: DataFrame, score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """(groups, unscored): rows that no curve counts because their score is NULL."""
    return df.groupBy(*groups).agg(F.count_if(F.col(score).isNull()).alias("unscored"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "label", groups: Sequence[str] = (),
             part_rows: int = PART_ROWS) -> DataFrame:
    """One point per distinct score used as threshold: flagged, tp, precision, recall, f1."""
    counts = score_counts(df, score, label, groups)
    cum = running_totals(
        counts, score, {"flagged": "n", "tp": "p"}, groups, descending=True, part_rows=part_rows,
        totals={"positives": "p", "total": "n"},
    )
    p, rc = F.col("tp") / F.col("flagged"), ratio("tp", "positives")
    f1 = F.when(p + rc > 0, 2 * p * rc / (p + rc)).otherwise(F.lit(0.0))
    return cum.withColumns({"precision": p, "recall": rc, "f1": f1}).withColumnRenamed(score, "threshold")


def summary_from_curve(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Average precision, ROC-AUC and the best-F1 threshold (lowest on ties) from one curve."""
    neg, total_neg = F.col("n") - F.col("p"), F.max(F.col("total") - F.col("positives"))
    neg_below = (F.col("total") - F.col("positives")) - (F.col("flagged") - F.col("tp"))
    pos = F.max("positives")
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    out = curve.groupBy(*groups).agg(
        F.max("total").alias("n"), pos.alias("positives"),
        (F.sum(F.col("p") * F.col("precision")) / F.when(pos > 0, pos)).alias("average_precision"),
        (F.sum(F.col("p") * (neg_below + neg / 2)) / F.when((pos > 0) & (total_neg > 0), pos * total_neg)).alias("roc_auc"),
        best.alias("best"),
    )
    return out.select(
        *groups, "n", "positives", "average_precision", "roc_auc", F.col("best.threshold").alias("best_threshold"),
        F.col("best.precision").alias("best_precision"), F.col("best.recall").alias("best_recall"), F.col("best.f1").alias("best_f1"),
    )


def score_summary(df: DataFrame, score: str = "score", label: str = "label", groups: Sequence[str] = (),
                  part_rows: int = PART_ROWS) -> DataFrame:
    return summary_from_curve(pr_curve(df, score, label, groups, part_rows), groups)


def average_precision(df: DataFrame, score: str = "score", label: str = "label", groups: Sequence[str] = (),
                      min_positives: int = 1) -> DataFrame:
    """(groups, n, positives, average_precision); NULL with too few positives."""
    out = score_summary(df, score, label, groups)
    ap = F.when(F.col("positives") >= min_positives, F.col("average_precision"))
    return out.select(*groups, "n", "positives", ap.alias("average_precision"))


def threshold_sweep(curve: DataFrame, targets: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """For every target the curve point with the lowest threshold >= target, else the highest one."""
    point = F.struct("threshold", "precision", "recall", "f1")
    aggs = []
    for i, t in enumerate(targets):
        ok = F.col("threshold") >= F.lit(float(t))
        aggs.append(F.coalesce(F.min(F.when(ok, point)), F.max(point)).alias(f"_{i}"))
    row = curve.groupBy(*groups).agg(*aggs)
    items = F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"_{i}").alias("p")) for i, t in enumerate(targets)])
    return row.select(*groups, F.explode(items).alias("e")).select(*groups, "e.target", "e.p.*")


def confusion(pred: Column, label: str = "label") -> dict[str, Column]:
    y = F.col(label) == 1
    return {
        "tp": F.count_if(pred & y), "fp": F.count_if(pred & ~y), "fn": F.count_if(~pred & y), "tn": F.count_if(~pred & ~y),
    }


def with_prf(df: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp / fp / fn; 0 where a denominator is 0."""
    z = F.lit(0.0)
    p = F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), z)
    rc = F.coalesce(ratio("tp", F.col("tp") + F.col("fn")), z)
    out = df.withColumns({"precision": p, "recall": rc})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), both), z))


def metrics_at(df: DataFrame, threshold: float, score: str = "score", label: str = "label", groups: Sequence[str] = ()) -> DataFrame:
    pred = F.col(score) >= F.lit(float(threshold))
    return with_prf(df.groupBy(*groups).agg(*[c.alias(k) for k, c in confusion(pred, label).items()]))


def class_report(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """Per class, macro and weighted precision, recall, f1 and support."""
    one = metrics_at(df, threshold, score, label)
    zero = one.select(F.col("tn").alias("tp"), F.col("fn").alias("fp"), F.col("fp").alias("fn"))
    cols = ("precision", "recall", "f1")
    support = (F.col("tp") + F.col("fn")).alias("support")
    rows = with_prf(zero).select(F.lit("0").alias("class"), *cols, support).unionByName(
        one.select(F.lit("1").alias("class"), *cols, support)
    )
    macro = rows.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support"))
    weighted = rows.agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in cols], F.sum("support").alias("support")
    )
    return rows.unionByName(macro.withColumn("class", F.lit("macro avg"))).unionByName(
        weighted.withColumn("class", F.lit("weighted avg"))
    )
