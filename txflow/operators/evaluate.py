"""Evaluation reports: slices, positions, confidence buckets, routing, gates, robustness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txflow.functions import decide
from txflow.functions.clean import bin_index
from txflow.operators.joining import with_row
from txflow.operators.metrics import average_precision, confusion, pr_curve, summary_from_curve
from txflow.operators.ordered import percentiles
from txflow.operators.reports import ratio, wide_to_rows

# Confidence buckets, position buckets and verdict limits.
CONFIDENCE_EDGES = (0.0, 0.40, 0.60, 0.75, 0.90, 1.01)
CONFIDENCE_NAMES = ("very low [0,.4)", "low [.4,.6)", "moderate [.6,.75)", "high [.75,.9)", "very high [.9,1]")
GATE_AP_DROP, GATE_F1_DROP = 0.005, 0.01


def relative_change(before, after) -> Column:
    b, a = (F.col(c) if isinstance(c, str) else c for c in (before, after))
    return (a - b) * 100 / F.greatest(b, F.lit(1e-9))


# --- slices and models --------------------------------------------------------------------

def slice_models(df: DataFrame, preds: dict[str, Column], slices: dict[str, Column], label: str = "label") -> DataFrame:
    """False positives of each model on each slice, in one pass over the table."""
    aggs = []
    legit = F.col(label) == 0
    for i, m in enumerate(slices.values()):
        aggs.append(F.count_if(m & legit).alias(f"{i}_n"))
        aggs += [F.count_if(m & legit & p).alias(f"{i}_{k}") for k, p in preds.items()]
    rows = wide_to_rows(df.agg(*aggs), list(slices), ("n", *preds), "slice")
    items = F.array(*[F.struct(F.lit(k).alias("model"), F.col(k).alias("fp")) for k in preds])
    out = rows.select("slice", "n", F.explode(items).alias("e")).select("slice", "n", "e.*")
    return out.withColumn("fp_rate", ratio("fp", "n"))


def slice_changes(table: DataFrame, before: str, after: str) -> DataFrame:
    b = table.filter(F.col("model") == before).select("slice", F.col("fp_rate").alias("before"))
    a = table.filter(F.col("model") == after).select("slice", F.col("fp_rate").alias("after"))
    return b.join(a, "slice").withColumn("change_pct", relative_change("before", "after"))


def compare_models(long: DataFrame, score: str = "score", label: str = "label", model: str = "model") -> DataFrame:
    """Average precision, best threshold and F1 per model from one grouped curve."""
    return summary_from_curve(pr_curve(long, score, label, [model]), [model])


def model_change(table: DataFrame, before: str, after: str, metric: str = "average_precision") -> DataFrame:
    """Difference and verdict between two rows of a comparison table."""
    b = table.filter(F.col("model") == before).select(F.col(metric).alias("before"))
    a = table.filter(F.col("model") == after).select(F.col(metric).alias("after"))
    delta = F.col("after") - F.col("before")
    verdict = F.when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("unchanged")
    return with_row(b, a).withColumns({"delta": delta, "change_pct": relative_change("before", "after"), "verdict": verdict})


# --- position -----------------------------------------------------------------------------

def position_bucket(position: str, edges: Sequence[float]) -> Column:
    """Right-open bucket number over fixed edges."""
    return bin_index(position, edges)


def quartile_buckets(df: DataFrame, position: str) -> DataFrame:
    """Add ``bucket`` 0-3 by the truncated quartiles of the position."""
    q = percentiles(df, position, [0.25, 0.5, 0.75])
    b = F.size(F.filter("pcts", lambda e: F.floor(e) <= F.col(position)))
    return with_row(df, q).withColumn("bucket", b).drop("pcts")


def bucket_average_precision(df: DataFrame, bucket: str, scores: dict[str, str], label: str = "label",
                             min_positives: int = 2) -> DataFrame:
    """(bucket, n, positives, one column per model): NULL where a bucket has too few positives."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in scores.items()])
    long = df.select(bucket, label, F.explode(pairs).alias("e")).select(bucket, label, "e.*")
    ap = average_precision(long, "score", label, [bucket, "model"], min_positives)
    return ap.groupBy(bucket).agg(
        F.max("n").alias("n"), F.max("positives").alias("positives"),
        *[F.max(F.when(F.col("model") == m, F.col("average_precision"))).alias(m) for m in scores],
    )


def uniformity(buckets: DataFrame, before: str, after: str) -> DataFrame:
    """Is the gain the same everywhere? spread < .03 uniform; min < .01 and max > .05 concentrated."""
    d = F.col(after) - F.col(before)
    out = buckets.filter(d.isNotNull()).agg(F.min(d).alias("d_min"), F.max(d).alias("d_max"), F.avg(d).alias("d_mean"))
    spread = F.col("d_max") - F.col("d_min")
    verdict = (
        F.when(F.col("d_min").isNull(), "insufficient_data").when(spread < 0.03, "uniform")
        .when((F.col("d_min") < 0.01) & (F.col("d_max") > 0.05), "concentrated").otherwise("mixed")
    )
    return out.withColumns({"spread": spread, "verdict": verdict})


def correlation_band(rho) -> Column:
    a = F.abs(F.col(rho) if isinstance(rho, str) else rho)
    return (
        F.when(a > 0.7, "STRONG proxy for position").when(a > 0.3, "moderate correlation")
        .when(a > 0.1, "weak correlation").otherwise("negligible")
    )


def position_skew(df: DataFrame, mask: Column, position: str) -> DataFrame:
    """Mean position of a slice against all rows, with verdict at .85 / 1.15."""
    out = df.agg(F.avg(F.when(mask, F.col(position))).alias("slice_mean"), F.avg(position).alias("all_mean"))
    rt = F.col("slice_mean") / F.when(F.col("all_mean") != 0, F.col("all_mean"))
    verdict = F.when(rt < 0.85, "skews_early").when(rt > 1.15, "skews_late").otherwise("no_significant_skew")
    return out.withColumns({"ratio": rt, "verdict": verdict})


def evidence(uniformity_row: DataFrame, proxies: DataFrame, score_rho: DataFrame, skew_row: DataFrame) -> DataFrame:
    """Count findings for and against the position explaining the gain; all inputs are one-row reports.

    ``proxies`` has the count ``n`` of features with |rho| > .5, ``score_rho`` the column ``rho``.
    """
    row = uniformity_row.select(F.col("verdict").alias("u"))
    for other in (proxies.select("n"), score_rho.select("rho"), skew_row.select(F.col("verdict").alias("s"))):
        row = with_row(row, other)
    one = lambda c: c.cast("int")
    moves = F.coalesce(F.abs("rho") > 0.1, F.lit(False))
    n_for = one(F.col("u") == "concentrated") + one(F.col("n") > 0) + one(moves) + one(F.col("s") == "skews_early")
    n_against = (
        one(F.col("u") != "concentrated") + one(F.col("n") == 0) + one(~moves) + one(F.col("s") == "no_significant_skew")
    )
    out = row.select(n_for.alias("n_for"), n_against.alias("n_against"))
    return out.withColumn(
        "verdict",
        F.when(F.col("n_for") == 0, "NO position confound detected.")
        .when(F.col("n_against") == 0, "STRONG position confound detected.")
        .when(F.col("n_for") > F.col("n_against"), "LIKELY partial position confound.")
        .otherwise("UNLIKELY to be primarily position-driven."),
    )


# --- confidence ---------------------------------------------------------------------------

def confidence_bucket(score) -> Column:
    index = bin_index(score, CONFIDENCE_EDGES)
    return F.element_at(F.array(*[F.lit(n) for n in CONFIDENCE_NAMES]), index + 1)


def component_table(df: DataFrame, components: dict[str, Column]) -> DataFrame:
    """Mean and shares below .5, below .3 and at 1 of every confidence component."""
    aggs = []
    for i, c in enumerate(components.values()):
        share = lambda m: F.avg(m.cast("double"))
        aggs += [F.avg(c).alias(f"{i}_mean"), share(c < 0.5).alias(f"{i}_below_half"),
                 share(c < 0.3).alias(f"{i}_below_third"), share(c == 1.0).alias(f"{i}_full")]
    return wide_to_rows(df.agg(*aggs), list(components), ("mean", "below_half", "below_third", "full"), "component")


def confidence_table(df: DataFrame, conf: str, pred: Column, label: str = "label") -> DataFrame:
    """Counts, precision, recall, F1 and FP rate per confidence bucket."""
    out = df.groupBy(bin_index(conf, CONFIDENCE_EDGES).alias("level"), confidence_bucket(conf).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives"),
        *[c.alias(k) for k, c in confusion(pred, label).items()],
    )
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    rc = F.when(F.col("positives") > 0, F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9))
    return out.withColumns({"precision": p, "recall": rc}).withColumns({
        "f1": f1, "fp_rate": F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1)),
    })


def confidence_monotone(table: DataFrame, slack: float = 0.01) -> DataFrame:
    """Does precision rise with confidence? Five rows, so the window is one task.

    A bucket with zero precision counts as having none, as in the published report.
    """
    has = table.filter(F.col("precision") > 0)
    before = F.lag("precision").over(Window.orderBy("level"))
    drops = has.withColumn("drop", F.coalesce(before > F.col("precision") + slack, F.lit(False)))
    out = drops.agg(F.count("*").alias("buckets"), F.count_if("drop").alias("drops"))
    verdict = (
        F.when(F.col("buckets") < 3, "insufficient_data").when(F.col("drops") == 0, "monotonic").otherwise("non_monotonic")
    )
    return out.withColumn("verdict", verdict)


def first_mcc_buckets(df: DataFrame, conf: str, pred: Column, label: str = "label") -> DataFrame:
    """Confidence buckets of legitimate first-category rows, their share and FP rate."""
    legit = df.filter((F.col("first_mcc") == 1) & (F.col(label) == 0))
    out = legit.groupBy(confidence_bucket(conf).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(pred).alias("fp"))
    share = F.col("n") * 100 / F.sum("n").over(Window.partitionBy())  # five rows
    return out.withColumns({"share_pct": share, "fp_rate": ratio("fp", "n")})


def first_mcc_verdict(df: DataFrame, conf: str, label: str = "label") -> DataFrame:
    legit = df.filter((F.col("first_mcc") == 1) & (F.col(label) == 0))
    pct = F.count_if(F.col(conf) < 0.60) * 100 / F.greatest(F.count("*"), F.lit(1))
    out = legit.agg(F.count("*").alias("n"), pct.alias("low_pct"))
    return out.withColumn(
        "verdict", F.when(F.col("low_pct") > 50, "correctly_low_confidence").when(F.col("low_pct") > 20, "partial_coverage")
        .otherwise("insufficient_coverage"))


# --- routing ------------------------------------------------------------------------------

def router_summary(df: DataFrame, binary: Column, label: str = "label", *groups: str) -> DataFrame:
    """Everything the router report needs, in one aggregate per group."""
    y = F.col(label) == 1
    d = F.col("decision")
    block, step, ok = d == "block", d == "step_up", d == "approve"
    counts = {
        "n": F.count("*"), "blocks": F.count_if(block), "step_ups": F.count_if(step), "approvals": F.count_if(ok),
        "block_tp": F.count_if(block & y), "block_fp": F.count_if(block & ~y), "step_up_positives": F.count_if(step & y),
        "step_up_negatives": F.count_if(step & ~y), "missed": F.count_if(ok & y), "positives": F.count_if(y),
        "negatives": F.count_if(~y), "binary_tp": F.count_if(binary & y), "binary_fp": F.count_if(binary & ~y),
        "fp_rescued": F.count_if(step & ~y & binary), "misses_caught": F.count_if(step & y & ~binary),
    }
    out = df.groupBy(*groups).agg(*[c.alias(k) for k, c in counts.items()])
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.withColumns({
        "block_precision": over("block_tp", "blocks"),
        "binary_precision": F.col("binary_tp") / F.greatest(F.col("binary_tp") + F.col("binary_fp"), F.lit(1)),
        "recall_block": ratio("block_tp", "positives"),
        "recall_block_step_up": ratio(F.col("block_tp") + F.col("step_up_positives"), "positives"),
        "recall_binary": ratio("binary_tp", "positives"),
        "rescued_pct": over("fp_rescued", "binary_fp") * 100,
        "missed_rate": over("missed", "approvals"),
        "step_up_rate_negatives": ratio("step_up_negatives", "negatives"),
    })


def review_band(df: DataFrame, prob: str, conf: str, threshold: float = decide.THRESHOLD, low: float = decide.REVIEW_BAND_LOW,
                gate: float = decide.CONF_STEPUP) -> DataFrame:
    """Best confidence reachable in the review band against the gate, and what was observed there."""
    w = decide.WEIGHTS
    reach = F.least((F.lit(threshold) - F.lit(low)) / F.lit(decide.CERT_BELOW_SCALE), F.lit(1.0))
    ceiling = F.lit(w["certainty"]) * reach + F.lit(w["history"] + w["familiarity"] + w["novelty"] + w["completeness"])
    inside = (F.col(prob) >= low) & (F.col(prob) < threshold)
    return df.agg(
        F.count_if(inside).alias("n"), F.max(F.when(inside, F.col(conf))).alias("max_confidence"),
        F.count_if(inside & (F.col(conf) >= gate)).alias("over_gate"),
    ).withColumns({"ceiling": ceiling, "reachable": (ceiling >= gate).cast("int")})


def what_if(df: DataFrame, prob: str, conf: str, position: str, blocks: Sequence[float], stepup: float = decide.CONF_STEPUP,
            label: str = "label") -> DataFrame:
    """Router counts, precision and recall for many block thresholds, without scoring again.

    The threshold only tells which of the rows that reach the block rule are blocked, so
    rows are routed once and counted per threshold in one aggregate.
    """
    y = F.col(label) == 1
    d = decide.route(prob, conf, position, prob_block=0.0, conf_stepup=stepup)["decision"]
    routed = df.select(F.col(prob).alias("_p"), (d == "block").alias("_reach"), (d == "step_up").alias("_step"), y.alias("_y"))
    aggs = [F.count_if("_y").alias("_pos"), F.count_if("_step").alias("step_ups")]
    for i, b in enumerate(blocks):
        hit = F.col("_reach") & (F.col("_p") >= float(b))
        aggs += [F.count_if(hit).alias(f"{i}_blocks"), F.count_if(hit & F.col("_y")).alias(f"{i}_tp")]
    items = F.array(*[F.struct(F.lit(float(b)).alias("prob_block"), *[F.col(f"{i}_{s}").alias(s) for s in ("blocks", "tp")])
                      for i, b in enumerate(blocks)])
    out = routed.agg(*aggs).select("_pos", "step_ups", F.explode(items).alias("e")).select("_pos", "step_ups", "e.*")
    return out.select("prob_block", "blocks", "step_ups", "tp", ratio("tp", "blocks").alias("precision"), ratio("tp", "_pos").alias("recall"))


def routing_ablation(df: DataFrame, variants: dict[str, Column], rare: Column, new_mcc: Column, label: str = "label") -> DataFrame:
    """Block precision and hard-block rates of legitimate rare rows for several routers."""
    y, aggs = F.col(label) == 1, []
    for i, d in enumerate(variants.values()):
        b = d == "block"
        aggs += [F.count_if(b).alias(f"{i}_blocks"), F.count_if(b & y).alias(f"{i}_tp"),
                 F.count_if(b & ~y & rare).alias(f"{i}_rare_blocked"), F.count_if(~y & rare).alias(f"{i}_rare"),
                 F.count_if(b & ~y & new_mcc).alias(f"{i}_new_mcc_blocked"), F.count_if(~y & new_mcc).alias(f"{i}_new_mcc")]
    stats = ("blocks", "tp", "rare_blocked", "rare", "new_mcc_blocked", "new_mcc")
    out = wide_to_rows(df.agg(*aggs), list(variants), stats, "variant")
    return out.select(
        "variant", "blocks", "tp", ratio("tp", "blocks").alias("block_precision"),
        ratio("rare_blocked", "rare").alias("rare_block_rate"), ratio("new_mcc_blocked", "new_mcc").alias("new_mcc_block_rate"))


# --- gates and robustness -----------------------------------------------------------------

def gate(current: DataFrame, candidate: DataFrame, ap_drop: float = GATE_AP_DROP, f1_drop: float = GATE_F1_DROP) -> DataFrame:
    """Promote or reject a candidate; both inputs are one row with average_precision and f1."""
    row = with_row(current.select(F.col("average_precision").alias("ap0"), F.col("f1").alias("f0")),
                   candidate.select(F.col("average_precision").alias("ap1"), F.col("f1").alias("f1")))
    lost_ap, lost_f1 = F.col("ap0") - F.col("ap1"), F.col("f0") - F.col("f1")
    bad_ap, bad_f1 = lost_ap > ap_drop, lost_f1 > f1_drop
    reasons = F.concat_ws("; ", F.when(bad_ap, F.format_string(f"AUC-PR dropped by %.4f (limit {ap_drop})", lost_ap)),
                          F.when(bad_f1, F.format_string(f"F1 dropped by %.4f (limit {f1_drop})", lost_f1)))
    return row.select(
        (-lost_ap).alias("ap_change"), (-lost_f1).alias("f1_change"),
        F.when(bad_ap | bad_f1, "reject").otherwise("promote").alias("decision"), reasons.alias("reasons"))


def evasion_report(attempts: DataFrame, threshold: float, row: str = "row_id") -> DataFrame:
    """Catchable rows, and how many got below the threshold in the first / in any attempt.

    ``attempts``: row_id, attempt (0 = deterministic), score_before, score_after.
    """
    t = F.lit(float(threshold))
    caught = attempts.filter(F.col("score_before") >= t)
    per_row = caught.groupBy(row).agg(
        F.max(((F.col("attempt") == 0) & (F.col("score_after") < t)).cast("int")).alias("det"),
        F.max((F.col("score_after") < t).cast("int")).alias("any"),
    )
    return per_row.agg(
        F.count("*").alias("catchable"), F.sum("det").alias("evaded_det"), F.sum("any").alias("evaded_any"),
        F.avg("det").alias("rate_det"), F.avg("any").alias("rate_any"))


def perturbation_profile(pairs: DataFrame, features: Sequence[str]) -> DataFrame:
    """mean |after - before| / std(before) per feature, largest first.

    Columns are ``<feature>_before`` and ``<feature>_after``.
    """
    aggs = []
    for i, f in enumerate(features):
        b, a = F.col(f + "_before"), F.col(f + "_after")
        s = F.stddev_pop(b)
        aggs += [(F.avg(F.abs(a - b)) / F.when(s > 0, s)).alias(f"{i}_shift"), F.count_if(a != b).alias(f"{i}_changed")]
    return wide_to_rows(pairs.agg(*aggs), list(features), ("shift", "changed")).orderBy(F.desc_nulls_last("shift"), "feature")


def score_drop(attempts: DataFrame) -> DataFrame:
    d = F.col("score_before") - F.col("score_after")
    return attempts.agg(F.avg(d).alias("mean_drop"), F.max(d).alias("max_drop"), F.min(d).alias("min_drop"),
                        F.stddev_samp(d).alias("std_drop"))


def robustness_verdict(report: DataFrame, rate: str = "rate_any") -> DataFrame:
    v = F.when(F.col(rate) < 0.10, "structural").when(F.col(rate) > 0.50, "overfit").otherwise("partial")
    return report.withColumn("verdict", v)


def fidelity(both: DataFrame, cols: Sequence[str], source: str = "source", real: str = "real", synthetic: str = "synthetic") -> DataFrame:
    """Moments of real and synthetic rows, and synthetic rows outside the real range."""
    aggs = []
    for i, c in enumerate(cols):
        for s, name in (("r", real), ("s", synthetic)):
            v = F.when(F.col(source) == name, F.col(c).cast("double"))
            aggs += [F.avg(v).alias(f"{i}_mean_{s}"), F.stddev_samp(v).alias(f"{i}_std_{s}"),
                     F.min(v).alias(f"{i}_min_{s}"), F.max(v).alias(f"{i}_max_{s}")]
    stats = [f"{m}_{s}" for s in "rs" for m in ("mean", "std", "min", "max")]
    moments = wide_to_rows(both.agg(*aggs), list(cols), stats)
    limits = both.filter(F.col(source) == real).agg(
        *[f(F.col(c).cast("double")).alias(f"_{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))])
    fake = with_row(both.filter(F.col(source) == synthetic), limits)
    outside = []
    for i, c in enumerate(cols):
        outside += [F.count_if(F.col(c) < F.col(f"_lo{i}")).alias(f"{i}_below"), F.count_if(F.col(c) > F.col(f"_hi{i}")).alias(f"{i}_above")]
    return moments.join(wide_to_rows(fake.agg(*outside), list(cols), ("below", "above")), "feature")


def correlation_deltas(both: DataFrame, pairs: dict[str, tuple[str, str]], source: str = "source", real: str = "real",
                       synthetic: str = "synthetic") -> DataFrame:
    aggs = []
    for i, (a, b) in enumerate(pairs.values()):
        for s, name in (("r", real), ("s", synthetic)):
            hit = F.col(source) == name
            aggs.append(F.corr(F.when(hit, F.col(a).cast("double")), F.when(hit, F.col(b).cast("double"))).alias(f"{i}_{s}"))
    return wide_to_rows(both.agg(*aggs), list(pairs), ("r", "s"), "pair").withColumn("delta", F.abs(F.col("s") - F.col("r")))


def segments_helped(long: DataFrame, segment: str, base: str, other: str, score: str = "score", label: str = "label") -> DataFrame:
    """Average precision of two models per segment and whether the second one helps there."""
    ap = average_precision(long, score, label, [segment, "model"])
    wide = ap.groupBy(segment).agg(*[
        F.max(F.when(F.col("model") == m, F.col("average_precision"))).alias(n) for n, m in (("ap_base", base), ("ap_other", other))])
    return wide.withColumn("helped", F.coalesce(F.col("ap_other") > F.col("ap_base"), F.lit(False)).cast("int"))
