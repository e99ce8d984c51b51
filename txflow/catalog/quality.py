"""Model-quality evaluation (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txflow.catalog.base import big, confident, model_long, r, routed, scored, scored_history, tx_events, tx_orders
from txflow.catalog.registry import query
from txflow.catalog.sql import S, head
from txflow.functions import decide
from txflow.functions.clean import zero_out
from txflow.operators import evaluate as ev
from txflow.operators import metrics as mt
from txflow.operators.joining import with_row
from txflow.operators.ordered import spearman
from txflow.operators.split import banks

_PRF = """flagged, tp, CAST(tp AS DOUBLE) / flagged AS "precision", CAST(tp AS DOUBLE) / pos AS recall,
    CASE WHEN tp > 0 THEN 2.0 * tp / (flagged + pos) ELSE 0 END AS f1"""


def _plain_long(spark, sf):
    return model_long(scored(tx_events(spark, sf)))


@query("e01_average_precision", S("""SELECT model, CAST(max(total) AS BIGINT) AS n, CAST(max(pos) AS BIGINT) AS positives,
    round(sum(CAST(p AS DOUBLE) * tp / flagged) / max(pos), 6) AS average_precision FROM curve GROUP BY 1""", "curve"))
def e01(spark, sf):
    out = mt.average_precision(_plain_long(spark, sf), groups=["model"])
    return out.select("model", "n", "positives", r("average_precision").alias("average_precision"))


@query("e02_roc_auc", S("""SELECT model, round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
    / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)), 6) AS roc_auc FROM (SELECT *,
     rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS rk FROM long) GROUP BY 1""", "long"))
def e02(spark, sf):
    return mt.score_summary(_plain_long(spark, sf), groups=["model"]).select("model", r("roc_auc").alias("roc_auc"))


@query("e03_pr_curve", S(f"""SELECT model, score AS threshold, CAST(flagged AS BIGINT) AS flagged, CAST(tp AS BIGINT) AS tp,
    round("precision", 6) AS "precision", round(recall, 6) AS recall FROM (SELECT model, score, {_PRF} FROM curve)""", "curve"))
def e03(spark, sf):
    out = mt.pr_curve(_plain_long(spark, sf), groups=["model"])
    return out.select("model", "threshold", big("flagged").alias("flagged"), big("tp").alias("tp"), r("precision").alias("precision"), r("recall").alias("recall"))


@query("e04_best_f1", S(f"""SELECT model, threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM
    (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS rk FROM (SELECT model, score AS threshold, {_PRF} FROM curve)) WHERE rk = 1""", "curve"))
def e04(spark, sf):
    out = mt.score_summary(_plain_long(spark, sf), groups=["model"])
    return out.select("model", F.col("best_threshold").alias("threshold"), *[r("best_" + c).alias(c) for c in ("precision", "recall", "f1")])


@query("e05_threshold_sweep", S(f"""SELECT model, target, threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM
    (SELECT *, row_number() OVER (PARTITION BY model, target ORDER BY CASE WHEN threshold >= target THEN 0 ELSE 1 END,
      CASE WHEN threshold >= target THEN threshold ELSE -threshold END) AS rk FROM (SELECT model, score AS threshold, {_PRF} FROM curve),
      (SELECT CAST(unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS DOUBLE) AS target)) WHERE rk = 1""", "curve"))
def e05(spark, sf):
    curve = mt.pr_curve(_plain_long(spark, sf), groups=["model"])
    out = mt.threshold_sweep(curve, [i / 10 for i in range(1, 10)], ["model"])
    return out.select("model", "target", "threshold", r("precision").alias("precision"), r("recall").alias("recall"))


_AT = """count(*) FILTER (score >= 0.6 AND label = 1) AS tp, count(*) FILTER (score >= 0.6 AND label = 0) AS fp,
    count(*) FILTER (score < 0.6 AND label = 1) AS fn, count(*) FILTER (score < 0.6 AND label = 0) AS tn"""


@query("e06_metrics_at_threshold", S(f"""SELECT model, tp, fp, fn, tn, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) AS "precision",
    round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
    FROM (SELECT model, {_AT} FROM long GROUP BY 1)""", "long"))
def e06(spark, sf):
    out = mt.metrics_at(_plain_long(spark, sf), 0.6, groups=["model"])
    return out.select("model", "tp", "fp", "fn", "tn", *[r(c).alias(c) for c in ("precision", "recall", "f1")])


@query("e07_class_report", head("long") + f""", c AS (SELECT {_AT} FROM long WHERE model = 'a'),
    k AS (SELECT '1' AS class, CAST(tp AS DOUBLE) / (tp + fp) AS p, CAST(tp AS DOUBLE) / (tp + fn) AS rc, 2.0 * tp / (2 * tp + fp + fn) AS f, tp + fn AS s FROM c
     UNION ALL SELECT '0', CAST(tn AS DOUBLE) / (tn + fn), CAST(tn AS DOUBLE) / (tn + fp), 2.0 * tn / (2 * tn + fp + fn), tn + fp FROM c)
    SELECT class, round(p, 6) AS "precision", round(rc, 6) AS recall, round(f, 6) AS f1, s AS support FROM k
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(rc), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM k
    UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(rc * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM k""")
def e07(spark, sf):
    out = mt.class_report(scored(tx_events(spark, sf)), 0.6, "score_a")
    return out.select("class", *[r(c).alias(c) for c in ("precision", "recall", "f1")], big("support").alias("support"))


_RARE = "(amount_unusual OR first_mcc = 1 OR first_city_state = 1)"
_SLICES = {"amount_unusual": "amount_unusual", "new_mcc": "first_mcc = 1", "new_location": "first_city_state = 1", "rare_any": _RARE, "ordinary": f"NOT {_RARE}"}


def _rare_masks():
    return {k: F.col(k) for k in _SLICES}


@query("e08_slice_fp_by_model", S("\nUNION ALL ".join(f"""SELECT '{s}' AS slice, '{m}' AS model, count(*) AS n, count(*) FILTER (score_{m} >= 0.5) AS fp,
    round(CAST(count(*) FILTER (score_{m} >= 0.5) AS DOUBLE) / count(*), 6) AS fp_rate FROM sc WHERE label = 0 AND {w}"""
    for s, w in _SLICES.items() for m in "ab"), "sc"))
def e08(spark, sf):
    preds = {m: F.col(f"score_{m}") >= 0.5 for m in "ab"}
    out = ev.slice_models(scored_history(spark, sf), preds, _rare_masks())
    return out.select("slice", "model", "n", "fp", r("fp_rate").alias("fp_rate"))


@query("e08_slice_changes", S("\nUNION ALL ".join(f"""SELECT '{s}' AS slice, round(a, 6) AS before, round(b, 6) AS after,
    round((b - a) * 100 / greatest(a, 1e-9), 4) AS change_pct FROM (SELECT avg(CAST(score_a >= 0.5 AS INTEGER)) AS a,
     avg(CAST(score_b >= 0.5 AS INTEGER)) AS b FROM sc WHERE label = 0 AND {w})""" for s, w in _SLICES.items()), "sc"))
def e08c(spark, sf):
    preds = {m: F.col(f"score_{m}") >= 0.5 for m in "ab"}
    out = ev.slice_changes(ev.slice_models(scored_history(spark, sf), preds, _rare_masks()), "a", "b")
    return out.select("slice", r("before").alias("before"), r("after").alias("after"), r("change_pct", 4).alias("change_pct"))


_EDGES = (0, 10, 20, 40, 60, 1000)


def _grouped_ap(source: str, bucket: str) -> str:
    return f""", lb AS (SELECT {bucket} AS bucket, label, model, score FROM {source}),
    cb AS (SELECT bucket, model, sum(n) OVER w AS flagged, sum(p) OVER w AS tp, p, n FROM
     (SELECT bucket, model, score, count(*) AS n, sum(label) AS p FROM lb GROUP BY ALL) WINDOW w AS (PARTITION BY bucket, model ORDER BY score DESC)),
    ap AS (SELECT bucket, model, sum(n) AS n, sum(p) AS positives, CASE WHEN sum(p) >= 2 THEN sum(CAST(p AS DOUBLE) * tp / flagged) / sum(p) END AS ap FROM cb GROUP BY ALL)
    SELECT CAST(bucket AS BIGINT) AS bucket, CAST(max(n) AS BIGINT) AS n, CAST(max(positives) AS BIGINT) AS positives,
     round(max(ap) FILTER (model = 'a'), 6) AS a, round(max(ap) FILTER (model = 'b'), 6) AS b FROM ap GROUP BY 1"""


_FIXED_BUCKET = " + ".join(f"CAST(user_tx_count >= {e} AS INTEGER)" for e in _EDGES[1:-1])


@query("e09_position_buckets", head("long") + _grouped_ap("long", _FIXED_BUCKET))
def e09(spark, sf):
    df = scored_history(spark, sf).withColumn("bucket", ev.position_bucket("user_tx_count", _EDGES))
    out = ev.bucket_average_precision(df, "bucket", {"a": "score_a", "b": "score_b"})
    return out.select(big("bucket").alias("bucket"), "n", "positives", r("a").alias("a"), r("b").alias("b"))


_QUART = """(SELECT long.*, CAST(user_tx_count >= floor(q1) AS INTEGER) + CAST(user_tx_count >= floor(q2) AS INTEGER) + CAST(user_tx_count >= floor(q3) AS INTEGER) AS qb
    FROM long, (SELECT quantile_cont(CAST(user_tx_count AS DOUBLE), CAST(0.25 AS DOUBLE)) AS q1, quantile_cont(CAST(user_tx_count AS DOUBLE), CAST(0.5 AS DOUBLE)) AS q2,
     quantile_cont(CAST(user_tx_count AS DOUBLE), CAST(0.75 AS DOUBLE)) AS q3 FROM uf))"""


@query("e09_quartile_buckets", head("long") + _grouped_ap(_QUART, "qb"))
def e09q(spark, sf):
    df = ev.quartile_buckets(scored_history(spark, sf), "user_tx_count")
    out = ev.bucket_average_precision(df, "bucket", {"a": "score_a", "b": "score_b"})
    return out.select(big("bucket").alias("bucket"), "n", "positives", r("a").alias("a"), r("b").alias("b"))


@query("e10_uniformity", head("long") + _grouped_ap(_QUART, "qb").replace(
    "SELECT CAST(bucket AS BIGINT) AS bucket,", ", t AS (SELECT bucket,").replace(
    "round(max(ap) FILTER (model = 'a'), 6) AS a, round(max(ap) FILTER (model = 'b'), 6) AS b FROM ap GROUP BY 1",
    "max(ap) FILTER (model = 'b') - max(ap) FILTER (model = 'a') AS d FROM ap GROUP BY 1)") +
    """ SELECT round(min(d), 6) AS d_min, round(max(d), 6) AS d_max, round(avg(d), 6) AS d_mean,
    CASE WHEN max(d) - min(d) < 0.03 THEN 'uniform' WHEN min(d) < 0.01 AND max(d) > 0.05 THEN 'concentrated' ELSE 'mixed' END AS verdict FROM t""")
def e10(spark, sf):
    df = ev.quartile_buckets(scored_history(spark, sf), "user_tx_count")
    out = ev.uniformity(ev.bucket_average_precision(df, "bucket", {"a": "score_a", "b": "score_b"}), "a", "b")
    return out.select(r("d_min").alias("d_min"), r("d_max").alias("d_max"), r("d_mean").alias("d_mean"), "verdict")


_RHO = {"merchant_user_count": "merchant_user_count", "mcc_user_count": "mcc_user_count", "first_mcc": "first_mcc",
        "user_amount_zscore": "user_amount_zscore", "score_gain": "(score_b - score_a)"}


@query("e11_spearman", S("\nUNION ALL ".join(f"""SELECT pair, n, round(rho, 6) AS rho, CASE WHEN abs(rho) > 0.7 THEN 'STRONG proxy for position'
    WHEN abs(rho) > 0.3 THEN 'moderate correlation' WHEN abs(rho) > 0.1 THEN 'weak correlation' ELSE 'negligible' END AS band FROM
    (SELECT '{n}' AS pair, count(*) AS n, corr(ra, rb) AS rho FROM (SELECT
     rank() OVER (ORDER BY user_tx_count) + (count(*) OVER (PARTITION BY user_tx_count) - 1) / 2.0 AS ra,
     rank() OVER (ORDER BY round({e}, 9)) + (count(*) OVER (PARTITION BY round({e}, 9)) - 1) / 2.0 AS rb FROM sc WHERE {e} IS NOT NULL))""" for n, e in _RHO.items()), "sc"))
def e11(spark, sf):
    df = scored_history(spark, sf)
    cols = df.select("user_tx_count", *[F.round(F.expr(e), 9).alias(n) for n, e in _RHO.items()])
    out = spearman(cols, {n: ("user_tx_count", n) for n in _RHO})
    return out.select("pair", "n", r("rho").alias("rho"), ev.correlation_band("rho").alias("band"))


@query("e12_position_skew", S(f"""SELECT round(s, 6) AS slice_mean, round(a, 6) AS all_mean, round(s / a, 6) AS ratio,
    CASE WHEN s / a < 0.85 THEN 'skews_early' WHEN s / a > 1.15 THEN 'skews_late' ELSE 'no_significant_skew' END AS verdict
    FROM (SELECT avg(user_tx_count) FILTER ({_RARE}) AS s, avg(user_tx_count) AS a FROM sc WHERE label = 0)""", "sc"))
def e12(spark, sf):
    legit = scored_history(spark, sf).filter("label = 0")
    out = ev.position_skew(legit, F.col("rare_any"), "user_tx_count")
    return out.select(*[r(c).alias(c) for c in ("slice_mean", "all_mean", "ratio")], "verdict")


@query("e13_rare_fp_by_position", S(f"""SELECT CAST({_FIXED_BUCKET} AS BIGINT) AS bucket, count(*) AS n, count(*) FILTER (score_a >= 0.5) AS fp,
    round(avg(CAST(score_a >= 0.5 AS INTEGER)), 6) AS fp_rate FROM sc WHERE label = 0 AND {_RARE} GROUP BY 1""", "sc"))
def e13(spark, sf):
    df = scored_history(spark, sf).filter("label = 0 and rare_any")
    out = df.groupBy(ev.position_bucket("user_tx_count", _EDGES).alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if(F.col("score_a") >= 0.5).alias("fp"))
    return out.select(big("bucket").alias("bucket"), "n", "fp", r(F.col("fp") / F.col("n")).alias("fp_rate"))


@query("e14_position_evidence")
def e14(spark, sf):
    df = scored_history(spark, sf)
    gain = ev.uniformity(ev.bucket_average_precision(
        ev.quartile_buckets(df, "user_tx_count"), "bucket", {"a": "score_a", "b": "score_b"}), "a", "b")
    rho = spearman(df.withColumn("gain", F.col("score_b") - F.col("score_a")), {
        n: ("user_tx_count", n) for n in ("merchant_user_count", "mcc_user_count", "first_mcc", "gain")})
    proxies = rho.filter("pair <> 'gain'").agg(F.count_if(F.abs("rho") > 0.5).alias("n"))
    skew = ev.position_skew(df.filter("label = 0"), F.col("rare_any"), "user_tx_count")
    return ev.evidence(gain, proxies, rho.filter("pair = 'gain'").select("rho"), skew)


_CB = "CAST(conf >= 0.4 AS INTEGER) + CAST(conf >= 0.6 AS INTEGER) + CAST(conf >= 0.75 AS INTEGER) + CAST(conf >= 0.9 AS INTEGER)"
_CT = f"""SELECT level, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, count(*) FILTER (score_a >= 0.6 AND label = 1) AS tp,
    count(*) FILTER (score_a >= 0.6 AND label = 0) AS fp, count(*) FILTER (score_a < 0.6 AND label = 1) AS fn FROM (SELECT *, {_CB} AS level FROM cf) GROUP BY 1"""


@query("e15_confidence_buckets", S(f"""SELECT CAST(level AS BIGINT) AS level, n, positives, tp, fp, fn, round(CAST(tp AS DOUBLE) / greatest(tp + fp, 1), 6) AS "precision",
    round(CASE WHEN positives > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
    round(CAST(fp AS DOUBLE) / greatest(n - positives, 1), 6) AS fp_rate FROM ({_CT})""", "cf"))
def e15(spark, sf):
    df = confident(spark, sf).withColumn("conf", F.col("c.score"))
    out = ev.confidence_table(df, "conf", F.col("score_a") >= 0.6)
    return out.select(big("level").alias("level"), "n", "positives", "tp", "fp", "fn", *[r(c).alias(c) for c in ("precision", "recall", "fp_rate")])


@query("e15_confidence_monotone", S(f"""SELECT count(*) AS buckets, count(*) FILTER (prev > p + 0.01) AS drops, CASE WHEN count(*) < 3 THEN 'insufficient_data'
    WHEN count(*) FILTER (prev > p + 0.01) = 0 THEN 'monotonic' ELSE 'non_monotonic' END AS verdict FROM (SELECT p, lag(p) OVER (ORDER BY level) AS prev FROM
    (SELECT level, CAST(tp AS DOUBLE) / greatest(tp + fp, 1) AS p FROM ({_CT})) WHERE p > 0)""", "cf"))
def e15m(spark, sf):
    df = confident(spark, sf).withColumn("conf", F.col("c.score"))
    return ev.confidence_monotone(ev.confidence_table(df, "conf", F.col("score_a") >= 0.6))


_FM = f"""SELECT CASE {_CB} WHEN 0 THEN 'very low [0,.4)' WHEN 1 THEN 'low [.4,.6)' WHEN 2 THEN 'moderate [.6,.75)' WHEN 3 THEN 'high [.75,.9)'
    ELSE 'very high [.9,1]' END AS bucket, score_a, conf FROM cf WHERE first_mcc = 1 AND label = 0"""


@query("e16_first_mcc_buckets", S(f"""SELECT bucket, n, fp, round(100.0 * n / sum(n) OVER (), 6) AS share_pct, round(CAST(fp AS DOUBLE) / n, 6) AS fp_rate FROM
    (SELECT bucket, count(*) AS n, count(*) FILTER (score_a >= 0.6) AS fp FROM ({_FM}) GROUP BY 1)""", "cf"))
def e16(spark, sf):
    df = confident(spark, sf).withColumn("conf", F.col("c.score"))
    out = ev.first_mcc_buckets(df, "conf", F.col("score_a") >= 0.6)
    return out.select("bucket", "n", "fp", r("share_pct").alias("share_pct"), r("fp_rate").alias("fp_rate"))


@query("e16_first_mcc_verdict", S(f"""SELECT n, round(pct, 6) AS low_pct, CASE WHEN pct > 50 THEN 'correctly_low_confidence' WHEN pct > 20 THEN 'partial_coverage'
    ELSE 'insufficient_coverage' END AS verdict FROM (SELECT count(*) AS n, 100.0 * count(*) FILTER (conf < 0.6) / count(*) AS pct FROM ({_FM}))""", "cf"))
def e16v(spark, sf):
    df = confident(spark, sf).withColumn("conf", F.col("c.score"))
    return ev.first_mcc_verdict(df, "conf").select("n", r("low_pct").alias("low_pct"), "verdict")


@query("e17_router_summary", S("""SELECT blocks, step_ups, approvals, block_tp, missed, fp_rescued, misses_caught,
    round(CAST(block_tp AS DOUBLE) / greatest(blocks, 1), 6) AS block_precision, round(CAST(block_tp AS DOUBLE) / positives, 6) AS recall_block,
    round(CAST(block_tp + sp AS DOUBLE) / positives, 6) AS recall_block_step_up, round(CAST(btp AS DOUBLE) / positives, 6) AS recall_binary,
    round(CAST(sn AS DOUBLE) / negatives, 6) AS step_up_rate_negatives FROM (SELECT count(*) FILTER (decision = 'block') AS blocks,
     count(*) FILTER (decision = 'step_up') AS step_ups, count(*) FILTER (decision = 'approve') AS approvals,
     count(*) FILTER (decision = 'block' AND label = 1) AS block_tp, count(*) FILTER (decision = 'approve' AND label = 1) AS missed,
     count(*) FILTER (decision = 'step_up' AND label = 0 AND score_a >= 0.7) AS fp_rescued,
     count(*) FILTER (decision = 'step_up' AND label = 1 AND score_a < 0.7) AS misses_caught,
     count(*) FILTER (decision = 'step_up' AND label = 1) AS sp, count(*) FILTER (decision = 'step_up' AND label = 0) AS sn,
     count(*) FILTER (label = 1 AND score_a >= 0.7) AS btp, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM rt)""", "rt"))
def e17(spark, sf):
    out = ev.router_summary(routed(spark, sf), F.col("score_a") >= 0.7)
    return out.select("blocks", "step_ups", "approvals", "block_tp", "missed", "fp_rescued", "misses_caught", *[
        r(c).alias(c) for c in ("block_precision", "recall_block", "recall_block_step_up", "recall_binary", "step_up_rate_negatives")])


@query("e18_first_mcc_rerouted", S("""SELECT decision, rule, count(*) AS n FROM rt WHERE first_mcc = 1 AND label = 0 AND score_a >= 0.5 GROUP BY ALL""", "rt"))
def e18(spark, sf):
    return routed(spark, sf).filter("first_mcc = 1 and label = 0 and score_a >= 0.5D").groupBy("decision", "rule").agg(F.count("*").alias("n"))


@query("e19_review_band", S("""SELECT count(*) AS n, round(max(conf), 6) AS max_confidence, count(*) FILTER (conf >= 0.75) AS over_gate,
    round(0.35 * ((CAST(0.9497 AS DOUBLE) - CAST(0.8 AS DOUBLE)) / CAST(0.3 AS DOUBLE)) + 0.65, 6) AS ceiling,
    CAST(0.35 * ((CAST(0.9497 AS DOUBLE) - CAST(0.8 AS DOUBLE)) / CAST(0.3 AS DOUBLE)) + 0.65 >= 0.75 AS BIGINT) AS reachable FROM cf
    WHERE score_a >= 0.8 AND score_a < 0.9497""", "cf"))
def e19(spark, sf):
    df = confident(spark, sf).withColumn("conf", F.col("c.score"))
    out = ev.review_band(df, "score_a", "conf", low=0.8)
    return out.select("n", r("max_confidence").alias("max_confidence"), "over_gate", r("ceiling").alias("ceiling"), big("reachable").alias("reachable"))


@query("e20_what_if_thresholds", S("""SELECT prob_block, count(*) FILTER (d = 'block') AS blocks, count(*) FILTER (d = 'step_up') AS step_ups,
    round(CAST(count(*) FILTER (d = 'block' AND label = 1) AS DOUBLE) / nullif(count(*) FILTER (d = 'block'), 0), 6) AS "precision",
    round(CAST(count(*) FILTER (d = 'block' AND label = 1) AS DOUBLE) / count(*) FILTER (label = 1), 6) AS recall FROM
    (SELECT *, CASE WHEN user_tx_count = 0 THEN 'step_up' WHEN user_tx_count <= 8 THEN 'approve' WHEN conf < 0.6 THEN 'step_up'
      WHEN score_a >= prob_block THEN 'block' ELSE 'approve' END AS d FROM cf, (SELECT CAST(i AS DOUBLE) / 32 AS prob_block FROM range(4, 29) t(i))) GROUP BY 1""", "cf"))
def e20(spark, sf):
    df = confident(spark, sf).withColumn("conf", F.col("c.score"))
    out = ev.what_if(df, "score_a", "conf", "user_tx_count", [i / 32 for i in range(4, 29)], stepup=0.6)
    return out.select("prob_block", "blocks", "step_ups", r("precision").alias("precision"), r("recall").alias("recall"))


_CMP = f""", cmp AS (SELECT model, max(ap) AS ap, max_by(threshold, f1 - threshold * 1e-9) AS best_threshold, max(f1) AS best_f1 FROM (SELECT model, score AS threshold,
    sum(CAST(p AS DOUBLE) * tp / flagged) OVER (PARTITION BY model) / pos AS ap, {_PRF} FROM curve) GROUP BY 1)"""


@query("e21_model_comparison", head("curve") + _CMP +
       " SELECT model, round(ap, 6) AS average_precision, best_threshold, round(best_f1, 6) AS best_f1 FROM cmp")
def e21(spark, sf):
    out = ev.compare_models(_plain_long(spark, sf))
    return out.select("model", r("average_precision").alias("average_precision"), "best_threshold", r("best_f1").alias("best_f1"))


@query("e22_model_change", head("curve") + _CMP + """ SELECT round(a.ap, 6) AS before, round(b.ap, 6) AS after,
    round(b.ap - a.ap, 6) AS delta, round((b.ap - a.ap) * 100 / a.ap, 4) AS change_pct,
    CASE WHEN b.ap > a.ap THEN 'improved' WHEN b.ap < a.ap THEN 'regressed' ELSE 'unchanged' END AS verdict
    FROM cmp a, cmp b WHERE a.model = 'a' AND b.model = 'b'""")
def e22(spark, sf):
    out = ev.model_change(ev.compare_models(_plain_long(spark, sf)), "a", "b")
    return out.select(r("before").alias("before"), r("after").alias("after"), r("delta").alias("delta"), r("change_pct", 4).alias("change_pct"), "verdict")


# An additive score whose groups can be zeroed, in place of scoring a trained model again.
_PARTS = {"full": (), "no_familiarity": ("merchant_user_count", "mcc_user_count"), "no_amount": ("amount",),
          "window_only": ("merchant_user_count", "mcc_user_count", "first_mcc")}
_ADD = "round(amount / 500 + merchant_user_count / 10.0 + mcc_user_count / 50.0 + first_mcc / 4.0, 3)"


def _zeroed(cols):
    e = _ADD
    for c in cols:
        e = e.replace(c + " /", "0 /")
    return e


@query("e23_feature_ablation", head("uf") + ", v AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS variant, label, {_zeroed(c)} AS s FROM uf" for n, c in _PARTS.items()) + """),
    c AS (SELECT variant, sum(n) OVER w AS flagged, sum(p) OVER w AS tp, p FROM (SELECT variant, s, count(*) AS n, sum(label) AS p FROM v GROUP BY ALL)
     WINDOW w AS (PARTITION BY variant ORDER BY s DESC)), a AS (SELECT variant, sum(CAST(p AS DOUBLE) * tp / flagged) / sum(p) AS ap FROM c GROUP BY 1)
    SELECT variant, round(ap, 5) AS average_precision, round(ap - (SELECT ap FROM a WHERE variant = 'full'), 5) AS delta FROM a""")
def e23(spark, sf):
    df = scored_history(spark, sf)
    long = None
    for name, cols in _PARTS.items():
        part = zero_out(df, cols).select(F.lit(name).alias("model"), "label", r(
            F.col("amount") / 500 + F.col("merchant_user_count") / 10 + F.col("mcc_user_count") / 50 + F.col("first_mcc") / 4, 3).alias("score"))
        long = part if long is None else long.unionByName(part)
    table = ev.compare_models(long)
    full = table.filter("model = 'full'").select(F.col("average_precision").alias("_full"))
    return with_row(table, full).select(F.col("model").alias("variant"), r("average_precision", 5).alias("average_precision"),
                                        r(F.col("average_precision") - F.col("_full"), 5).alias("delta"))


def _router_sql(name, decision):
    return f"""SELECT '{name}' AS variant, count(*) FILTER (d = 'block') AS blocks, count(*) FILTER (d = 'block' AND label = 1) AS tp,
    round(CAST(count(*) FILTER (d = 'block' AND label = 1) AS DOUBLE) / nullif(count(*) FILTER (d = 'block'), 0), 6) AS block_precision,
    round(CAST(count(*) FILTER (d = 'block' AND label = 0 AND {_RARE}) AS DOUBLE) / nullif(count(*) FILTER (label = 0 AND {_RARE}), 0), 6) AS rare_block_rate,
    round(CAST(count(*) FILTER (d = 'block' AND label = 0 AND first_mcc = 1) AS DOUBLE) / nullif(count(*) FILTER (label = 0 AND first_mcc = 1), 0), 6) AS new_mcc_block_rate
    FROM (SELECT *, {decision} AS d FROM cf)"""


_COLD = "CASE WHEN user_tx_count = 0 THEN 'step_up' WHEN user_tx_count <= 8 THEN 'approve' "


@query("e24_routing_ablation", S("\nUNION ALL ".join(_router_sql(n, d) for n, d in {
    "binary": "CASE WHEN score_a >= 0.7 THEN 'block' ELSE 'approve' END",
    "no_confidence": _COLD + "WHEN score_a >= 0.7 THEN 'block' ELSE 'approve' END",
    "full": _COLD + "WHEN conf < 0.6 THEN 'step_up' WHEN score_a >= 0.7 THEN 'block' ELSE 'approve' END"}.items()), "cf"))
def e24(spark, sf):
    conf, pos = F.col("c.score"), "user_tx_count"
    variants = {
        "binary": F.when(F.col("score_a") >= 0.7, "block").otherwise("approve"),
        "no_confidence": decide.route("score_a", conf, pos, prob_block=0.7, conf_stepup=0.0)["decision"],
        "full": decide.route("score_a", conf, pos, prob_block=0.7, conf_stepup=0.6)["decision"],
    }
    out = ev.routing_ablation(confident(spark, sf), variants, F.col("rare_any"), F.col("new_mcc"))
    return out.select("variant", "blocks", "tp", *[r(c).alias(c) for c in ("block_precision", "rare_block_rate", "new_mcc_block_rate")])


@query("e25_validation_gate", head("curve") + _CMP + """, f AS (SELECT model, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM
    (SELECT model, count(*) FILTER (score >= 0.6 AND label = 1) AS tp, count(*) FILTER (score >= 0.6 AND label = 0) AS fp,
     count(*) FILTER (score < 0.6 AND label = 1) AS fn FROM long GROUP BY 1))
    SELECT round(b.ap - a.ap, 6) AS ap_change, round(fb.f1 - fa.f1, 6) AS f1_change,
    CASE WHEN a.ap - b.ap > 0.005 OR fa.f1 - fb.f1 > 0.01 THEN 'reject' ELSE 'promote' END AS decision
    FROM cmp a, cmp b, f fa, f fb WHERE a.model = 'a' AND b.model = 'b' AND fa.model = 'a' AND fb.model = 'b'""")
def e25(spark, sf):
    long = _plain_long(spark, sf)
    ap, at = ev.compare_models(long).select("model", "average_precision"), mt.metrics_at(long, 0.6, groups=["model"]).select("model", "f1")
    both = ap.join(at, "model")
    out = ev.gate(both.filter("model = 'a'"), both.filter("model = 'b'"))
    return out.select(r("ap_change").alias("ap_change"), r("f1_change").alias("f1_change"), "decision")


@query("e26_fusion_check", head("sc") + """, v AS (SELECT label, m, s FROM sc, LATERAL (SELECT unnest(['a', 'b', 'fused']) AS m,
     unnest([score_a, score_b, round(0.9 * score_a + 0.1 * score_b, 6)]) AS s)), c AS (SELECT m, sum(n) OVER w AS flagged, sum(p) OVER w AS tp, p FROM
    (SELECT m, s, count(*) AS n, sum(label) AS p FROM v GROUP BY ALL) WINDOW w AS (PARTITION BY m ORDER BY s DESC)),
    t AS (SELECT m, sum(CAST(p AS DOUBLE) * tp / flagged) / sum(p) AS ap FROM c GROUP BY 1)
    SELECT m AS model, round(ap, 6) AS average_precision, CAST((SELECT ap FROM t WHERE m = 'fused') <= (SELECT ap FROM t WHERE m = 'a') AS BIGINT) AS null_result FROM t""")
def e26(spark, sf):
    df = scored(tx_events(spark, sf)).withColumn("fused", r(decide.fuse("score_a", "score_b")))
    table = ev.compare_models(model_long(df, {"a": "score_a", "b": "score_b", "fused": "fused"}))
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("average_precision")))
    flag = table.agg((pick("fused") <= pick("a")).cast("bigint").alias("null_result"))
    return with_row(table, flag).select("model", r("average_precision").alias("average_precision"), "null_result")


# Attempts on the same row: one deterministic and two weaker ones, with a closed-form outcome.
_ATT = """att AS (SELECT tx_id AS row_id, attempt, score_a AS score_before, score_a - (merchant % (5 + attempt)) / 40.0 AS score_after,
    amount AS amount_before, amount * (1 - (merchant % (5 + attempt)) / 40.0) AS amount_after, CAST(merchant AS DOUBLE) AS merchant_before,
    CAST(merchant + attempt AS DOUBLE) AS merchant_after FROM sc, range(0, 3) t(attempt))"""


def _attempts(spark, sf):
    df = scored(tx_events(spark, sf)).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(2))))
    cut_by = (F.col("merchant") % (5 + F.col("attempt"))) / 40.0
    return df.select(
        F.col("tx_id").alias("row_id"), "attempt", F.col("score_a").alias("score_before"), (F.col("score_a") - cut_by).alias("score_after"),
        F.col("amount").alias("amount_before"), (F.col("amount") * (1 - cut_by)).alias("amount_after"),
        F.col("merchant").cast("double").alias("merchant_before"), (F.col("merchant") + F.col("attempt")).cast("double").alias("merchant_after"))


@query("e27_evasion_report", head("sc") + ", " + _ATT + """ SELECT count(*) AS catchable, CAST(sum(d) AS BIGINT) AS evaded_det,
    CAST(sum(e) AS BIGINT) AS evaded_any, round(avg(d), 6) AS rate_det, round(avg(e), 6) AS rate_any FROM (SELECT row_id,
     max(CAST(attempt = 0 AND score_after < 0.6 AS INTEGER)) AS d, max(CAST(score_after < 0.6 AS INTEGER)) AS e FROM att WHERE score_before >= 0.6 GROUP BY 1)""")
def e27(spark, sf):
    out = ev.evasion_report(_attempts(spark, sf), 0.6)
    return out.select("catchable", "evaded_det", "evaded_any", r("rate_det").alias("rate_det"), r("rate_any").alias("rate_any"))


@query("e28_perturbation_profile", head("sc") + ", " + _ATT + "\nUNION ALL ".join(
    f""" SELECT '{f}' AS feature, round(avg(abs({f}_after - {f}_before)) / stddev_pop({f}_before), 6) AS shift, count(*) FILTER ({f}_after <> {f}_before) AS changed FROM att"""
    for f in ("amount", "merchant")))
def e28(spark, sf):
    out = ev.perturbation_profile(_attempts(spark, sf), ("amount", "merchant"))
    return out.select("feature", r("shift").alias("shift"), "changed")


@query("e28_score_drop", head("sc") + ", " + _ATT + """ SELECT round(avg(score_before - score_after), 6) AS mean_drop,
    round(max(score_before - score_after), 6) AS max_drop, round(stddev_samp(score_before - score_after), 6) AS std_drop FROM att""")
def e28d(spark, sf):
    return ev.score_drop(_attempts(spark, sf)).select(*[r(c).alias(c) for c in ("mean_drop", "max_drop", "std_drop")])


@query("e29_robustness_verdict", head("sc") + ", " + _ATT + """ SELECT round(x, 6) AS rate_any,
    CASE WHEN x < 0.1 THEN 'structural' WHEN x > 0.5 THEN 'overfit' ELSE 'partial' END AS verdict FROM (SELECT avg(e) AS x FROM
    (SELECT row_id, max(CAST(score_after < 0.6 AS INTEGER)) AS e FROM att WHERE score_before >= 0.6 GROUP BY 1))""")
def e29(spark, sf):
    return ev.robustness_verdict(ev.evasion_report(_attempts(spark, sf), 0.6)).select(r("rate_any").alias("rate_any"), "verdict")


_SYN = """syn AS (SELECT 'real' AS source, amount, CAST(merchant AS DOUBLE) AS merchant FROM tx WHERE label = 1
    UNION ALL SELECT 'synthetic', amount * 1.2 - 3, CAST(99 - merchant AS DOUBLE) FROM tx WHERE label = 0)"""


def _both(spark, sf):
    df = tx_events(spark, sf)
    real = df.filter("label = 1").select(F.lit("real").alias("source"), "amount", F.col("merchant").cast("double").alias("merchant"))
    fake = df.filter("label = 0").select(F.lit("synthetic").alias("source"), (F.col("amount") * 1.2 - 3).alias("amount"),
                                         (99 - F.col("merchant")).cast("double").alias("merchant"))
    return real.unionByName(fake)


@query("e30_fidelity", head("tx") + ", " + _SYN + "\nUNION ALL ".join(f""" SELECT '{c}' AS feature,
    round(avg({c}) FILTER (source = 'real'), 5) AS mean_r, round(avg({c}) FILTER (source = 'synthetic'), 5) AS mean_s,
    round(stddev_samp({c}) FILTER (source = 'real'), 5) AS std_r, round(stddev_samp({c}) FILTER (source = 'synthetic'), 5) AS std_s,
    count(*) FILTER (source = 'synthetic' AND {c} < (SELECT min({c}) FROM syn WHERE source = 'real')) AS below,
    count(*) FILTER (source = 'synthetic' AND {c} > (SELECT max({c}) FROM syn WHERE source = 'real')) AS above FROM syn""" for c in ("amount", "merchant")))
def e30(spark, sf):
    out = ev.fidelity(_both(spark, sf), ("amount", "merchant"))
    return out.select("feature", *[r(c, 5).alias(c) for c in ("mean_r", "mean_s", "std_r", "std_s")], "below", "above")


@query("e30_correlation_deltas", head("tx") + ", " + _SYN + """ SELECT 'amount_merchant' AS pair, round(a, 6) AS r, round(b, 6) AS s,
    round(abs(b - a), 6) AS delta FROM (SELECT corr(amount, merchant) FILTER (source = 'real') AS a, corr(amount, merchant) FILTER (source = 'synthetic') AS b FROM syn)""")
def e30c(spark, sf):
    out = ev.correlation_deltas(_both(spark, sf), {"amount_merchant": ("amount", "merchant")})
    return out.select("pair", r("r").alias("r"), r("s").alias("s"), r("delta").alias("delta"))


@query("e31_banks_helped", head("txo") + """, v AS (SELECT CAST(floor((dense_rank() OVER (ORDER BY "user") - 1) / 150) AS BIGINT) AS bank, label,
     round(amount / 500000, 3) AS sa, round(((merchant * 37) % 25) / 25.0, 3) AS sb FROM txo), l AS (SELECT bank, label, 'a' AS m, sa AS s FROM v UNION ALL SELECT bank, label, 'b', sb FROM v),
    c AS (SELECT bank, m, sum(n) OVER w AS flagged, sum(p) OVER w AS tp, p FROM (SELECT bank, m, s, count(*) AS n, sum(label) AS p FROM l GROUP BY ALL)
     WINDOW w AS (PARTITION BY bank, m ORDER BY s DESC)), t AS (SELECT bank, m, sum(CAST(p AS DOUBLE) * tp / flagged) / sum(p) AS ap FROM c GROUP BY ALL)
    SELECT a.bank, round(a.ap, 6) AS ap_base, round(b.ap, 6) AS ap_other, CAST(b.ap > a.ap AS BIGINT) AS helped FROM t a JOIN t b ON a.bank = b.bank AND a.m = 'a' AND b.m = 'b'""")
def e31(spark, sf):
    df = banks(tx_orders(spark, sf)).withColumns({
        "score_a": r(F.col("amount") / 500000, 3), "score_b": r(F.col("merchant") * 37 % 25 / 25, 3)})
    out = ev.segments_helped(model_long(df.select("bank", "label", "score_a", "score_b")), "bank", "a", "b")
    return out.select("bank", r("ap_base").alias("ap_base"), r("ap_other").alias("ap_other"), big("helped").alias("helped"))
