"""Drift and calibration (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txflow.catalog.base import big, history, model_long, r, raw_events, scored, scored_history, tx_events
from txflow.catalog.registry import query
from txflow.catalog.sql import S, head
from txflow.operators import calibration as cal
from txflow.operators import drift
from txflow.operators.joining import with_row
from txflow.plans import flows
from txflow.schema import slot_names
from txflow.session import cut

# Reference: the first 60 % of the ids; monitored: the rest, with the amount moved and more values missing.
_FEATURES = ("amount", "merchant", "hour", "label", "constant", "zscore", "ref_missing")

_SIDES = """w AS (SELECT uf.*, CASE WHEN tx_id < (SELECT 0.6 * max(tx_id) FROM uf) THEN 'ref' ELSE 'mon' END AS side FROM uf),
 l AS (SELECT side, 'amount' AS feature, CASE side WHEN 'ref' THEN amount ELSE amount * 1.25 END AS value FROM w
  UNION ALL SELECT side, 'merchant', CAST(merchant AS DOUBLE) FROM w UNION ALL SELECT side, 'hour', CAST(hour(ts) AS DOUBLE) FROM w
  UNION ALL SELECT side, 'label', CAST(label AS DOUBLE) FROM w
  UNION ALL SELECT side, 'constant', CASE WHEN side = 'mon' AND merchant = 3 THEN 2.0 ELSE 1.0 END FROM w
  UNION ALL SELECT side, 'zscore', CASE WHEN side = 'mon' AND merchant % 4 = 0 THEN NULL ELSE round(user_amount_zscore, 6) END FROM w
  UNION ALL SELECT side, 'ref_missing', CASE WHEN side = 'mon' AND merchant % 2 = 0 THEN 5.0 END FROM w),
 st AS (SELECT feature, count(*) FILTER (side = 'ref') AS rn, count(*) FILTER (side = 'mon') AS mn,
  count(*) FILTER (side = 'ref' AND value IS NULL) AS rnull, count(*) FILTER (side = 'mon' AND value IS NULL) AS mnull,
  count(DISTINCT value) FILTER (side = 'ref') AS u, min(value) FILTER (side = 'ref') AS lo, max(value) FILTER (side = 'ref') AS hi FROM l GROUP BY 1),
 ed AS (SELECT DISTINCT feature, e FROM (SELECT feature, unnest(quantile_cont(value, [CAST(0 AS DOUBLE), 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e
  FROM l WHERE side = 'ref' AND value IS NOT NULL GROUP BY 1)),
 inn AS (SELECT feature, e FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY e) AS i, count(*) OVER (PARTITION BY feature) AS k FROM ed) WHERE i > 1 AND i < k),
 b AS (SELECT l.feature, side, CASE WHEN value IS NULL THEN -1 WHEN u = 0 THEN 0 WHEN u = 1 THEN CASE WHEN abs(value - lo) <= 1e-8 + 1e-5 * abs(lo) THEN 0 ELSE 1 END
  WHEN u = 2 THEN CASE WHEN value <= (lo + hi) / 2 THEN 0 ELSE 1 END ELSE (SELECT count(*) FROM inn WHERE inn.feature = l.feature AND inn.e <= value) END AS bin
  FROM l JOIN st ON st.feature = l.feature),
 sh AS (SELECT b.feature, bin, greatest(CAST(count(*) FILTER (side = 'ref') AS DOUBLE) / max(rn), 1e-4) AS rs,
  greatest(CAST(count(*) FILTER (side = 'mon') AS DOUBLE) / max(mn), 1e-4) AS ms FROM b JOIN st ON st.feature = b.feature GROUP BY ALL),
 psi AS (SELECT sh.feature, sum((ms - rs) * ln(ms / rs)) AS psi FROM sh GROUP BY 1)"""
_CATEGORY = "CASE WHEN psi >= 0.25 THEN 'retrain' WHEN psi >= 0.1 THEN 'watch' ELSE 'stable' END"


def _d(body):
    return head("uf") + ", " + _SIDES + body


def _psi(spark, sf):
    df = history(spark, sf).select("tx_id", "ts", "amount", "merchant", "label", "user_amount_zscore")
    edge = df.agg((0.6 * F.max("tx_id")).alias("_edge"))
    k = F.col("merchant")
    df = with_row(df, edge).withColumn("side", F.when(F.col("tx_id") < F.col("_edge"), "ref").otherwise("mon"))
    mon = F.col("side") == "mon"
    df = df.withColumns({
        "amount": F.when(mon, F.col("amount") * 1.25).otherwise(F.col("amount")), "hour": F.hour("ts"),
        "constant": F.when(mon & (k == 3), 2.0).otherwise(1.0),
        "zscore": F.when(~(mon & (k % 4 == 0)), r("user_amount_zscore")),
        "ref_missing": F.when(mon & (k % 2 == 0), 5.0),
    })
    df = cut(df)  # either side is a filter of it
    return drift.psi_between(df.filter("side = 'ref'"), df.filter("side = 'mon'"), _FEATURES)


@query("d01_psi", _d(f""" SELECT psi.feature, round(psi, 6) AS psi, {_CATEGORY} AS category, CASE WHEN u = 0 THEN 'all_missing_in_reference' WHEN u = 1 THEN 'constant'
    WHEN u = 2 THEN 'binary' ELSE 'continuous' END AS feature_type, CAST(CASE WHEN u = 0 THEN 2 WHEN u <= 2 THEN 2 + CAST(rnull + mnull > 0 AS INTEGER)
    ELSE (SELECT count(*) FROM inn WHERE inn.feature = psi.feature) + 1 + CAST(rnull + mnull > 0 AS INTEGER) END AS BIGINT) AS n_bins_used,
    round(CAST(rnull AS DOUBLE) / rn, 6) AS ref_null_rate, round(CAST(mnull AS DOUBLE) / mn, 6) AS mon_null_rate FROM psi JOIN st ON st.feature = psi.feature"""))
def d01(spark, sf):
    out = _psi(spark, sf)
    return out.select("feature", r("psi").alias("psi"), "category", "feature_type", big("n_bins_used").alias("n_bins_used"),
                      r("ref_null_rate").alias("ref_null_rate"), r("mon_null_rate").alias("mon_null_rate"))


@query("d02_psi_categories", _d(f" SELECT {_CATEGORY} AS category, count(*) AS n FROM psi GROUP BY 1"))
def d02(spark, sf):
    return drift.category_counts(_psi(spark, sf))


@query("d02_top_drift", _d(" SELECT feature, round(psi, 6) AS psi FROM psi ORDER BY psi DESC, feature LIMIT 3"))
def d02t(spark, sf):
    return drift.top_drift(_psi(spark, sf), 3).select("feature", r("psi").alias("psi"))


@query("d03_should_retrain", _d(""" SELECT CAST(max(psi) >= 0.25 OR avg(CAST(psi >= 0.1 AS INTEGER)) > 0.2 AS BIGINT) AS retrain,
    count(*) FILTER (psi >= 0.1) AS watching, count(*) AS total, 'feature ' || max_by(feature, psi) || ' has PSI ' || format('{:.4f}', max(psi)) || ', at or above 0.25' AS reason FROM psi"""))
def d03(spark, sf):
    return drift.should_retrain(_psi(spark, sf)).select(big("retrain").alias("retrain"), "watching", "total", "reason")


@query("d01_psi_model_input")
def d01m(spark, sf):
    """All 243 inputs of the model: training rows against later ones."""
    rows = cut(flows.packed_slots(raw_events(spark, sf)).select(F.col("x").alias("_x"), (F.col("split") == "train").alias("_ref")), wide=True)
    out = drift.psi_of_packed(rows, slot_names())
    return out.select("feature", r("psi").alias("psi"), "category", "feature_type", big("n_bins_used").alias("n_bins_used"))


@query("d04_brier", S("""SELECT model, round(bs, 6) AS brier, round(p * (1 - p), 6) AS baseline, round(1 - bs / (p * (1 - p)), 6) AS skill FROM
    (SELECT model, avg((score - label) * (score - label)) AS bs, avg(label) AS p FROM long GROUP BY 1)""", "long"))
def d04(spark, sf):
    out = cal.brier(model_long(scored(tx_events(spark, sf))), "score", "label", "model")
    return out.select("model", r("brier").alias("brier"), r("baseline").alias("baseline"), r("skill").alias("skill"))


_DEC = """q AS (SELECT DISTINCT unnest(quantile_cont({v}, [CAST(0 AS DOUBLE), 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e FROM sc WHERE {v} IS NOT NULL),
    qi AS (SELECT e FROM q WHERE e > (SELECT min(e) FROM q) AND e < (SELECT max(e) FROM q)),
    db AS (SELECT *, (SELECT count(*) FROM qi WHERE qi.e < {v}) AS bin FROM sc WHERE {v} IS NOT NULL)"""


@query("d05_reliability_deciles", head("sc") + ", " + _DEC.format(v="score_a") + """ SELECT bin, count(*) AS n,
    CAST(sum(label) AS BIGINT) AS positives, round(avg(score_a), 6) AS mean_predicted, round(avg(label), 6) AS observed FROM db GROUP BY 1""")
def d05(spark, sf):
    out = cal.reliability_deciles(scored(tx_events(spark, sf)), "score_a")
    return out.select(big("bin").alias("bin"), "n", "positives", r("mean_predicted").alias("mean_predicted"), r("observed").alias("observed"))


_FIX = "SELECT " + " + ".join(f"CAST(score_a >= {e!r} AS INTEGER)" for e in cal.FIXED_EDGES[1:-1]) + " AS bin, score_a, label FROM sc"


@query("d06_reliability_fixed", S(f"""SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives,
    round(avg(score_a), 6) AS mean_predicted, round(avg(label), 6) AS observed FROM ({_FIX}) GROUP BY 1""", "sc"))
def d06(spark, sf):
    out = cal.reliability_fixed(scored(tx_events(spark, sf)), "score_a")
    return out.select(big("bin").alias("bin"), "n", "positives", r("mean_predicted").alias("mean_predicted"), r("observed").alias("observed"))


_BINS = f"SELECT bin, count(*) AS n, avg(score_a) AS p, avg(label) AS o FROM ({_FIX}) GROUP BY 1"


@query("d07_ece", S(f"SELECT round(sum(n * abs(o - p)) / sum(n), 6) AS ece FROM ({_BINS})", "sc"))
def d07(spark, sf):
    return cal.ece(cal.reliability_fixed(scored(tx_events(spark, sf)), "score_a")).select(r("ece").alias("ece"))


@query("d08_calibration_verdict", S(f"""SELECT round(ece, 6) AS ece, dir AS direction, CASE WHEN ece > 0.01 OR dir <> 'approximately calibrated' THEN 'poor' ELSE 'reasonable' END AS verdict
    FROM (SELECT sum(n * abs(o - p)) / sum(n) AS ece, CASE WHEN max_by(p, bin) > max_by(o, bin) + 0.01 THEN 'overconfident'
     WHEN max_by(p, bin) < max_by(o, bin) - 0.01 THEN 'underconfident' ELSE 'approximately calibrated' END AS dir FROM ({_BINS}))""", "sc"))
def d08(spark, sf):
    out = cal.calibration_verdict(cal.reliability_fixed(scored(tx_events(spark, sf)), "score_a"))
    return out.select(r("ece").alias("ece"), "direction", "verdict")


@query("d09_recalibration")
def d09(spark, sf):
    return cal.recalibration(scored(tx_events(spark, sf)), "score_a")


# The response of the closed-form score to the z-score: rises, then dips past 1.5.
_GRID = """g AS (SELECT lo + i * (hi - lo) / 40 AS z, i FROM (SELECT quantile_cont(user_amount_zscore, CAST(0.005 AS DOUBLE)) AS lo,
    quantile_cont(user_amount_zscore, CAST(0.995 AS DOUBLE)) AS hi FROM sc), range(0, 41) t(i)),
    cv AS (SELECT tx_id, i, z, 0.5 * score_b + z / 20 - greatest(z - 1.5, 0) * merchant / 500 AS s FROM sc, g),
    df AS (SELECT *, s - lag(s) OVER (PARTITION BY tx_id ORDER BY i) AS d, greatest(1e-4, 0.01 * (max(s) OVER (PARTITION BY tx_id) - min(s) OVER (PARTITION BY tx_id))) AS tol FROM cv)"""


def _curves(spark, sf):
    df = scored_history(spark, sf).select("tx_id", "score_b", "merchant", "user_amount_zscore")
    grid = cal.response_grid(df, "user_amount_zscore")
    return cal.response_curves(df, grid, lambda z: (
        0.5 * F.col("score_b") + z / 20 - F.greatest(z - 1.5, F.lit(0.0)) * F.col("merchant") / 500))


@query("d10_response_monotonicity", head("sc") + ", " + _GRID + """ SELECT count(*) AS n,
    round(100 * avg(CAST(v = 0 AS INTEGER)), 6) AS monotone_pct, round(100 * avg(CAST(st = 0 AS INTEGER)), 6) AS strict_pct, round(avg(v), 6) AS mean_violations,
    round(avg(w), 6) AS mean_worst_drop, CASE WHEN 100 * avg(CAST(v = 0 AS INTEGER)) < 90 THEN 'material' WHEN 100 * avg(CAST(v = 0 AS INTEGER)) < 99 THEN 'minor' ELSE 'none' END AS severity
    FROM (SELECT tx_id, count(*) FILTER (d < -tol) AS v, count(*) FILTER (d < -1e-9) AS st, greatest(-min(d), 0) AS w FROM df GROUP BY 1)""")
def d10(spark, sf):
    out = cal.monotone_summary(cal.monotone_rows(_curves(spark, sf)))
    return out.select("n", r("monotone_pct").alias("monotone_pct"), r("strict_pct").alias("strict_pct"), r("mean_violations").alias("mean_violations"),
                      r("mean_worst_drop").alias("mean_worst_drop"), "severity")


@query("d10_mean_response", head("sc") + ", " + _GRID + """ SELECT CAST(i AS BIGINT) AS step, round(max(z), 6) AS value,
    round(avg(s), 6) AS mean_score FROM cv GROUP BY 1""")
def d10m(spark, sf):
    return cal.mean_curve(_curves(spark, sf)).select(big("step").alias("step"), r("value").alias("value"), r("mean_score").alias("mean_score"))


_TREND = head("sc") + ", " + _DEC.format(v="user_amount_zscore") + """, tr AS (SELECT bin, count(*) AS n,
    avg(user_amount_zscore) AS z, avg(score_b) AS p, avg(label) AS o FROM db GROUP BY 1)"""


@query("d11_feature_trend", _TREND + " SELECT bin, n, round(z, 6) AS mean_value, round(p, 6) AS mean_predicted, round(o, 6) AS observed FROM tr")
def d11(spark, sf):
    out = cal.decile_trend(scored_history(spark, sf), "user_amount_zscore", "score_b")
    return out.select(big("bin").alias("bin"), "n", r("mean_value").alias("mean_value"), r("mean_predicted").alias("mean_predicted"), r("observed").alias("observed"))


@query("d11_trend_correlation", _TREND + """ SELECT 'predicted' AS pair, round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY z) AS a, rank() OVER (ORDER BY p) AS b FROM tr)
    UNION ALL SELECT 'observed', round(corr(a, b), 6) FROM (SELECT rank() OVER (ORDER BY z) AS a, rank() OVER (ORDER BY o) + (count(*) OVER (PARTITION BY o) - 1) / 2.0 AS b FROM tr)""")
def d11c(spark, sf):
    trend = cal.decile_trend(scored_history(spark, sf), "user_amount_zscore", "score_b")
    return cal.trend_correlation(trend).select("pair", r("rho").alias("rho"))
