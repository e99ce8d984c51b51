"""Aggregate reports (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txflow.catalog.base import big, confident, history, r, routed, rt, scored, tx_events, tx_orders
from txflow.catalog.registry import query
from txflow.catalog.sql import S
from txflow.functions.decide import rare_slices
from txflow.operators import evaluate, learning, reports
from txflow.operators.features import amount_history, daily_volume, user_features
from txflow.operators.graph import expected_positive_users
from txflow.operators.ordered import percentiles
from txflow.operators.split import banks, chrono_split
from txflow.schema import FLAG_COLUMNS


def _median(col, p):
    return f"round(quantile_cont(CAST({col} AS DOUBLE), CAST({p} AS DOUBLE)), 6)"


@query("a01_label_balance", S("""SELECT mcc, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate
    FROM txo GROUP BY 1""", "txo"))
def a01(spark, sf):
    return reports.label_balance(tx_orders(spark, sf), "mcc").select("mcc", "n", "positives", r("rate").alias("rate"))


@query("a02_rows_per_day", S("SELECT CAST(ts::DATE AS VARCHAR) AS day, count(*) AS n FROM tx GROUP BY 1", "tx"))
def a02(spark, sf):
    return daily_volume(tx_events(spark, sf)).select(F.col("day").cast("string").alias("day"), "n")


@query("a03_monthly_mean", S("""SELECT "user", year(ts) AS year, month(ts) AS month, count(*) AS n, round(sum(amount), 2) AS total,
    round(avg(amount) + 1e-9, 4) AS mean FROM txo GROUP BY ALL""", "txo"))
def a03(spark, sf):
    out = reports.monthly_means(tx_orders(spark, sf))
    return out.select("user", big("year").alias("year"), big("month").alias("month"), "n", r("total", 2).alias("total"), rt("mean", 4).alias("mean"))


@query("a04_entity_stats", S("""SELECT merchant, count(*) AS tx_count, CAST(sum(label) AS BIGINT) AS fraud_count, round(avg(label) + 1e-9, 6) AS fraud_rate,
    round(avg(amount) + 1e-9, 6) AS mean_amount, round(coalesce(stddev_samp(amount), 0), 6) AS std_amount FROM tx GROUP BY 1""", "tx"))
def a04(spark, sf):
    return reports.entity_stats(tx_events(spark, sf), "merchant").select(
        "merchant", "tx_count", "fraud_count", rt("fraud_rate").alias("fraud_rate"), rt("mean_amount").alias("mean_amount"),
        r("std_amount").alias("std_amount"))


@query("a05_distinct_users", S("""SELECT merchant, count(DISTINCT "user") AS users,
    count(DISTINCT CASE WHEN label = 1 THEN "user" END) AS positive_users FROM tx GROUP BY 1""", "tx"))
def a05(spark, sf):
    return tx_events(spark, sf).groupBy("merchant").agg(
        F.count_distinct("user").alias("users"), F.count_distinct(F.when(F.col("label") == 1, F.col("user"))).alias("positive_users"))


@query("a06_two_level_expectation", S("""SELECT merchant, round(sum(1 - pow(1 - rate, n)), 6) AS expected FROM
    (SELECT merchant, "user", count(*) AS n FROM tx GROUP BY ALL), (SELECT avg(label) AS rate FROM tx) GROUP BY 1""", "tx"))
def a06(spark, sf):
    return expected_positive_users(tx_events(spark, sf)).select("merchant", r("expected").alias("expected"))


@query("a07_flag_lift", S("\nUNION ALL ".join(f"""SELECT '{f}' AS flag, count(*) FILTER ({f} = 1) AS fires,
    round(100.0 * count(*) FILTER ({f} = 1) / count(*), 6) AS fire_pct, count(*) FILTER ({f} = 1 AND label = 1) AS positives,
    round(CAST(count(*) FILTER ({f} = 1 AND label = 1) AS DOUBLE) / nullif(count(*) FILTER ({f} = 1), 0), 6) AS "precision",
    round(CAST(count(*) FILTER ({f} = 1 AND label = 1) AS DOUBLE) / nullif(count(*) FILTER ({f} = 1), 0) / avg(label), 6) AS lift,
    round(CAST(count(*) FILTER ({f} = 1 AND label = 1) AS DOUBLE) / sum(label), 6) AS coverage, count(*) FILTER ({f} IS NULL) AS nulls FROM ufo"""
    for f in FLAG_COLUMNS), "ufo"))
def a07(spark, sf):
    out = reports.flag_lift(user_features(tx_orders(spark, sf)), FLAG_COLUMNS)
    return out.select("flag", "fires", "positives", "nulls", *[r(c).alias(c) for c in ("fire_pct", "precision", "lift", "coverage")])


_SUMMARY = ("user_hist_mean", "user_amount_zscore", "merchant_user_count", "days_since_last_tx")


@query("a08_column_summary", S("\nUNION ALL ".join(f"""SELECT '{c}' AS feature, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std,
    round(CAST(min({c}) AS DOUBLE), 5) AS min, round(CAST(max({c}) AS DOUBLE), 5) AS max, count(*) FILTER ({c} IS NULL) AS nulls,
    round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6) AS null_pct FROM uf""" for c in _SUMMARY), "uf"))
def a08(spark, sf):
    out = reports.column_summary(history(spark, sf), _SUMMARY)
    return out.select("feature", *[r(c, 5).alias(c) for c in ("mean", "std", "min", "max")], "nulls", r("null_pct").alias("null_pct"))


@query("a09_segment_table", S("""SELECT CASE WHEN rn <= floor(c * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split,
    CASE WHEN rn = 1 THEN 'step_up' WHEN rn <= 9 THEN 'cold_start' ELSE 'main_model' END AS segment, count(*) AS n,
    CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate FROM (SELECT *,
     row_number() OVER (PARTITION BY "user" ORDER BY ts, tx_id) AS rn, count(*) OVER (PARTITION BY "user") AS c FROM txo) GROUP BY ALL""", "txo"))
def a09(spark, sf):
    df = chrono_split(amount_history(tx_orders(spark, sf)))
    return reports.segment_table(df).select("split", "segment", "n", "positives", r("rate").alias("rate"))


@query("a10_depth_buckets", S("""SELECT lo || coalesce('-' || hi, '+') AS bucket, count(n) AS n, CAST(coalesce(sum(label), 0) AS BIGINT) AS positives,
    round(coalesce(avg(label), 0), 6) AS rate FROM (VALUES (0,9),(10,49),(50,99),(100,199),(200,499),(500,999),(1000,NULL)) b(lo, hi)
    LEFT JOIN (SELECT label, row_number() OVER (PARTITION BY "user" ORDER BY ts, tx_id) - 1 AS n FROM tx) ON n BETWEEN lo AND coalesce(hi, n) GROUP BY ALL""", "tx"))
def a10(spark, sf):
    out = reports.depth_table(amount_history(tx_events(spark, sf)))
    return out.select("bucket", big("n").alias("n"), big("positives").alias("positives"), r("rate").alias("rate"))


@query("a11_earliest_positive", S(f"""SELECT {_median('p', 0)} AS earliest, {_median('p', 0.25)} AS p25, {_median('p', 0.5)} AS median,
    {_median('p', 0.75)} AS p75, count(*) AS users_with_positives FROM (SELECT "user", min(n) AS p FROM
     (SELECT "user", label, row_number() OVER (PARTITION BY "user" ORDER BY ts, tx_id) - 1 AS n FROM txo) WHERE label = 1 GROUP BY 1)""", "txo"))
def a11(spark, sf):
    out = reports.earliest_positive(amount_history(tx_orders(spark, sf)))
    return out.select(*[r(c).alias(c) for c in ("earliest", "p25", "median", "p75")], "users_with_positives")


_CS, _MM = "user_tx_count BETWEEN 1 AND 8", "user_tx_count >= 9"


@query("a12_segment_contrast", S("\nUNION ALL ".join(f"""SELECT '{f}' AS feature, round(avg(CASE WHEN {_CS} THEN {f} END), 6) AS rate_a,
    round(avg(CASE WHEN {_MM} THEN {f} END), 6) AS rate_b,
    round(avg(CASE WHEN {_CS} THEN {f} END) / greatest(avg(CASE WHEN {_MM} THEN {f} END), 1e-9), 4) AS ratio,
    round(100.0 * count(*) FILTER ({_CS} AND {f} IS NULL) / count(*) FILTER ({_CS}), 6) AS null_pct_a FROM uf"""
    for f in ("first_mcc", "first_city_state", "first_channel", "is_largest_ever", "is_dormant")), "uf"))
def a12(spark, sf):
    n = F.col("user_tx_count")
    out = reports.segment_contrast(
        history(spark, sf), ("first_mcc", "first_city_state", "first_channel", "is_largest_ever", "is_dormant"),
        (n >= 1) & (n <= 8), n >= 9)
    return out.select("feature", r("rate_a").alias("rate_a"), r("rate_b").alias("rate_b"), r("ratio", 4).alias("ratio"), r("null_pct_a").alias("null_pct_a"))


_SLICES = {"amount_unusual": "amount_unusual", "new_mcc": "first_mcc = 1", "new_location": "first_city_state = 1",
           "rare_any": "(amount_unusual OR first_mcc = 1 OR first_city_state = 1)",
           "ordinary": "NOT (amount_unusual OR first_mcc = 1 OR first_city_state = 1)"}


@query("a13_slice_confusion", S("\nUNION ALL ".join(f"""SELECT '{s}' AS slice, count(*) AS n, count(*) FILTER (score_a >= 0.6 AND label = 1) AS tp,
    count(*) FILTER (score_a >= 0.6 AND label = 0) AS fp, count(*) FILTER (score_a < 0.6 AND label = 1) AS fn,
    count(*) FILTER (score_a < 0.6 AND label = 0) AS tn,
    round(CAST(count(*) FILTER (score_a >= 0.6 AND label = 0) AS DOUBLE) / nullif(count(*) FILTER (label = 0), 0), 6) AS fp_rate
    FROM sc WHERE {w}""" for s, w in _SLICES.items()), "sc"))
def a13(spark, sf):
    df = scored(history(spark, sf))
    out = reports.slice_confusion(df, rare_slices(), F.col("score_a") >= 0.6)
    return out.select("slice", "n", "tp", "fp", "fn", "tn", r("fp_rate").alias("fp_rate"))


@query("a14_percentiles_by_slice", S("SELECT mcc AS slice, " + ", ".join(
    f"{_median('user_tx_count', p / 100)} AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM uf GROUP BY 1", "uf"))
def a14(spark, sf):
    df = amount_history(tx_events(spark, sf))
    out = percentiles(df, "user_tx_count", [0.1, 0.25, 0.5, 0.75, 0.9], ["mcc"])
    return out.select(F.col("mcc").alias("slice"), *[r(F.col("pcts")[i]).alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))])


@query("a14_amount_percentiles", S("SELECT " + ", ".join(f"{_median('amount', p / 100)} AS p{p}" for p in (1, 25, 50, 75, 99)) + " FROM txo", "txo"))
def a14a(spark, sf):
    out = percentiles(tx_orders(spark, sf), "amount", [0.01, 0.25, 0.5, 0.75, 0.99])
    return out.select(*[r(F.col("pcts")[i]).alias(f"p{p}") for i, p in enumerate((1, 25, 50, 75, 99))])


@query("a15_component_table", S("\nUNION ALL ".join(f"""SELECT '{c}' AS component, round(avg({c}), 6) AS mean,
    round(avg(CAST({c} < 0.5 AS INTEGER)), 6) AS below_half, round(avg(CAST({c} < 0.3 AS INTEGER)), 6) AS below_third,
    round(avg(CAST({c} = 1 AS INTEGER)), 6) AS full FROM cf""" for c in ("certainty", "history", "completeness")), "cf"))
def a15(spark, sf):
    parts = {n: F.col(f"c.components.{n}") for n in ("certainty", "history", "completeness")}
    out = evaluate.component_table(confident(spark, sf), parts)
    return out.select("component", *[r(c).alias(c) for c in ("mean", "below_half", "below_third", "full")])


@query("a15_weakest_component", S("""SELECT CASE WHEN certainty = low THEN 'certainty' WHEN history = low THEN 'history'
    WHEN familiarity = low THEN 'familiarity' WHEN novelty = low THEN 'novelty' ELSE 'completeness' END AS weakest, count(*) AS n FROM cf GROUP BY 1""", "cf"))
def a15w(spark, sf):
    return confident(spark, sf).groupBy(F.col("c.weakest").alias("weakest")).agg(F.count("*").alias("n"))


@query("a16_decision_counts", S("SELECT decision, rule, count(*) AS n FROM rt GROUP BY ALL", "rt"))
def a16(spark, sf):
    return reports.decision_counts(routed(spark, sf))


@query("a17_verdicts_per_minute", S("SELECT CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute, decision, count(*) AS n FROM rt GROUP BY ALL", "rt"))
def a17(spark, sf):
    return reports.per_minute(routed(spark, sf)).select(F.unix_seconds("minute").alias("minute"), "decision", "n")


@query("a18_decision_counters", S("""SELECT decision, count(*) AS n, count(*) FILTER (user_tx_count >= 9) AS model_invoked FROM rt GROUP BY 1""", "rt"))
def a18(spark, sf):
    return routed(spark, sf).groupBy("decision").agg(
        F.count("*").alias("n"), F.count_if(F.col("user_tx_count") >= 9).alias("model_invoked"))


_PAIRS = {"amount_merchant": ("amount", "merchant"), "amount_score": ("amount", "score_a"), "scores": ("score_a", "score_b")}


@query("a19_correlations", S("\nUNION ALL ".join(f"SELECT '{n}' AS pair, round(corr({a}, {b}), 6) AS r FROM sc" for n, (a, b) in _PAIRS.items()), "sc"))
def a19(spark, sf):
    return reports.correlations(scored(tx_events(spark, sf)), _PAIRS).select("pair", r("r").alias("r"))


@query("a19_most_correlated", S("""SELECT c AS pair, round(x, 6) AS r FROM (SELECT 'score_a' AS c, corr(amount, score_a) AS x FROM sc
    UNION ALL SELECT 'score_b', corr(amount, score_b) FROM sc UNION ALL SELECT 'merchant', corr(amount, merchant) FROM sc) ORDER BY abs(x) DESC LIMIT 1""", "sc"))
def a19m(spark, sf):
    return reports.most_correlated(scored(tx_events(spark, sf)), "amount", ["score_a", "score_b", "merchant"]).select("pair", r("r").alias("r"))


@query("a20_constant_values", S("""SELECT CAST(first_tx_this_month AS BIGINT) AS indicator, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std,
    count(v) AS n, CAST(coalesce(stddev_samp(v), 0) <= 1e-9 AS BIGINT) AS is_constant FROM
    (SELECT first_tx_this_month, CASE WHEN first_tx_this_month = 1 THEN 7.0 ELSE merchant END AS v FROM uf) GROUP BY 1""", "uf"))
def a20(spark, sf):
    df = history(spark, sf).withColumn("v", F.when(F.col("first_tx_this_month") == 1, 7.0).otherwise(F.col("merchant")))
    out = reports.constant_values(df, "first_tx_this_month", "v")
    return out.select(big("first_tx_this_month").alias("indicator"), r("mean").alias("mean"), r(F.coalesce("std", F.lit(0.0))).alias("std"), "n",
                      big("is_constant").alias("is_constant"))


_COEF = {"amount": 0.02, "merchant": -0.01, "user_tx_count": 0.03, "mcc_user_count": -0.05}
_MEAN = {"amount": 50.0, "merchant": 49.5, "user_tx_count": 33.0, "mcc_user_count": 6.5}


@query("a21_top_feature_frequency", S("""SELECT feature, count(*) AS n FROM (SELECT tx_id, feature, row_number() OVER (PARTITION BY tx_id
    ORDER BY abs(v) DESC, i) AS rk FROM (SELECT tx_id, unnest([1, 2, 3, 4]) AS i, unnest(['amount', 'merchant', 'user_tx_count', 'mcc_user_count']) AS feature,
     unnest([CAST(0.02 AS DOUBLE) * (amount - 50), CAST(-0.01 AS DOUBLE) * (merchant - CAST(49.5 AS DOUBLE)),
      CAST(0.03 AS DOUBLE) * (user_tx_count - 33), CAST(-0.05 AS DOUBLE) * (mcc_user_count - CAST(6.5 AS DOUBLE))]) AS v FROM uf))
    WHERE rk <= 2 GROUP BY 1""", "uf"))
def a21(spark, sf):
    df = history(spark, sf)
    top = learning.top_by_magnitude(learning.linear_attributions(df, _COEF, _MEAN), 3)
    return learning.top_frequency(df.withColumn("top_features", top), k=2)


@query("a22_bank_rates", S("""SELECT CAST(floor((dense_rank() OVER (ORDER BY "user") - 1) / 150) AS BIGINT) AS bank, "user", label FROM txo""", "txo")
       .replace("SELECT CAST(floor", "SELECT bank, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate FROM (SELECT CAST(floor")
       + ") GROUP BY 1")
def a22(spark, sf):
    out = reports.label_balance(banks(tx_orders(spark, sf)), "bank")
    return out.select("bank", "n", "positives", r("rate").alias("rate"))


@query("a23_class_weight", S("""SELECT mcc, round(CASE WHEN sum(label) > 0 THEN (count(*) - sum(label)) / CAST(sum(label) AS DOUBLE) ELSE 1 END, 6) AS weight
    FROM tx GROUP BY 1""", "tx"))
def a23(spark, sf):
    return reports.class_weight(tx_events(spark, sf), "label", "mcc").select("mcc", r("weight").alias("weight"))


@query("a24_edge_density", S("""SELECT count(*) AS edges, count(DISTINCT ("user", merchant)) AS pairs, count(DISTINCT "user") AS left_nodes,
    count(DISTINCT merchant) AS right_nodes, round(avg(label), 6) AS edge_rate,
    round(CAST(count(*) AS DOUBLE) / (count(DISTINCT "user") * count(DISTINCT merchant)), 6) AS density FROM tx""", "tx"))
def a24(spark, sf):
    out = reports.edge_density(tx_events(spark, sf), "user", "merchant")
    return out.select("edges", "pairs", "left_nodes", "right_nodes", r("edge_rate").alias("edge_rate"), r("density").alias("density"))


@query("a25_user_state", S("""SELECT "user", count(*) AS tx_count, round(sum(amount), 4) AS amount_sum, max(amount) AS amount_max,
    CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, count(g) AS gap_n, round(avg(g), 6) AS gap_mean, round(stddev_samp(g), 6) AS gap_std,
    string_agg(CASE WHEN rn <= 9 THEN CAST(tx_id AS VARCHAR) END, ',' ORDER BY rn DESC) AS recent
    FROM (SELECT *, epoch_us(ts) / 864e8 - lag(epoch_us(ts)) OVER (PARTITION BY "user" ORDER BY ts, tx_id) / 864e8 AS g,
     row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, tx_id DESC) AS rn FROM tx) GROUP BY 1""", "tx"))
def a25(spark, sf):
    out = reports.user_state(tx_events(spark, sf))
    ids = F.array_join(F.transform("recent", lambda x: x["tx_id"].cast("string")), ",")
    return out.select("user", "tx_count", r("amount_sum", 4).alias("amount_sum"), "amount_max", F.unix_micros("last_ts").alias("last_us"),
                      "gap_n", r("gap_mean").alias("gap_mean"), r("gap_std").alias("gap_std"), ids.alias("recent"))


@query("a25_user_visits", S("""SELECT "user", 'merchant' AS kind, CAST(merchant AS VARCHAR) AS value, count(*) AS n FROM tx GROUP BY ALL
    UNION ALL SELECT "user", 'mcc', mcc, count(*) FROM tx GROUP BY ALL UNION ALL SELECT "user", 'channel', channel, count(*) FROM tx GROUP BY ALL""", "tx"))
def a25v(spark, sf):
    return reports.history_visits(tx_events(spark, sf))
