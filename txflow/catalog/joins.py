"""Joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txflow.catalog.base import big, history, r, rt, scored, scored_history, tx_events, tx_orders
from txflow.catalog.registry import query
from txflow.catalog.sql import S
from txflow.operators import features as ft
from txflow.operators import reports
from txflow.operators.encode import apply_codes, frequency_table
from txflow.operators.graph import expected_positive_users, observed_positive_users
from txflow.operators.joining import with_row
from txflow.operators.split import chrono_split, leaks, mismatches
from txflow.operators.windows import build_windows
from txflow.sources.tables import table


@query("j01_semi_join", """SELECT event_id AS tx_id FROM events WHERE user_id IN
    (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def j01(spark, sf):
    ids = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user"))
    return tx_events(spark, sf).join(ids, "user", "left_semi").select("tx_id")


@query("j02_last_year_mean", S("""SELECT tx_id, round(same_month_last_year_mean + 1e-9, 4) AS last_year,
    round(amount_vs_last_year_ratio, 6) AS ratio FROM ufo""", "ufo"))
def j02(spark, sf):
    return ft.user_features(tx_orders(spark, sf)).select(
        "tx_id", rt("same_month_last_year_mean", 4).alias("last_year"), r("amount_vs_last_year_ratio").alias("ratio"))


@query("j03_map_lookup", S("""SELECT tx_id, round(ln(1 + n), 6) AS code FROM tx
    JOIN (SELECT city AS c, count(*) AS n FROM tx GROUP BY 1) ON c = city""", "tx"))
def j03(spark, sf):
    df = tx_events(spark, sf)
    return apply_codes(df, frequency_table(df, "city"), "city", "code").select("tx_id", r("code").alias("code"))


@query("j04_window_features", S("""SELECT tx_id, user_tx_count, CAST(first_channel AS BIGINT) AS first_channel,
    CAST(10 AS BIGINT) AS steps FROM uf WHERE user_tx_count >= 9""", "uf"))
def j04(spark, sf):
    # The window carries the id of its last row, and features and window come from one pass.
    out = build_windows(history(spark, sf), ["amount"], ["user"], scanned=False)
    return out.select("tx_id", "user_tx_count", big("first_channel").alias("first_channel"), F.size("seq").cast("bigint").alias("steps"))


@query("j05_feature_tables", S("""SELECT uf.tx_id, user_tx_count, merch_tx_count FROM uf JOIN mf ON uf.tx_id = mf.tx_id""", "uf", "mf"))
def j05(spark, sf):
    df = tx_events(spark, sf)
    users = ft.amount_history(df).select("tx_id", "user_tx_count")
    return users.join(ft.merchant_features(df).select("tx_id", "merch_tx_count"), "tx_id")


@query("j06_group_value_to_rows", S("""SELECT tx_id, CAST(epoch_us(min(ts) OVER (PARTITION BY merchant)) AS BIGINT) AS first_us FROM tx""", "tx"))
def j06(spark, sf):
    out = ft.prior(tx_events(spark, sf), "merchant", [ft.KeyTotals(first="f")])
    return out.select("tx_id", F.unix_micros("f").alias("first_us"))


@query("j07_align_missing_zero", S("""SELECT m.merchant, CAST(coalesce(o.observed, 0) AS BIGINT) AS observed, round(m.expected, 6) AS expected FROM
    (SELECT merchant, sum(1 - pow(1 - rate, n)) AS expected FROM (SELECT merchant, "user", count(*) AS n FROM tx GROUP BY ALL),
     (SELECT avg(label) AS rate FROM tx) GROUP BY 1) m LEFT JOIN
    (SELECT merchant, count(DISTINCT "user") AS observed FROM tx WHERE label = 1 AND amount > 50 GROUP BY 1) o USING (merchant)""", "tx"))
def j07(spark, sf):
    df = tx_events(spark, sf)
    seen = observed_positive_users(df.filter("amount > 50"))
    return expected_positive_users(df).join(seen, "merchant", "left").select(
        "merchant", F.coalesce("observed", F.lit(0)).alias("observed"), r("expected").alias("expected"))


@query("j08_rows_by_grid", S("""SELECT tx_id, CAST(g AS BIGINT) AS step, round(score_a * g / 10, 6) AS value FROM sc, range(0, 11) t(g)""", "sc"))
def j08(spark, sf):
    # A fixed grid per row is an explode, not a join.
    steps = scored(tx_events(spark, sf)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(10))))
    return steps.select("tx_id", big("g").alias("step"), r(F.col("score_a") * F.col("g") / 10).alias("value"))


@query("j09_join_model_scores", S("""SELECT tx_id, score_a, score_b, round(score_b - score_a, 6) AS delta FROM sc WHERE user_tx_count >= 9""", "sc"))
def j09(spark, sf):
    a = scored_history(spark, sf).filter("user_tx_count >= 9").select("tx_id", "score_a")
    b = scored(tx_events(spark, sf)).select("tx_id", "score_b")
    return a.join(b, "tx_id").select("tx_id", "score_a", "score_b", r(F.col("score_b") - F.col("score_a")).alias("delta"))


@query("j10_leak_check", S("""SELECT count(*) AS leaking_users FROM (SELECT "user",
     max(CASE WHEN train THEN rn END) AS last_train, min(CASE WHEN NOT train THEN rn END) AS first_test
    FROM (SELECT *, rn <= floor(n * CAST(0.8 AS DOUBLE)) AS train FROM (SELECT "user",
      row_number() OVER (PARTITION BY "user" ORDER BY ts, tx_id) AS rn, count(*) OVER (PARTITION BY "user") AS n FROM txo))
    GROUP BY 1) WHERE last_train >= first_test""", "txo"))
def j10(spark, sf):
    return leaks(chrono_split(tx_orders(spark, sf))).agg(F.count("*").alias("leaking_users"))


@query("j11_alignment_check", S("""SELECT count(*) FILTER (tx.label <> uf.label OR tx."user" <> uf."user") AS same_table,
    count(*) FILTER (tx.label <> 0) AS after_flip FROM tx FULL JOIN uf ON tx.tx_id = uf.tx_id""", "tx", "uf"))
def j11(spark, sf):
    df = tx_events(spark, sf)
    cols = ["user", "label"]
    same_rows = mismatches(df, ft.amount_history(df), "tx_id", cols).agg(F.count("*").alias("same_table"))
    flipped = mismatches(df, df.withColumn("label", F.lit(0)), "tx_id", cols).agg(F.count("*").alias("after_flip"))
    return with_row(same_rows, flipped)


@query("j12_label_by_merchant_segment", S("""SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives,
    round(avg(label), 6) AS rate FROM txo JOIN customer ON c_custkey = "user" GROUP BY 1""", "txo"))
def j12(spark, sf):
    seg = table(spark, sf, "customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("segment"))
    out = reports.label_balance(tx_orders(spark, sf).join(seg, "user"), "segment")
    return out.select("segment", "n", "positives", r("rate").alias("rate"))
