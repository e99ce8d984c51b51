"""Ordered window features, splits and sequences (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txflow.catalog.base import big, history, r, rt, tx_events, tx_orders
from txflow.catalog.registry import query
from txflow.catalog.sql import S
from txflow.operators import features as ft
from txflow.operators.encode import dense_index
from txflow.operators.history import Previous, prior
from txflow.operators.split import banks, chrono_split, recent_slice
from txflow.operators.windows import build_windows, count_windows, flatten_window, serving_vector
from txflow.schema import FLAG_COLUMNS

PICK = ("amount", "merchant", "label")


@query("w01_user_amount_history", S("""SELECT tx_id, user_tx_count, round(user_hist_mean + 1e-9, 6) AS user_hist_mean,
    round(user_hist_std, 6) AS user_hist_std, user_hist_max FROM uf""", "uf"))
def w01(spark, sf):
    return ft.amount_history(tx_events(spark, sf)).select(
        "tx_id", "user_tx_count", rt("user_hist_mean").alias("user_hist_mean"), r("user_hist_std").alias("user_hist_std"),
        "user_hist_max")


@query("w02_zscore_and_ratio", S("""SELECT tx_id, round(user_amount_zscore, 6) AS zscore,
    round(user_amount_to_max_ratio + 1e-9, 6) AS to_max FROM uf""", "uf"))
def w02(spark, sf):
    return history(spark, sf).select("tx_id", r("user_amount_zscore").alias("zscore"), rt("user_amount_to_max_ratio").alias("to_max"))


@query("w03_prior_visits", S("SELECT tx_id, merchant_user_count, mcc_user_count, CAST(is_new_merchant AS BIGINT) AS is_new_merchant FROM ufo", "ufo"))
def w03(spark, sf):
    out = ft.familiarity(tx_orders(spark, sf), "user", [("merchant_user_count", ["merchant"]), ("mcc_user_count", ["mcc"])])
    return out.select("tx_id", "merchant_user_count", "mcc_user_count", big(F.col("merchant_user_count") == 0).alias("is_new_merchant"))


_FIRSTS = ("first_mcc", "first_city_state", "first_channel", "first_tx_this_month", "first_tx_this_year")


@query("w04_first_occurrence", S("SELECT tx_id, " + ", ".join(f"CAST({f} AS BIGINT) AS {f}" for f in _FIRSTS) + " FROM ufo", "ufo"))
def w04(spark, sf):
    return ft.user_features(tx_orders(spark, sf)).select("tx_id", *[big(f).alias(f) for f in _FIRSTS])


_NOVEL = ("is_largest_ever", "is_2x_hist_max", "is_5x_hist_max")


@query("w05_amount_novelty", S("SELECT tx_id, " + ", ".join(f"CAST({f} AS BIGINT) AS {f}" for f in _NOVEL) + " FROM ufo", "ufo"))
def w05(spark, sf):
    return ft.user_features(tx_orders(spark, sf)).select("tx_id", *[big(f).alias(f) for f in _NOVEL])


@query("w06_gap_to_previous", S("""SELECT tx_id, round(coalesce(d * 24, 0), 6) AS hours, round(d, 6) AS days FROM
    (SELECT tx_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY "user" ORDER BY ts, tx_id)) / 864e8 AS d FROM tx)""", "tx"))
def w06(spark, sf):
    out = prior(tx_events(spark, sf), "user", [Previous("p")])
    days = (F.unix_micros("ts") - F.unix_micros("p")) / 864e8
    return out.select("tx_id", r(F.coalesce(days * 24, F.lit(0.0))).alias("hours"), r(days).alias("days"))


@query("w07_dormancy", S("SELECT tx_id, round(days_since_last_tx, 6) AS gap, CAST(is_dormant AS BIGINT) AS is_dormant FROM uf", "uf"))
def w07(spark, sf):
    return history(spark, sf).select("tx_id", r("days_since_last_tx").alias("gap"), big("is_dormant").alias("is_dormant"))


@query("w08_merchant_history", S("""SELECT tx_id, merch_tx_count, round(merch_hist_amount_mean + 1e-9, 6) AS mean,
    round(merch_amount_deviation, 6) AS deviation, round(merch_large_tx_rate + 1e-9, 6) AS large_rate FROM mf""", "mf"))
def w08(spark, sf):
    return ft.merchant_features(tx_events(spark, sf)).select(
        "tx_id", "merch_tx_count", rt("merch_hist_amount_mean").alias("mean"), r("merch_amount_deviation").alias("deviation"),
        rt("merch_large_tx_rate").alias("large_rate"))


@query("w09_merchant_spike", S("""SELECT tx_id, round(merch_days_active, 6) AS days_active,
    round(merch_spike_ratio, 6) AS spike FROM mf""", "mf"))
def w09(spark, sf):
    return ft.merchant_features(tx_events(spark, sf)).select(
        "tx_id", r("merch_days_active").alias("days_active"), r("merch_spike_ratio").alias("spike"))


@query("w10_merchant_7d_count", S("SELECT tx_id, merch_7d_count FROM mfo", "mfo"))
def w10(spark, sf):
    return ft.merchant_features(tx_orders(spark, sf)).select("tx_id", "merch_7d_count")


@query("w11_population_volume", S("""SELECT CAST(day AS VARCHAR) AS day, pop_prior_day_count,
    round(pop_7d_avg_count + 1e-9, 6) AS pop_7d_avg_count FROM popo""", "popo"))
def w11(spark, sf):
    return ft.population_volume(tx_orders(spark, sf)).select(
        F.col("day").cast("string").alias("day"), "pop_prior_day_count", rt("pop_7d_avg_count").alias("pop_7d_avg_count"))


@query("w12_chrono_split", S("""SELECT tx_id, CASE WHEN row_number() OVER (PARTITION BY "user" ORDER BY ts, tx_id)
    <= floor(count(*) OVER (PARTITION BY "user") * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM txo""", "txo"))
def w12(spark, sf):
    return chrono_split(tx_orders(spark, sf)).select("tx_id", "split")


@query("w14_sliding_windows", S("""SELECT tx_id, array_to_string(list_transform(seq, lambda x: CAST(x AS VARCHAR)), ',') AS merchants,
    CAST(label AS BIGINT) AS label FROM (SELECT *, list(merchant) OVER w AS seq, row_number() OVER (PARTITION BY "user" ORDER BY ts, tx_id) AS rn
     FROM tx WINDOW w AS (PARTITION BY "user" ORDER BY ts, tx_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    WHERE rn >= 10 AND (rn - 10) % 2 = 0""", "tx"))
def w14(spark, sf):
    out = build_windows(tx_events(spark, sf), PICK, ["user"], stride=2)
    names = F.transform("seq", lambda x: x["merchant"].cast("string"))
    return out.select("tx_id", F.array_join(names, ",").alias("merchants"), big("label").alias("label"))


@query("w15_count_windows", S("""SELECT CAST(sum(greatest(n - 9, 0)) AS BIGINT) AS windows, count(*) AS users,
    count(*) FILTER (n < 10) AS users_skipped, CAST(sum(CASE WHEN n < 10 THEN n ELSE 0 END) AS BIGINT) AS rows_dropped
    FROM (SELECT "user", count(*) AS n FROM txo GROUP BY 1)""", "txo"))
def w15(spark, sf):
    return count_windows(tx_orders(spark, sf))


@query("w16_flatten_window", S("""SELECT tx_id, array_to_string(list_transform(list_concat(a, m, l), lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ',')
    AS flat FROM (SELECT tx_id, list(amount) OVER w AS a, list(CAST(merchant AS DOUBLE)) OVER w AS m,
     list(CAST(label AS DOUBLE)) OVER w AS l, row_number() OVER (PARTITION BY "user" ORDER BY ts, tx_id) AS rn FROM tx
     WINDOW w AS (PARTITION BY "user" ORDER BY ts, tx_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE rn >= 10""", "tx"))
def w16(spark, sf):
    out = build_windows(tx_events(spark, sf), PICK, ["user"])
    cents = F.transform(flatten_window("seq", PICK), lambda x: F.round(x * 100).cast("bigint").cast("string"))
    return out.select("tx_id", F.array_join(cents, ",").alias("flat"))


@query("w17_serving_vector", S("""SELECT tx_id, CAST(len(seq) + 4 AS BIGINT) AS slots, round(list_sum(seq), 2) AS amount_sum,
    CAST(n AS BIGINT) AS last_slot FROM (SELECT tx_id, list(amount) OVER w AS seq, count(*) OVER p AS n FROM tx
     WINDOW w AS (PARTITION BY "user" ORDER BY ts, tx_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
      p AS (PARTITION BY "user" ORDER BY ts, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n >= 9""", "tx"))
def w17(spark, sf):
    out = build_windows(history(spark, sf), ["amount"], ["user"], scanned=False)
    extra = ["first_mcc", "first_channel", "merchant_user_count", "user_tx_count"]
    v = serving_vector("user_tx_count", "seq", ["amount"], extra)
    total = F.aggregate(F.slice("v", 1, 10), F.lit(0.0), lambda acc, x: acc + x)
    return out.withColumn("v", v).select(
        "tx_id", F.size("v").cast("bigint").alias("slots"), r(total, 2).alias("amount_sum"),
        F.element_at("v", -1).cast("bigint").alias("last_slot"))


@query("w18_recent_slice", S("""SELECT tx_id FROM tx WHERE epoch_us(ts) >
    (SELECT quantile_cont(CAST(epoch_us(ts) AS DOUBLE), CAST(0.8 AS DOUBLE)) FROM tx)""", "tx"))
def w18(spark, sf):
    return recent_slice(tx_events(spark, sf)).select("tx_id")


@query("w19_banks", S("""SELECT "user", CAST(floor((dense_rank() OVER (ORDER BY "user") - 1) / 150) AS BIGINT) AS bank
    FROM (SELECT DISTINCT "user" FROM txo)""", "txo"))
def w19(spark, sf):
    users = tx_orders(spark, sf).select("user").distinct()
    return banks(users).select("user", "bank")


@query("w20_all_features", S("""SELECT tx_id, """ + ", ".join(f"CAST({f} AS BIGINT) AS {f}" for f in FLAG_COLUMNS) + """,
    round(user_amount_zscore, 6) AS user_amount_zscore, round(amount_vs_last_year_ratio, 6) AS amount_vs_last_year_ratio,
    merch_7d_count, round(merch_amount_deviation, 6) AS merch_amount_deviation, pop_prior_day_count
    FROM ufo JOIN (SELECT tx_id AS t2, merch_7d_count, merch_amount_deviation FROM mfo) ON t2 = tx_id
    JOIN (SELECT day, pop_prior_day_count FROM popo) ON day = ts::DATE""", "ufo", "mfo", "popo"))
def w20(spark, sf):
    out = ft.enrich(tx_orders(spark, sf))
    return out.select(
        "tx_id", *[big(f).alias(f) for f in FLAG_COLUMNS], r("user_amount_zscore").alias("user_amount_zscore"),
        r("amount_vs_last_year_ratio").alias("amount_vs_last_year_ratio"), "merch_7d_count",
        r("merch_amount_deviation").alias("merch_amount_deviation"), "pop_prior_day_count")


@query("w21_dense_ids", S("SELECT city, CAST(dense_rank() OVER (ORDER BY city) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT city FROM tx)", "tx"))
def w21(spark, sf):
    return dense_index(tx_events(spark, sf), "city", "id")
