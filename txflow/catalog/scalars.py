"""Projections, predicates and scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txflow.catalog.base import (
    NULLABLE, big, confident, history, r, rt, raw_events, routed, scored, tx_events, tx_orders,
)
from txflow.catalog.registry import query
from txflow.catalog.sql import REASON, S, head, route_sql
from txflow.functions import clean as c
from txflow.functions import decide
from txflow.operators import encode
from txflow.operators.features import amount_history, clean_transactions
from txflow.operators.split import chrono_split
from txflow.schema import CHANNEL_VALUES, ERROR_TYPES, USER_FEATURES


@query("f01_parse_amount", S(
    """SELECT tx_id, "Amount" AS amount_text, CAST(replace(ltrim("Amount", '$'), ',', '') AS DOUBLE) AS amount FROM raw""",
    "raw"))
def f01(spark, sf):
    return raw_events(spark, sf).select("tx_id", F.col("Amount").alias("amount_text"), c.parse_amount("Amount").alias("amount"))


@query("f02_signed_log", S(
    """SELECT tx_id, round(sign(a) * ln(1 + abs(a)), 6) AS amount_log
    FROM (SELECT tx_id, CAST(replace(replace("Amount", '$', ''), ',', '') AS DOUBLE) AS a FROM raw)""", "raw"))
def f02(spark, sf):
    return raw_events(spark, sf).select("tx_id", r(c.signed_log1p(c.parse_amount("Amount"))).alias("amount_log"))


@query("f03_build_timestamp", S(
    """SELECT event_id AS tx_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute,
    CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS epoch_s FROM events"""))
def f03(spark, sf):
    ts = c.build_timestamp("Year", "Month", "Day", "Time")
    return raw_events(spark, sf).select(
        "tx_id", F.date_format(ts, "yyyy-MM-dd HH:mm").alias("minute"), F.unix_seconds(ts).alias("epoch_s"))


@query("f04_label_flag", "SELECT event_id AS tx_id, CAST(event_type = 'error' AS BIGINT) AS label FROM events")
def f04(spark, sf):
    return raw_events(spark, sf).select("tx_id", big(c.label_flag("Is Fraud?")).alias("label"))


@query("f05_clean_zip", S("""SELECT tx_id, CASE WHEN "Zip" <> '' THEN split_part("Zip", '.', 1)
    WHEN "Use Chip" = 'Online Transaction' THEN '00000' ELSE 'MISSING' END AS zip FROM raw""", "raw"))
def f05(spark, sf):
    return raw_events(spark, sf).select("tx_id", c.clean_zip("Zip", "Use Chip").alias("zip"))


@query("f06_clean_state", S("""SELECT tx_id, CASE WHEN "Merchant State" = '' AND "Use Chip" = 'Online Transaction'
    THEN 'ONLINE' ELSE "Merchant State" END AS state FROM raw""", "raw"))
def f06(spark, sf):
    return raw_events(spark, sf).select("tx_id", c.clean_state("Merchant State", "Use Chip").alias("state"))


@query("f07_clean_city", S("""SELECT tx_id, CASE WHEN channel = 'Online Transaction' THEN ' ONLINE' ELSE city END AS city
    FROM tx""", "tx"))
def f07(spark, sf):
    return tx_events(spark, sf).select("tx_id", c.clean_city("city", "channel").alias("city"))


@query("f08_error_flags", S("SELECT tx_id, " + ", ".join(
    f"""CAST(contains("Errors?", '{e}') AS BIGINT) AS "{e}" """ for e in ERROR_TYPES) + " FROM raw", "raw"))
def f08(spark, sf):
    df = raw_events(spark, sf)
    names = F.filter(F.split("Errors?", ","), lambda x: x != "")
    text, listed = c.error_flags("Errors?"), c.error_flags_from_list(names)
    # Both readings of the field must agree; a difference shows up as -1.
    return df.select("tx_id", *[
        big(F.when(text["err_" + e] == listed["err_" + e], text["err_" + e]).otherwise(-1)).alias(e) for e in ERROR_TYPES
    ])


@query("f09_one_hot", S("SELECT tx_id, " + ", ".join(
    f"CAST(channel = '{v}' AS BIGINT) AS \"{v}\"" for v in CHANNEL_VALUES) + " FROM tx", "tx"))
def f09(spark, sf):
    return tx_events(spark, sf).select(
        "tx_id", *[big(v).alias(k.removeprefix("chip_")) for k, v in c.one_hot("channel").items()])


@query("f10_calendar", """SELECT event_id AS tx_id, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month
    FROM events""")
def f10(spark, sf):
    return tx_events(spark, sf).select("tx_id", *[big(v).alias(k) for k, v in c.calendar("ts").items()])


@query("f11_seasonal", """SELECT o_orderkey AS tx_id, CAST(isodow(o_orderdate) > 5 AS BIGINT) AS is_weekend,
    CAST(month(o_orderdate) > 10 AS BIGINT) AS is_holiday_season, dayofyear(o_orderdate) AS day_of_year FROM orders""")
def f11(spark, sf):
    return tx_orders(spark, sf).select("tx_id", *[big(v).alias(k) for k, v in c.seasonal("ts").items()])


_SPLIT = """, sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY "user" ORDER BY ts, tx_id)
    <= floor(count(*) OVER (PARTITION BY "user") * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM {src}) """


@query("f12_frequency_encode", head("tx") + _SPLIT.format(src="tx") + """
    SELECT tx_id, round(coalesce(f.code, 0), 6) AS code FROM sp LEFT JOIN
    (SELECT merchant, ln(1 + count(*)) AS code FROM sp WHERE split = 'train' GROUP BY 1) f ON sp.merchant = f.merchant""")
def f12(spark, sf):
    df = chrono_split(tx_events(spark, sf))
    codes = encode.frequency_table(df.filter("split = 'train'"), "merchant")
    return encode.apply_codes(df, codes, "merchant", "code").select("tx_id", r("code").alias("code"))


@query("f13_label_encode", head("txo") + _SPLIT.format(src="txo") + """
    SELECT tx_id, CAST(coalesce(f.code, 0) AS BIGINT) AS code FROM sp LEFT JOIN
    (SELECT city, row_number() OVER (ORDER BY city) - 1 AS code FROM (SELECT DISTINCT city FROM sp WHERE split = 'train')) f
    ON sp.city = f.city""")
def f13(spark, sf):
    df = chrono_split(tx_orders(spark, sf))
    codes = encode.label_table(df.filter("split = 'train'"), "city")
    return encode.apply_codes(df, codes, "city", "code").select("tx_id", big("code").alias("code"))


@query("f14_standard_scale", head("txo") + _SPLIT.format(src="txo") + """
    SELECT tx_id, round((amount - m) / s, 6) AS z_amount, round(amount, 2) AS back,
     CAST(0 AS DOUBLE) AS z_const FROM sp, (SELECT avg(amount) AS m, stddev_pop(amount) AS s FROM sp WHERE split = 'train')""")
def f14(spark, sf):
    df = chrono_split(tx_orders(spark, sf)).withColumns({"z_amount": F.col("amount"), "z_const": F.lit(3.0)})
    cols = ["z_amount", "z_const"]
    stats = encode.scaler_stats(df.filter("split = 'train'"), cols)
    z = encode.scale(df, stats, cols)
    back = encode.scale(z.withColumn("back", F.col("z_amount")), encode.scaler_stats(
        df.filter("split = 'train'").withColumn("back", F.col("z_amount")), ["back"]), ["back"], inverse=True)
    return back.select("tx_id", r("z_amount").alias("z_amount"), r("back", 2).alias("back"), r("z_const").alias("z_const"))


@query("f15_composite_key", S("""SELECT tx_id, "user" || '_' || (tx_id % 3) AS user_card,
    city || '|' || coalesce(nullif(state, 'S0'), '') AS place, strftime(ts, '%Y-%m') AS month FROM txo""", "txo"))
def f15(spark, sf):
    return tx_orders(spark, sf).select(
        "tx_id", c.composite_key("user", F.col("tx_id") % 3, sep="_").alias("user_card"),
        c.composite_key("city", F.nullif("state", F.lit("S0"))).alias("place"), F.date_format("ts", "yyyy-MM").alias("month"))


@query("f16_safe_ratio", S("""SELECT tx_id, round(amount / nullif(merchant, 0) + 1e-9, 6) AS ratio FROM tx""", "tx"))
def f16(spark, sf):
    return tx_events(spark, sf).select("tx_id", rt(c.safe_ratio("amount", "merchant")).alias("ratio"))


@query("f17_missing_count", S("SELECT tx_id, CAST(n_missing AS BIGINT) AS n_missing FROM cf", "cf"))
def f17(spark, sf):
    return history(spark, sf).select("tx_id", big(c.missing_count(NULLABLE)).alias("n_missing"))


@query("f18_fill_missing", S("""SELECT tx_id, round(coalesce(user_hist_mean, 0) + 1e-9, 6) AS user_hist_mean,
    round(coalesce(user_amount_zscore, -999), 6) AS user_amount_zscore, coalesce(nullif(state, 'S0'), '') AS state FROM uf""", "uf"))
def f18(spark, sf):
    df = history(spark, sf).withColumn("state", F.nullif("state", F.lit("S0")))
    out = c.fill_missing(df, {"user_hist_mean": 0.0, "user_amount_zscore": -999.0, "state": ""})
    return out.select("tx_id", rt("user_hist_mean").alias("user_hist_mean"), r("user_amount_zscore").alias("user_amount_zscore"), "state")


@query("f19_zero_group", S("""SELECT tx_id, round(amount, 6) AS amount, CAST(0 AS DOUBLE) AS user_hist_mean,
    CAST(0 AS DOUBLE) AS user_hist_max FROM tx""", "tx"))
def f19(spark, sf):
    out = c.zero_out(history(spark, sf), USER_FEATURES)
    return out.select("tx_id", r("amount").alias("amount"), "user_hist_mean", "user_hist_max")


@query("f20_mask_id", """SELECT event_id AS tx_id, '••••' || right(CAST(user_id * 1000003 AS VARCHAR), 4) AS masked FROM events""")
def f20(spark, sf):
    return tx_events(spark, sf).select("tx_id", c.mask_id(F.col("user") * 1000003).alias("masked"))


@query("f21_confidence_tier", S("""SELECT tx_id, CASE WHEN s IS NULL THEN 'N/A' WHEN s >= 0.85 THEN 'High' WHEN s >= 0.75
    THEN 'Moderate' ELSE 'Low' END AS tier FROM (SELECT tx_id, nullif(round(amount / (amount + 3), 3), 0.9) AS s FROM tx)""", "tx"))
def f21(spark, sf):
    s = F.nullif(F.round(F.col("amount") / (F.col("amount") + 3), 3), F.lit(0.9))
    return tx_events(spark, sf).select("tx_id", decide.confidence_tier(s).alias("tier"))


@query("f22_threshold_filter", S("SELECT tx_id, score_a FROM sc WHERE score_a >= 0.6 AND label = 1", "sc"))
def f22(spark, sf):
    return scored(tx_events(spark, sf)).filter("score_a >= 0.6D and label = 1").select("tx_id", "score_a")


@query("f23_clean_table", S("""SELECT tx_id, "User" AS user_id, round(amount_log, 6) AS amount_log,
    round(hours_since_last, 6) AS hours_since_last, "Merchant State" AS merchant_state, "Zip" AS zip, "MCC" AS mcc,
    CAST("err_Bad PIN" AS BIGINT) AS err_bad_pin, hour, day_of_week, month,
    CAST("chip_Chip Transaction" AS BIGINT) AS chip, CAST(label AS BIGINT) AS label FROM clean""", "clean"))
def f23(spark, sf):
    df = clean_transactions(raw_events(spark, sf))
    return df.select(
        "tx_id", F.col("User").alias("user_id"), r("amount_log").alias("amount_log"),
        r("hours_since_last").alias("hours_since_last"), F.col("Merchant State").alias("merchant_state"),
        F.col("Zip").alias("zip"), F.col("MCC").alias("mcc"), big(F.col("`err_Bad PIN`")).alias("err_bad_pin"),
        big("hour").alias("hour"), big("day_of_week").alias("day_of_week"), big("month").alias("month"),
        big(F.col("`chip_Chip Transaction`")).alias("chip"), big("label").alias("label"))


@query("f24_confidence", S("""SELECT tx_id, round(certainty, 6) AS certainty, round(history, 6) AS history,
    round(familiarity, 6) AS familiarity, round(novelty, 6) AS novelty, round(completeness, 6) AS completeness,
    round(conf, 6) AS score FROM cf""", "cf"))
def f24(spark, sf):
    return confident(spark, sf).select(
        "tx_id", *[r(f"c.components.{n}").alias(n) for n in decide.WEIGHTS], r("c.score").alias("score"))


@query("f25_confidence_reason", S(f"SELECT tx_id, {REASON} AS reason FROM cf", "cf"))
def f25(spark, sf):
    return confident(spark, sf).select("tx_id", "c.reason")


_D, _R = route_sql()


@query("f26_route", S("SELECT tx_id, decision, rule FROM rt", "rt"))
def f26(spark, sf):
    return routed(spark, sf).select("tx_id", "decision", "rule")


@query("f27_route_variants", S(f"""SELECT tx_id, {_D} AS three_way, {route_sql(stepup="0.0")[0]} AS no_confidence,
    CASE WHEN score_a >= 0.7 THEN 'block' ELSE 'approve' END AS binary_only FROM cf""", "cf"))
def f27(spark, sf):
    conf = F.col("c.score")
    return confident(spark, sf).select(
        "tx_id", decide.route("score_a", conf, "user_tx_count")["decision"].alias("three_way"),
        decide.route("score_a", conf, "user_tx_count", conf_stepup=0.0)["decision"].alias("no_confidence"),
        F.when(F.col("score_a") >= 0.7, "block").otherwise("approve").alias("binary_only"))


@query("f28_segment", S("""SELECT tx_id, CASE WHEN n = 0 THEN 'step_up' WHEN n <= 8 THEN 'cold_start' ELSE 'main_model' END AS segment
    FROM (SELECT tx_id, row_number() OVER (PARTITION BY "user" ORDER BY ts, tx_id) - 1 AS n FROM txo)""", "txo"))
def f28(spark, sf):
    return amount_history(tx_orders(spark, sf)).select("tx_id", decide.segment("user_tx_count").alias("segment"))


@query("f29_rare_slices", S("""SELECT tx_id, CAST(amount_unusual AS BIGINT) AS amount_unusual, CAST(first_mcc AS BIGINT) AS new_mcc,
    CAST(first_city_state AS BIGINT) AS new_location,
    CAST(amount_unusual OR first_mcc = 1 OR first_city_state = 1 AS BIGINT) AS rare_any,
    CAST(NOT (amount_unusual OR first_mcc = 1 OR first_city_state = 1) AS BIGINT) AS ordinary FROM sc""", "sc"))
def f29(spark, sf):
    return history(spark, sf).select("tx_id", *[big(v).alias(k) for k, v in decide.rare_slices().items()])


@query("f31_fuse_scores", S("SELECT tx_id, round(0.9 * score_a + 0.1 * score_b, 6) AS fused FROM sc", "sc"))
def f31(spark, sf):
    return scored(tx_events(spark, sf)).select("tx_id", r(decide.fuse("score_a", "score_b")).alias("fused"))


@query("f32_bin_index", S("""SELECT tx_id, CAST(amount >= 10 AS BIGINT) + CAST(amount >= 50 AS BIGINT) + CAST(amount >= 100 AS BIGINT)
    + CAST(amount >= 200 AS BIGINT) AS bin FROM tx""", "tx"))
def f32(spark, sf):
    return tx_events(spark, sf).select("tx_id", big(c.bin_index("amount", [0, 10, 50, 100, 200, 1000])).alias("bin"))
