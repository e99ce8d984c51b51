"""Sources, profiles and entity samples (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txflow.catalog.base import r, tx_events
from txflow.catalog.registry import query
from txflow.catalog.sql import S
from txflow.operators import reports, sampling
from txflow.sources import io


@query("s03_profile", """SELECT count(*) AS rows, count(DISTINCT user_id) AS users,
    count(*) FILTER (event_type = 'error') AS positives FROM events""")
def s03(spark, sf):
    return io.profile(tx_events(spark, sf))


@query("s04_sample_entities")
def s04(spark, sf):
    return sampling.sample_entities(tx_events(spark, sf), "user", 50)


# The sampled ids depend on Spark's hash; the kept rows are checked against an id rule.
@query("s05_keep_entities", S("""SELECT "user", count(*) AS n, round(sum(amount), 2) AS total FROM tx
    WHERE "user" IN (SELECT "user" FROM tx WHERE amount > 300) GROUP BY 1""", "tx"))
def s05(spark, sf):
    df = tx_events(spark, sf)
    chosen = df.filter("amount > 300").select("user").distinct()
    return sampling.keep_entities(df, chosen, "user").groupBy("user").agg(
        F.count("*").alias("n"), r(F.sum("amount"), 2).alias("total"))


@query("s13_user_history", S("""SELECT "user", count(*) AS tx_count, round(sum(amount), 4) AS amount_sum,
    round(sum(amount * amount), 3) AS amount_sq_sum, max(amount) AS amount_max,
    CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM tx WHERE "user" = 7 GROUP BY 1""", "tx"))
def s13(spark, sf):
    out = io.user_history(reports.history_table(tx_events(spark, sf)), 7)
    return out.select("user", "tx_count", r("amount_sum", 4).alias("amount_sum"), r("amount_sq_sum", 3).alias("amount_sq_sum"),
                      "amount_max", F.unix_micros("last_ts").alias("last_us"))


@query("s14_message_round_trip", S("""SELECT CAST(tx_id AS VARCHAR) AS transaction_id, CAST("user" AS VARCHAR) AS user_id,
    round(amount, 2) AS amount, mcc, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at FROM tx""", "tx"))
def s14(spark, sf):
    msg = tx_events(spark, sf).select(
        F.col("tx_id").cast("string").alias("transaction_id"), F.col("user").cast("string").alias("user_id"),
        F.date_trunc("second", "ts").alias("timestamp"), "amount", "mcc")
    back = io.parse_messages(io.to_messages(msg))
    return back.select("transaction_id", "user_id", r("amount", 2).alias("amount"), "mcc", F.unix_seconds("timestamp").alias("at"))
