"""Sorting, limits, samples and set operations (O, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txflow.catalog.base import big, r, scored, tx_events, tx_orders
from txflow.catalog.registry import query
from txflow.catalog.sql import S
from txflow.operators import reports, sampling
from txflow.operators.features import amount_history, daily_volume
from txflow.operators.learning import top_by_magnitude
from txflow.operators.split import chrono_split, first_success


@query("o01_sorted_rows", S("""SELECT tx_id, row_number() OVER (PARTITION BY "user" ORDER BY ts, tx_id) - 1 AS at FROM txo""", "txo"))
def o01(spark, sf):
    return amount_history(tx_orders(spark, sf)).sort("user", "ts", "tx_id").select("tx_id", F.col("user_tx_count").alias("at"))


@query("o02_top_of_row", S("""SELECT tx_id, CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN 'amount' WHEN abs(b) >= abs(c) THEN 'merchant'
    ELSE 'hour' END AS first_name FROM (SELECT tx_id, amount - 50 AS a, CAST(merchant AS DOUBLE) - 50 AS b, CAST(hour(ts) AS DOUBLE) - 12 AS c FROM tx)""", "tx"))
def o02(spark, sf):
    df = tx_events(spark, sf)
    values = {"amount": F.col("amount") - 50, "merchant": F.col("merchant") - 50.0, "hour": F.hour("ts") - 12.0}
    return df.withColumn("top", top_by_magnitude(values, 2)).select("tx_id", F.col("top")[0]["feature"].alias("first_name"))


@query("o03_top_days", S("""SELECT CAST(ts::DATE AS VARCHAR) AS day, count(*) AS n FROM tx GROUP BY 1 ORDER BY n DESC, day LIMIT 10""", "tx"))
def o03(spark, sf):
    top = reports.top_n(daily_volume(tx_events(spark, sf)), F.desc("n"), 10, "day")
    return top.select(F.col("day").cast("string").alias("day"), "n")


@query("o04_argmax_first", S("""SELECT mcc, tx_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY mcc ORDER BY amount DESC, tx_id) AS rn FROM tx)
    WHERE rn = 1""", "tx"))
def o04(spark, sf):
    best = F.max_by(F.struct("tx_id", "amount"), F.struct("amount", -F.col("tx_id"))).alias("b")
    return tx_events(spark, sf).groupBy("mcc").agg(best).select("mcc", "b.tx_id", "b.amount")


@query("o05_latest_feed", S("SELECT tx_id FROM tx ORDER BY ts DESC, tx_id LIMIT 100", "tx"))
def o05(spark, sf):
    return tx_events(spark, sf).orderBy(F.desc("ts"), "tx_id").limit(100).select("tx_id")


@query("o06_sample_rows")
def o06(spark, sf):
    return sampling.sample_rows(tx_events(spark, sf), "tx_id", 500).select("tx_id")


@query("o07_stratified_split", S("""SELECT label, part, CASE part WHEN 'a' THEN CAST(floor(n * 0.5) AS BIGINT) ELSE n - CAST(floor(n * 0.5) AS BIGINT) END AS n
    FROM (SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM tx GROUP BY 1), (VALUES ('a'), ('b')) v(part)""", "tx"))
def o07(spark, sf):
    out = sampling.stratified_split(tx_events(spark, sf), "label", "tx_id")
    return out.groupBy(big("label").alias("label"), "part").agg(F.count("*").alias("n"))


@query("o07_stratified_sample")
def o07s(spark, sf):
    return sampling.stratified_sample(tx_events(spark, sf), "mcc", "tx_id", 20).select("mcc", "tx_id")


@query("o07_stratum_sizes", S("SELECT mcc, least(count(*), 20) AS n FROM tx GROUP BY 1", "tx"))
def o07n(spark, sf):
    return sampling.stratified_sample(tx_events(spark, sf), "mcc", "tx_id", 20).groupBy("mcc").agg(F.count("*").alias("n"))


@query("o08_ratio_subsample", S("""SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 1) * 3 AS negatives FROM txo WHERE label = 1
    HAVING count(*) > 0""".replace("count(*) FILTER (label = 1) * 3", "least(count(*) * 3, (SELECT count(*) FROM txo WHERE label = 0))"), "txo"))
def o08(spark, sf):
    out = sampling.ratio_subsample(tx_orders(spark, sf), "label", "tx_id", 3)
    return out.agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


@query("u01_union_all", S("""SELECT source, count(*) AS n, round(sum(amount), 2) AS total FROM (SELECT 'events' AS source, amount FROM tx
    UNION ALL SELECT 'orders', amount FROM txo) GROUP BY 1""", "tx", "txo"))
def u01(spark, sf):
    a = tx_events(spark, sf).withColumn("source", F.lit("events"))
    b = tx_orders(spark, sf).withColumn("source", F.lit("orders"))
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"), r(F.sum("amount"), 2).alias("total"))


@query("u02_key_intersection", S("""SELECT "user" FROM tx INTERSECT SELECT "user" FROM txo""", "tx", "txo"))
def u02(spark, sf):
    return tx_events(spark, sf).select("user").intersect(tx_orders(spark, sf).select("user"))


@query("u02_split_users", S("""SELECT count(*) AS both FROM (SELECT "user" FROM txo GROUP BY 1 HAVING count(*) >= 2)""", "txo"))
def u02s(spark, sf):
    sp = chrono_split(tx_orders(spark, sf))
    train = sp.filter("split = 'train'").select("user")
    return train.intersect(sp.filter("split = 'test'").select("user")).agg(F.count("*").alias("both"))


@query("u03_distinct_pairs", S("""SELECT DISTINCT "user", merchant FROM tx""", "tx"))
def u03(spark, sf):
    return tx_events(spark, sf).select("user", "merchant").dropDuplicates()


@query("u04_first_success", S("""SELECT "user", tx_id FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY tx_id) AS rn FROM sc WHERE score_a >= 0.5) WHERE rn = 1""", "sc"))
def u04(spark, sf):
    tries = scored(tx_events(spark, sf)).select("user", "tx_id", (F.col("score_a") >= 0.5).alias("ok"), "score_a")
    return first_success(tries, "user", "tx_id", "ok").select("user", "tx_id")


@query("u05_distinct_values", S("SELECT DISTINCT city FROM tx", "tx"))
def u05(spark, sf):
    return tx_events(spark, sf).select("city").distinct()
