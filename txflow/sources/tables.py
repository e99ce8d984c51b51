"""Transaction-shaped views of the test tables.

Every view has tx_id, user, ts, amount, merchant, mcc, channel, city, state, label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txflow.schema import CHANNEL_VALUES

# Keys modulo three, the last raw value first.
CHANNELS = CHANNEL_VALUES[::-1]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table. Its timestamps carry no zone and are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _event_key(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "k": F.get_json_object("props", "$.k").cast("bigint"),
        "ts": F.col("ts").cast("timestamp"),
    })


def channel_of(k) -> F.Column:
    return F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), (k % 3 + 1).cast("int"))


def tx_events(spark: SparkSession, sf: str) -> DataFrame:
    return tx_shape(table(spark, sf, "events"))


def tx_shape(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as transactions."""
    k = F.col("k")
    return _event_key(events).select(
        F.col("event_id").alias("tx_id"), F.col("user_id").alias("user"), "ts",
        F.col("value").alias("amount"), k.alias("merchant"), F.col("event_type").alias("mcc"),
        channel_of(k).alias("channel"),
        F.concat(F.lit("City"), (k % 17).cast("string")).alias("city"),
        F.concat(F.lit("S"), (k % 5).cast("string")).alias("state"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def tx_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("tx_id"), F.col("o_custkey").alias("user"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("amount"),
        F.col("c_nationkey").cast("bigint").alias("merchant"), F.col("o_orderpriority").alias("mcc"),
        F.col("o_orderstatus").alias("channel"),
        F.concat(F.lit("City"), (F.col("o_orderkey") % 17).cast("string")).alias("city"),
        F.concat(F.lit("S"), (F.col("o_orderkey") % 5).cast("string")).alias("state"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


def tx_items(spark: SparkSession, sf: str) -> DataFrame:
    item = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    joined = item.join(orders, item.l_orderkey == orders.o_orderkey).join(part, item.l_partkey == part.p_partkey)
    return joined.select(
        F.xxhash64(*item.columns).alias("tx_id"), F.col("o_custkey").alias("user"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_extendedprice").alias("amount"),
        F.col("l_suppkey").alias("merchant"), F.col("p_brand").alias("mcc"),
        F.col("l_linestatus").alias("channel"),
        F.concat(F.lit("City"), (F.col("l_suppkey") % 17).cast("string")).alias("city"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string")).alias("state"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as raw text rows of the card-transaction format, plus tx_id."""
    e = _event_key(table(spark, sf, "events"))
    k, i = F.col("k"), F.col("event_id")
    online = k % 3 == 1
    text = lambda c: c.cast("string")
    sign = F.when(i % 10 == 0, "-").otherwise("")
    return e.select(
        i.alias("tx_id"),
        text(F.col("user_id")).alias("User"), text(i % 3).alias("Card"),
        text(F.year("ts")).alias("Year"), text(F.month("ts")).alias("Month"),
        text(F.dayofmonth("ts")).alias("Day"),
        F.concat(text(F.hour("ts")), F.lit(":"), F.date_format("ts", "mm")).alias("Time"),
        F.concat(F.lit("$"), sign, F.format_number(F.col("value") * 10, 2)).alias("Amount"),
        channel_of(k).alias("Use Chip"),
        F.concat(F.lit("M"), text(k)).alias("Merchant Name"),
        F.when(online, " ONLINE").otherwise(F.concat(F.lit("City"), text(k % 17))).alias("Merchant City"),
        F.when(online, "").otherwise(F.concat(F.lit("S"), text(k % 5))).alias("Merchant State"),
        F.when(online | (i % 50 == 0), "").otherwise(F.concat(text(k + 10000), F.lit(".0"))).alias("Zip"),
        text(k % 12 + 5000).alias("MCC"),
        F.when(i % 77 == 0, "Bad PIN,Insufficient Balance,").when(i % 7 == 0, "Bad PIN,")
        .when(i % 13 == 0, "Technical Glitch,").otherwise("").alias("Errors?"),
        F.when(F.col("event_type") == "error", "Yes").otherwise("No").alias("Is Fraud?"),
    )


def scored(df: DataFrame) -> DataFrame:
    """Add two closed-form scores in [0, 1), so that any engine can recompute them."""
    a = F.col("amount")
    return df.withColumns({
        "score_a": F.round(a / (a + 50), 3),
        "score_b": F.round(a / (a + 20 + F.col("merchant")), 3),
    })
