"""Node and edge tables, the ring check and neighbour features (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txflow.catalog.base import big, history, r, rt, tx_events, tx_orders
from txflow.catalog.registry import query
from txflow.catalog.sql import S, head
from txflow.operators import graph
from txflow.operators.split import chrono_split


def _carded(spark, sf):
    return tx_events(spark, sf).withColumn("card", F.col("tx_id") % 3)


_NODE = """count(*) AS tx_count, CAST(sum(label) AS BIGINT) AS fraud_count, round(avg(amount) + 1e-9, 6) AS mean_amount,
    round(coalesce(stddev_samp(amount), 0), 6) AS std_amount"""


@query("g02_node_tables", S(f"""SELECT 'user' AS kind, CAST("user" AS VARCHAR) AS id, {_NODE}, CAST(0 AS BIGINT) AS users FROM tx GROUP BY 2
    UNION ALL SELECT 'merchant', CAST(merchant AS VARCHAR), {_NODE}, count(DISTINCT "user") FROM tx GROUP BY 2
    UNION ALL SELECT 'card', "user" || '_' || (tx_id % 3), {_NODE}, 0 FROM tx GROUP BY 2""", "tx"))
def g02(spark, sf):
    nodes = graph.node_tables(_carded(spark, sf))
    out = None
    for kind, id_col in (("user", "user"), ("merchant", "merchant"), ("card", "user_card")):
        users = F.col("unique_user_count") if kind == "merchant" else F.lit(0).cast("bigint")
        part = nodes[kind].select(
            F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("id"), "tx_count", "fraud_count",
            rt("mean_amount").alias("mean_amount"), r("std_amount").alias("std_amount"), users.alias("users"))
        out = part if out is None else out.unionByName(part)
    return out


@query("g03_edge_tables", S("""SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets,
    round(sum(amount_log), 3) AS amount_log, CAST(sum(first_mcc) AS BIGINT) AS first_mcc FROM (
     SELECT 'transacts' AS kind, CAST("user" AS VARCHAR) AS src, CAST(merchant AS VARCHAR) AS dst, ln(1 + amount) AS amount_log, first_mcc FROM uf
     UNION ALL SELECT 'used_at', "user" || '_' || (tx_id % 3), CAST(merchant AS VARCHAR), ln(1 + amount), first_mcc FROM uf
     UNION ALL SELECT 'owns', src, dst, 0, 0 FROM (SELECT DISTINCT CAST("user" AS VARCHAR) AS src, "user" || '_' || (tx_id % 3) AS dst FROM uf)) GROUP BY 1""", "uf"))
def g03(spark, sf):
    df = history(spark, sf).withColumn("card", F.col("tx_id") % 3)
    edges = graph.edge_tables(df, graph.default_attributes())
    out = None
    for kind, t in edges.items():
        has = "amount_log" in t.columns
        part = t.select(F.lit(kind).alias("kind"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"),
                        (F.col("amount_log") if has else F.lit(0.0)).alias("amount_log"), (F.col("first_mcc") if has else F.lit(0.0)).alias("first_mcc"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind").agg(
        F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"),
        r(F.sum("amount_log"), 3).alias("amount_log"), big(F.sum("first_mcc")).alias("first_mcc"))


_RING = """ring AS (SELECT o.merchant, observed, coalesce(expected, 0) AS expected, observed - coalesce(expected, 0) AS excess,
    observed / greatest(coalesce(expected, 0), 1e-9) AS ratio FROM
    (SELECT merchant, count(DISTINCT "user") AS observed FROM tx WHERE label = 1 GROUP BY 1) o LEFT JOIN
    (SELECT merchant, sum(1 - pow(1 - rate, n)) AS expected FROM (SELECT merchant, "user", count(*) AS n FROM tx GROUP BY ALL),
     (SELECT avg(label) AS rate FROM tx) GROUP BY 1) e ON e.merchant = o.merchant)"""


@query("g04_ring_table", head("tx") + ", " + _RING + """ SELECT merchant, observed, round(expected, 6) AS expected,
    round(excess, 6) AS excess, round(ratio, 6) AS ratio, CAST(excess >= 2 AND ratio >= 1.5 AS BIGINT) AS is_excess FROM ring""")
def g04(spark, sf):
    return graph.ring_table(tx_events(spark, sf)).select(
        "merchant", "observed", r("expected").alias("expected"), r("excess").alias("excess"), r("ratio").alias("ratio"), big("is_excess").alias("is_excess"))


@query("g04_ring_verdict", head("tx") + ", " + _RING + """ SELECT count(*) AS merchants, max(observed) AS max_users,
    count(*) FILTER (observed >= 2) AS multi_user, count(*) FILTER (excess >= 2 AND ratio >= 1.5) AS excess_merchants,
    round(avg(ratio), 6) AS mean_ratio, round(quantile_cont(ratio, CAST(0.5 AS DOUBLE)), 6) AS median_ratio,
    CASE WHEN 100.0 * count(*) FILTER (excess >= 2 AND ratio >= 1.5) / count(*) < 5 THEN 'no_evidence'
     WHEN 100.0 * count(*) FILTER (excess >= 2 AND ratio >= 1.5) / count(*) < 20 THEN 'weak_evidence' ELSE 'notable_evidence' END AS verdict FROM ring""")
def g04v(spark, sf):
    out = graph.ring_verdict(graph.ring_table(tx_events(spark, sf)))
    return out.select("merchants", "max_users", "multi_user", "excess_merchants", r("mean_ratio").alias("mean_ratio"),
                      r("median_ratio").alias("median_ratio"), "verdict")


@query("g06_normalize_nodes", S("""SELECT n."user", round((n.c - m) / greatest(s, 1e-6), 6) AS tx_count, round((n.a - am) / greatest(asd, 1e-6), 5) AS mean_amount
    FROM (SELECT "user", count(*) AS c, avg(amount) AS a FROM te GROUP BY 1) n, (SELECT avg(c) AS m, stddev_samp(c) AS s, avg(a) AS am, stddev_samp(a) AS asd
     FROM (SELECT "user", CAST(count(*) AS DOUBLE) AS c, avg(amount) AS a FROM tr GROUP BY 1))""", "txo").replace(
    "\nSELECT n.", """, sp AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts, tx_id)
    <= floor(count(*) OVER (PARTITION BY "user") * CAST(0.8 AS DOUBLE)) AS train FROM txo), tr AS (SELECT * FROM sp WHERE train), te AS (SELECT * FROM sp WHERE NOT train)
    SELECT n.""", 1))
def g06(spark, sf):
    sp = chrono_split(tx_orders(spark, sf)).withColumn("card", F.lit(0))
    train, test = (graph.strip_leaky(graph.node_tables(sp.filter(F.col("split") == s))["user"]).withColumn("tx_count", F.col("tx_count").cast("double"))
                   for s in ("train", "test"))
    _, out = graph.normalize(train, test, ["tx_count", "mean_amount"])
    return out.select("user", r("tx_count").alias("tx_count"), r("mean_amount", 5).alias("mean_amount"))


@query("g07_reverse_edges", S("""SELECT "user" AS src, merchant AS dst, CAST(0 AS BIGINT) AS reverse FROM tx
    UNION ALL SELECT merchant, "user", 1 FROM tx""", "tx"))
def g07(spark, sf):
    edges = tx_events(spark, sf).select(F.col("user").alias("src"), F.col("merchant").alias("dst"))
    return graph.with_reverse(edges).select("src", "dst", big("reverse").alias("reverse"))


@query("g08_neighbour_means", S("""SELECT merchant, round(avg(n), 6) AS n1, round(avg(a), 6) AS a1 FROM tx JOIN
    (SELECT "user" AS u, count(*) AS n, avg(amount) AS a FROM tx GROUP BY 1) ON u = "user" GROUP BY 1""", "tx"))
def g08(spark, sf):
    df = tx_events(spark, sf)
    users = df.groupBy("user").agg(F.count("*").alias("n"), F.avg("amount").alias("a"))
    out = graph.neighbour_means(df, users, ["n", "a"], "user", "merchant")
    return out.select("merchant", r("n").alias("n1"), r("a").alias("a1"))


@query("g08_two_hops", S("""SELECT "user", round(avg(a1), 6) AS a2 FROM tx JOIN (SELECT merchant AS m, avg(a) AS a1 FROM tx JOIN
    (SELECT "user" AS u, avg(amount) AS a FROM tx GROUP BY 1) ON u = "user" GROUP BY 1) ON m = merchant GROUP BY 1""", "tx"))
def g08b(spark, sf):
    df = tx_events(spark, sf)
    users = df.groupBy("user").agg(F.avg("amount").alias("a"))
    one = graph.neighbour_means(df, users, ["a"], "user", "merchant")
    return graph.neighbour_means(df, one, ["a"], "merchant", "user").select("user", r("a").alias("a2"))


@query("g08_fan_out_cap")
def g08c(spark, sf):
    return graph.cap_fan_out(tx_events(spark, sf), "merchant", 15, "tx_id").select("merchant", "tx_id")


@query("g08_fan_out_sizes", S("SELECT merchant, least(count(*), 15) AS edges FROM tx GROUP BY 1", "tx"))
def g08d(spark, sf):
    capped = graph.cap_fan_out(tx_events(spark, sf), "merchant", 15, "tx_id")
    return capped.groupBy("merchant").agg(F.count("*").alias("edges"))
