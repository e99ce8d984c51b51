"""User / merchant / card tables, the ring check and neighbour features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txflow.functions.clean import composite_key, signed_log1p
from txflow.operators.encode import scale, scaler_stats
from txflow.operators.joining import with_row
from txflow.operators.ordered import percentiles
from txflow.operators.reports import entity_stats
from txflow.session import cut

LEAKY = ("fraud_count", "fraud_rate")


def node_tables(df: DataFrame, user: str = "user", merchant: str = "merchant", card: str = "card") -> dict[str, DataFrame]:
    """One table per node type; ``card`` is scoped per user."""
    keyed = df.withColumn("user_card", composite_key(user, card, sep="_"))
    reach = df.groupBy(merchant).agg(F.count_distinct(user).alias("unique_user_count"))
    return {
        "user": entity_stats(keyed, user),
        "merchant": entity_stats(keyed, merchant).join(reach, merchant),
        "card": entity_stats(keyed, "user_card"),
    }


def edge_tables(df: DataFrame, attributes: dict, user: str = "user", merchant: str = "merchant", card: str = "card",
                label: str = "label") -> dict[str, DataFrame]:
    """owns (distinct), transacts and used_at (one edge per row, with attributes)."""
    keyed = df.withColumn("user_card", composite_key(user, card, sep="_"))
    attrs = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in attributes.items()]
    ends = {"transacts": (user, merchant), "used_at": ("user_card", merchant)}
    out = {n: keyed.select(F.col(a).alias("src"), F.col(b).alias("dst"), *attrs, label) for n, (a, b) in ends.items()}
    out["owns"] = keyed.select(F.col(user).alias("src"), F.col("user_card").alias("dst")).dropDuplicates()
    return out


def default_attributes() -> dict:
    """The six edge attributes taken from cleaned amounts and history features."""
    return {
        "amount_log": signed_log1p("amount"), "hour": F.hour("ts"), "user_amount_zscore": F.col("user_amount_zscore"),
        "first_mcc": F.col("first_mcc"), "first_city_state": F.col("first_city_state"), "first_channel": F.col("first_channel"),
    }


def observed_positive_users(df: DataFrame, user: str = "user", merchant: str = "merchant", label: str = "label") -> DataFrame:
    return df.filter(F.col(label) == 1).groupBy(merchant).agg(F.count_distinct(user).alias("observed"))


def expected_positive_users(df: DataFrame, user: str = "user", merchant: str = "merchant", label: str = "label") -> DataFrame:
    """Distinct positive users a merchant would have if positives fell evenly on all visits."""
    rate = df.agg(F.avg(label).alias("_rate"))
    visits = with_row(df.groupBy(merchant, user).agg(F.count("*").alias("_n")), rate)
    chance = 1 - F.pow(1 - F.col("_rate"), F.col("_n"))
    return visits.groupBy(merchant).agg(F.sum(chance).alias("expected"))


def ring_table(df: DataFrame, user: str = "user", merchant: str = "merchant", label: str = "label") -> DataFrame:
    """Merchants with positives: observed and expected distinct users, excess, ratio, flag."""
    seen = observed_positive_users(df, user, merchant, label)
    out = seen.join(expected_positive_users(df, user, merchant, label), merchant, "left").fillna(0.0, ["expected"])
    excess = F.col("observed") - F.col("expected")
    times = F.col("observed") / F.greatest(F.col("expected"), F.lit(1e-9))
    return out.withColumns({"excess": excess, "ratio": times}).withColumn(
        "is_excess", ((F.col("excess") >= 2.0) & (F.col("ratio") >= 1.5)).cast("int")
    )


def ring_verdict(table: DataFrame) -> DataFrame:
    table = cut(table)
    median = percentiles(table, "ratio", [0.5]).select(F.col("pcts")[0].alias("median_ratio"))
    n = F.count("*")
    out = table.agg(
        n.alias("merchants"), F.max("observed").alias("max_users"), F.count_if(F.col("observed") >= 2).alias("multi_user"),
        F.sum("is_excess").alias("excess_merchants"), (F.sum("is_excess") * 100 / F.when(n > 0, n)).alias("excess_pct"),
        F.avg("ratio").alias("mean_ratio"),
    )
    pct = F.col("excess_pct")
    verdict = (
        F.when(F.col("merchants") == 0, "no_fraud_in_split").when(pct < 5, "no_evidence")
        .when(pct < 20, "weak_evidence").otherwise("notable_evidence")
    )
    return with_row(out, median).withColumn("verdict", verdict)


def strip_leaky(nodes: DataFrame) -> DataFrame:
    return nodes.drop(*LEAKY)


def normalize(train: DataFrame, other: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables scaled with the training mean and deviation (floored at 1e-6)."""
    stats = scaler_stats(train, cols, sample=True, min_std=1e-6)
    return scale(train, stats, cols), scale(other, stats, cols)


def with_reverse(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return edges.withColumn("reverse", F.lit(0)).unionByName(back.withColumn("reverse", F.lit(1)))


def cap_fan_out(edges: DataFrame, node: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``n`` edges per node, in hash order (the neighbour sample of the training loader)."""
    w = Window.partitionBy(node).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return edges.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def neighbour_means(edges: DataFrame, features: DataFrame, cols: Sequence[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """(dst, mean of the neighbours' features), each edge counted.

    Parallel edges are merged into a weight first: the join then has one row per
    distinct pair and the mean is combined map-side.
    """
    weights = edges.groupBy(src, dst).agg(F.count("*").alias("_w"))
    joined = weights.join(features.withColumnRenamed(features.columns[0], src), src)
    w = F.sum("_w")
    return joined.groupBy(dst).agg(*[(F.sum(F.col(c) * F.col("_w")) / w).alias(c) for c in cols])
