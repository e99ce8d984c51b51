"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txflow.functions import decide
from txflow.functions.clean import missing_count
from txflow.operators.features import user_features
from txflow.sources.tables import raw_events, scored, table, tx_events, tx_items, tx_orders  # noqa: F401

# Columns that are NULL without history; counted by the completeness component.
NULLABLE = (
    "user_hist_mean", "user_hist_std", "user_hist_max", "user_amount_zscore", "same_month_last_year_mean",
    "days_since_last_tx",
)


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded the way DuckDB rounds a double: scale, round half away from zero, scale back."""
    power = F.lit(10.0**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * power) / power


def rt(c: Column | str, digits: int = 6) -> Column:
    """For means of short decimals, which often lie exactly between two roundings."""
    return r((F.col(c) if isinstance(c, str) else c) + 1e-9, digits)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def history(spark: SparkSession, sf: str) -> DataFrame:
    return user_features(tx_events(spark, sf))


def scored_history(spark: SparkSession, sf: str) -> DataFrame:
    return scored(history(spark, sf)).withColumns(
        {k: v for k, v in decide.rare_slices().items()}
    ).withColumn("n_missing", missing_count(NULLABLE))


def confident(spark: SparkSession, sf: str) -> DataFrame:
    return scored_history(spark, sf).withColumn("c", decide.confidence_struct("score_a"))


def routed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows routed at thresholds inside the range of the closed-form score."""
    return confident(spark, sf).withColumn("conf", F.col("c.score")).withColumn(
        "v", decide.route("score_a", "conf", "user_tx_count", prob_block=0.7, conf_stepup=0.6)
    ).withColumns({"decision": F.col("v.decision"), "rule": F.col("v.rule")})


def model_long(df: DataFrame, scores: dict[str, str] | None = None) -> DataFrame:
    """One row per (row, model) with ``model`` and ``score``."""
    scores = scores or {"a": "score_a", "b": "score_b"}
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in scores.items()])
    rest = [c for c in df.columns if c not in scores.values()]
    return df.select(*rest, F.explode(pairs).alias("_e")).select(*rest, "_e.model", "_e.score")
