"""Chronological splits, recent slices and partitions of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txflow.operators.encode import dense_index
from txflow.operators.history import HOT_ROWS, KeyTotals, PriorCount, prior
from txflow.operators.joining import same, with_row
from txflow.operators.ordered import percentiles


def chrono_split(df: DataFrame, user: str = "user", frac: float = 0.8, ts: str = "ts", tx: str = "tx_id",
                 hot_rows: int = HOT_ROWS, measure: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Add ``split``: the first floor(n * frac) rows of every user are 'train'."""
    ranked = prior(df, user, [PriorCount("_rank"), KeyTotals(total="_rows")], ts=ts, tx=tx, hot_rows=hot_rows, measure=measure, dealt=dealt)
    cutoff = F.floor(F.col("_rows") * F.lit(float(frac)))
    return ranked.withColumn("split", F.when(F.col("_rank") < cutoff, "train").otherwise("test")).drop("_rank", "_rows")


def leaks(df: DataFrame, user: str = "user", ts: str = "ts", tx: str = "tx_id") -> DataFrame:
    """Users whose last training row is not before their first test row (should be none)."""
    at = F.struct(ts, tx)
    ends = df.groupBy(user).agg(
        F.max(F.when(F.col("split") == "train", at)).alias("last_train"),
        F.min(F.when(F.col("split") == "test", at)).alias("first_test"),
    )
    return ends.filter(F.col("last_train") >= F.col("first_test"))


def mismatches(a: DataFrame, b: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Rows present on one side only, or with different ``compare`` values."""
    l, r = a.select(key, *compare).alias("l"), b.select(key, *compare).alias("r")
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer").filter(
        F.col(f"l.{key}").isNull() | F.col(f"r.{key}").isNull() | differs
    )


def recent_slice(df: DataFrame, fraction: float = 0.2, ts: str = "ts") -> DataFrame:
    """The most recent ``fraction`` of the rows, by time."""
    at = df.select(F.unix_micros(ts).alias("at"))
    cutoff = percentiles(at, "at", [1 - fraction]).select(F.col("pcts")[0].alias("_cutoff"))
    return with_row(df, cutoff).filter(F.unix_micros(ts) > F.col("_cutoff")).drop("_cutoff")


def banks(df: DataFrame, user: str = "user", size: int = 150, count: int | None = None) -> DataFrame:
    """Add ``bank``: users in sorted order, ``size`` users to a bank, or ``count`` banks of equal size."""
    ranks = dense_index(df, user, "_rank")
    if count:
        ranks = with_row(ranks, ranks.agg(F.count("*").alias("_users")))
        bank = F.floor(F.col("_rank") * count / F.col("_users"))
        # Banks are ranges of users: ``count`` values tell them, the rows are not shuffled to meet their user's rank.
        first = sorted(ranks.groupBy(bank.alias("bank")).agg(F.min(user).alias("user")).collect())
        begun = F.size(F.filter(F.array(*[F.lit(f["user"]) for f in first]), lambda u: u <= F.col(user))) if first else F.lit(0)
        numbers = F.array(*[F.lit(f["bank"]).cast("bigint") for f in first]) if first else F.array(F.lit(None).cast("bigint"))
        return df.withColumn("bank", F.when(F.col(user).isNotNull(), F.get(numbers, begun - 1)))
    bank = F.floor(F.col("_rank") / size)
    return same(df, ranks.select(user, bank.alias("bank")), [user], "left")


def first_success(df: DataFrame, row: str, attempt: str, success: str) -> DataFrame:
    """The earliest successful attempt of every row; min over a struct, no sort per row."""
    cols = [c for c in df.columns if c not in (row, attempt)]
    first = F.min_by(F.struct(attempt, *cols), F.col(attempt)).alias("_f")
    return df.filter(F.col(success)).groupBy(row).agg(first).select(row, "_f.*")
