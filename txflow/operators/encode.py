"""Encoders and scalers kept as small tables fitted on the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txflow.operators.joining import same, with_row
from txflow.session import cut


def frequency_table(train: DataFrame, col: str) -> DataFrame:
    """(value, code): ln(1 + number of training rows with the value)."""
    return train.groupBy(F.col(col).alias("value")).agg(F.log1p(F.count("*")).alias("code"))


def dense_index(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """(col, out): each distinct non-NULL value with its rank in sorted order, from 0.

    Values are dealt out by range and numbered inside their partition; the partitions' sizes,
    one row each, are added up. No task sorts all values, whatever they have in common.
    """
    values = df.filter(F.col(col).isNotNull()).select(col).distinct()
    placed = cut(values.repartitionByRange(col).sortWithinPartitions(col).withColumn("_id", F.monotonically_increasing_id()))
    tagged = placed.select(col, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return tagged.join(offsets, "_part").select(col, (F.col("_off") + F.col("_at")).cast("bigint").alias(out))


def label_table(train: DataFrame, col: str) -> DataFrame:
    """(value, code): rank of the value among the sorted training values."""
    return dense_index(train, col).withColumnRenamed(col, "value")


def apply_codes(df: DataFrame, codes: DataFrame, col: str, out: str) -> DataFrame:
    """Look codes up; a value unseen in training gets 0.

    No broadcast hint: the code table grows with the data, so AQE decides by its
    measured size, and splits a skewed value when it has to shuffle.
    """
    table = codes.select(F.col("value").alias(col), F.col("code").alias("_code"))
    return same(df, table, [col], "left").withColumn(out, F.coalesce("_code", F.lit(0))).drop("_code")


def scaler_stats(train: DataFrame, cols: Sequence[str], sample: bool = False, min_std: float = 0.0) -> DataFrame:
    """One row with m_<i> and s_<i>; a zero deviation becomes 1 (or is floored at ``min_std``)."""
    spread = F.stddev_samp if sample else F.stddev_pop
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m_{i}"), spread(c).alias(f"_s_{i}")]
    stats = train.agg(*aggs)

    def usable(s: Column) -> Column:
        return F.greatest(s, F.lit(min_std)) if min_std else F.when(s > 0, s).otherwise(F.lit(1.0))

    return stats.select(
        *[f"m_{i}" for i in range(len(cols))],
        *[usable(F.col(f"_s_{i}")).alias(f"s_{i}") for i in range(len(cols))],
    )


def scale(df: DataFrame, stats: DataFrame, cols: Sequence[str], inverse: bool = False) -> DataFrame:
    """(x - mean) / std, or back; ``stats`` is one row."""
    out = with_row(df, stats)
    done = {}
    for i, c in enumerate(cols):
        m, s = F.col(f"m_{i}"), F.col(f"s_{i}")
        done[c] = F.col(c) * s + m if inverse else (F.col(c) - m) / s
    return out.withColumns(done).select(*df.columns)


def fit_encoders(train: DataFrame, frequency: Sequence[str], label: Sequence[str]) -> dict[str, DataFrame]:
    """Column -> code table, ready to be saved and looked up."""
    return {**{c: frequency_table(train, c) for c in frequency}, **{c: label_table(train, c) for c in label}}


def encode(df: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    for c, t in codes.items():
        df = apply_codes(df, t, c, c)
    return df
