"""Aggregate reports over transactions, features and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txflow.functions.decide import segment
from txflow.operators.history import HOT_ROWS, Previous, prior
from txflow.operators.joining import with_row
from txflow.operators.ordered import percentiles

# Inclusive history-depth buckets; the last one is open.
DEPTH_BUCKETS = ((0, 9), (10, 49), (50, 99), (100, 199), (200, 499), (500, 999), (1000, None))


def ratio(a, b) -> Column:
    """a / b, NULL when b is 0."""
    b = F.col(b) if isinstance(b, str) else b
    return (F.col(a) if isinstance(a, str) else a) / F.when(b != 0, b)


def positives(label: str = "label") -> Column:
    return F.sum(F.col(label).cast("bigint"))


def label_balance(df: DataFrame, *groups: str, label: str = "label") -> DataFrame:
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"), positives(label).alias("positives"), F.avg(label).alias("rate")
    )


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), name: str = "feature") -> DataFrame:
    """One row per (row, feature) with ``value`` as double; one pass over the table."""
    items = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*keep, F.explode(items).alias("_e")).select(*keep, f"_e.{name}", "_e.value")


def wide_to_rows(row: DataFrame, cols: Sequence[str], stats: Sequence[str], name: str = "feature") -> DataFrame:
    """Turn one row of ``<i>_<stat>`` columns into one row per column name."""
    items = F.array(*[
        F.struct(F.lit(c).alias(name), *[F.col(f"{i}_{s}").alias(s) for s in stats]) for i, c in enumerate(cols)
    ])
    return row.select(F.explode(items).alias("_e")).select("_e.*")


def column_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, mean, std, min, max, nulls, null_pct): one aggregate row, then unpivoted.

    The table itself is not exploded, so the shuffle carries one partial row per task.
    """
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"{i}_mean"), F.stddev_samp(v).alias(f"{i}_std"), F.min(v).alias(f"{i}_min"),
                 F.max(v).alias(f"{i}_max"), F.count_if(v.isNull()).alias(f"{i}_nulls"),
                 (F.count_if(v.isNull()) * 100 / F.count("*")).alias(f"{i}_null_pct")]
    return wide_to_rows(df.agg(*aggs), cols, ("mean", "std", "min", "max", "nulls", "null_pct"))


def flag_lift(df: DataFrame, flags: Sequence[str], label: str = "label") -> DataFrame:
    """How often each flag fires and how much more often positives are among its rows."""
    y = F.col(label).cast("bigint")
    aggs = [F.count("*").alias("_n"), F.sum(y).alias("_p")]
    for i, f in enumerate(flags):
        on = F.col(f) == 1
        aggs += [F.count_if(on).alias(f"{i}_fires"), F.sum(F.when(on, y).otherwise(0)).alias(f"{i}_positives"),
                 F.count_if(F.col(f).isNull()).alias(f"{i}_nulls")]
    row = df.agg(*aggs)
    items = F.array(*[
        F.struct(F.lit(f).alias("flag"), *[F.col(f"{i}_{s}").alias(s) for s in ("fires", "positives", "nulls")])
        for i, f in enumerate(flags)
    ])
    out = row.select("_n", "_p", F.explode(items).alias("_e")).select("_n", "_p", "_e.*")
    precision = ratio("positives", "fires")
    return out.select(
        "flag", "fires", (F.col("fires") * 100 / F.col("_n")).alias("fire_pct"), "positives",
        precision.alias("precision"), (precision / ratio("_p", "_n")).alias("lift"),
        ratio("positives", "_p").alias("coverage"), "nulls",
    )


def entity_stats(df: DataFrame, key: str, amount: str = "amount", label: str = "label") -> DataFrame:
    """Rows, positives, rate, mean and sample deviation (0 for one row) of an entity."""
    return df.groupBy(key).agg(
        F.count("*").alias("tx_count"), positives(label).alias("fraud_count"), F.avg(label).alias("fraud_rate"),
        F.avg(amount).alias("mean_amount"), F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias("std_amount"),
    )


def segment_table(df: DataFrame, position: str = "user_tx_count", split: str = "split", label: str = "label") -> DataFrame:
    return label_balance(df.withColumn("segment", segment(position)), split, "segment", label=label)


def depth_bucket(position: str, buckets=DEPTH_BUCKETS) -> Column:
    p, out = F.col(position), None
    for lo, hi in buckets:
        hit = (p >= lo) if hi is None else (p >= lo) & (p <= hi)
        out = F.when(hit, _bucket_name(lo, hi)) if out is None else out.when(hit, _bucket_name(lo, hi))
    return out


def _bucket_name(lo: int, hi: int | None) -> str:
    return f"{lo}+" if hi is None else f"{lo}-{hi}"


def depth_table(df: DataFrame, position: str = "user_tx_count", label: str = "label", buckets=DEPTH_BUCKETS) -> DataFrame:
    """One row per bucket, also for buckets without rows."""
    got = label_balance(df.withColumn("bucket", depth_bucket(position, buckets)), "bucket", label=label)
    names = df.sparkSession.createDataFrame([(_bucket_name(lo, hi),) for lo, hi in buckets], "bucket string")
    return names.join(got, "bucket", "left").select(
        "bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "positives", "rate")]
    )


def earliest_positive(df: DataFrame, user: str = "user", position: str = "user_tx_count", label: str = "label") -> DataFrame:
    """Quantiles over users of the position of their first positive row."""
    first = df.filter(F.col(label) == 1).groupBy(user).agg(F.min(position).alias("pos"))
    q = percentiles(first, "pos", [0.0, 0.25, 0.5, 0.75]).select(
        *[F.col("pcts")[i].alias(n) for i, n in enumerate(("earliest", "p25", "median", "p75"))]
    )
    return with_row(q, first.agg(F.count("*").alias("users_with_positives")))


def segment_contrast(df: DataFrame, cols: Sequence[str], a: Column, b: Column) -> DataFrame:
    """(feature, rate_a, rate_b, ratio, null_pct_a, null_pct_b) for two row masks."""
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        for s, mask in (("a", a), ("b", b)):
            n = F.count_if(mask)
            aggs += [F.avg(F.when(mask, v)).alias(f"{i}_rate_{s}"),
                     (F.count_if(mask & v.isNull()) * 100 / F.when(n > 0, n)).alias(f"{i}_null_pct_{s}")]
    rows = wide_to_rows(df.agg(*aggs), cols, ("rate_a", "rate_b", "null_pct_a", "null_pct_b"))
    return rows.withColumn("ratio", F.col("rate_a") / F.greatest(F.col("rate_b"), F.lit(1e-9)))


def slice_confusion(df: DataFrame, slices: dict[str, Column], pred: Column, label: str = "label", *groups: str) -> DataFrame:
    """Confusion counts and false-positive rate of every slice, in one aggregate."""
    y = F.col(label) == 1
    aggs, stats = [], ("n", "tp", "fp", "fn", "tn")
    for i, m in enumerate(slices.values()):
        aggs += [F.count_if(m).alias(f"{i}_n"), F.count_if(m & pred & y).alias(f"{i}_tp"),
                 F.count_if(m & pred & ~y).alias(f"{i}_fp"), F.count_if(m & ~pred & y).alias(f"{i}_fn"),
                 F.count_if(m & ~pred & ~y).alias(f"{i}_tn")]
    row = df.groupBy(*groups).agg(*aggs)
    items = F.array(*[
        F.struct(F.lit(s).alias("slice"), *[F.col(f"{i}_{k}").alias(k) for k in stats]) for i, s in enumerate(slices)
    ])
    out = row.select(*groups, F.explode(items).alias("_e")).select(*groups, "_e.*")
    return out.withColumn("fp_rate", ratio("fp", F.col("fp") + F.col("tn")))


def decision_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("decision", "rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "decision", "rule")


def per_minute(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Verdicts per minute and decision; the same call serves a stream."""
    return df.groupBy(F.window(ts, "1 minute").alias("w"), "decision").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("minute"), "decision", "n"
    )


def correlations(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(pair, r): Pearson correlation of each named column pair, rows with both values."""
    names = list(pairs)
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}_r")
                   for i, (a, b) in enumerate(pairs.values())])
    return wide_to_rows(row, names, ("r",), "pair")


def most_correlated(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """The column with the largest |r| against ``target``."""
    table = correlations(df, {c: (target, c) for c in cols})
    return table.filter("r is not null").orderBy(F.desc(F.abs("r")), "pair").limit(1)


def constant_values(df: DataFrame, indicator: str, value: str, tol: float = 1e-9) -> DataFrame:
    """Mean, deviation and count of ``value`` per indicator, and whether it is constant there."""
    return df.groupBy(indicator).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    ).withColumn("is_constant", (F.coalesce("std", F.lit(0.0)) <= tol).cast("int"))


def class_weight(df: DataFrame, label: str = "label", *groups: str) -> DataFrame:
    """negatives / positives, 1.0 without positives."""
    p, n = positives(label), F.count("*")
    return df.groupBy(*groups).agg(F.when(p > 0, (n - p) / F.when(p > 0, p)).otherwise(F.lit(1.0)).alias("weight"))


def edge_density(df: DataFrame, a: str, b: str, label: str = "label") -> DataFrame:
    """Share of possible (a, b) pairs that occur, and the positive rate of the edges."""
    pairs = df.groupBy(a, b).agg(F.count("*").alias("n"), positives(label).alias("p"))
    return pairs.agg(
        F.sum("n").alias("edges"), F.count("*").alias("pairs"), F.count_distinct(a).alias("left_nodes"),
        F.count_distinct(b).alias("right_nodes"), (F.sum("p") / F.sum("n")).alias("edge_rate"),
    ).withColumn("density", F.col("edges") / (F.col("left_nodes") * F.col("right_nodes")))


def history_table(df: DataFrame, user: str = "user", amount: str = "amount", ts: str = "ts") -> DataFrame:
    """Per-user scalar state after all rows."""
    return df.groupBy(user).agg(
        F.count("*").alias("tx_count"), F.sum(amount).alias("amount_sum"),
        F.sum(F.col(amount) * F.col(amount)).alias("amount_sq_sum"), F.max(amount).alias("amount_max"),
        F.max(ts).alias("last_ts"), F.min(ts).alias("first_ts"),
    )


def history_visits(df: DataFrame, user: str = "user", kinds: Sequence[str] = ("merchant", "mcc", "channel")) -> DataFrame:
    """(user, kind, value, n): visit counts in long form, so no user's map is held in one row."""
    items = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds])
    return df.select(user, F.explode(items).alias("e")).groupBy(user, "e.kind", "e.value").agg(F.count("*").alias("n"))


def monthly_means(df: DataFrame, user: str = "user", amount: str = "amount", ts: str = "ts") -> DataFrame:
    return df.groupBy(user, F.year(ts).alias("year"), F.month(ts).alias("month")).agg(
        F.sum(amount).alias("total"), F.count(amount).alias("n"), F.avg(amount).alias("mean")
    )


def top_n(df: DataFrame, by: Column, n: int, *ties: str) -> DataFrame:
    return df.orderBy(by, *ties).limit(n)


def last_rows(df: DataFrame, n: int = 9, cols: Sequence[str] = ("tx_id", "amount"), user: str = "user", ts: str = "ts",
              tx: str = "tx_id") -> DataFrame:
    """(user, recent): the newest ``n`` rows, oldest first.

    The row_number filter is pushed below the exchange (WindowGroupLimit), so a map
    task sends at most ``n`` rows of a user, however many it has.
    """
    w = Window.partitionBy(user).orderBy(F.desc(ts), F.desc(tx))
    newest = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    item = F.struct((-F.col("_rn")).alias("at"), *cols)
    return newest.groupBy(user).agg(F.array_sort(F.collect_list(item)).alias("recent"))


def gap_moments(df: DataFrame, user: str = "user", ts: str = "ts", tx: str = "tx_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(user, gap_n, gap_mean, gap_std) in days between consecutive rows."""
    gaps = prior(df, user, [Previous("_p")], ts=ts, tx=tx, hot_rows=hot_rows)
    days = (F.unix_micros(ts) - F.unix_micros("_p")) / 864e8
    return gaps.withColumn("_g", days).groupBy(user).agg(
        F.count("_g").alias("gap_n"), F.avg("_g").alias("gap_mean"), F.stddev_samp("_g").alias("gap_std")
    )


def user_state(df: DataFrame, user: str = "user", **cols) -> DataFrame:
    """Scalar state, gap moments and the last nine rows of every user."""
    ts, tx, amount = cols.get("ts", "ts"), cols.get("tx", "tx_id"), cols.get("amount", "amount")
    state = history_table(df, user, amount, ts)
    state = state.join(gap_moments(df, user, ts, tx), user)
    return state.join(last_rows(df, 9, (tx, amount), user, ts, tx), user)
