"""The 33 history features and the clean table they join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txflow.functions import clean as c
from txflow.operators.history import (
    HOT_ROWS, KeyTotals, LastYearMean, Moments, Previous, PriorCount, Trailing, prior,
)

DAY = 86_400
LARGE_AMOUNT = 200.0


def typed_transactions(raw: DataFrame) -> DataFrame:
    """Raw text rows, stored or streamed -> typed rows with the base columns that need no other row."""
    typed = raw.withColumns({
        "ts": c.build_timestamp("Year", "Month", "Day", "Time"),
        "amount_raw": c.parse_amount("Amount"),
        "label": c.label_flag("Is Fraud?"),
        "Zip": c.clean_zip("Zip", "Use Chip"),
        "Merchant State": c.clean_state("Merchant State", "Use Chip"),
    }).drop("Year", "Month", "Day", "Time", "Amount", "Is Fraud?")  # "Month" would hide "month"
    return typed.withColumns({
        "amount_log": c.signed_log1p("amount_raw"),
        **c.error_flags("Errors?"), **c.calendar("ts"), **c.one_hot("Use Chip"),
    })


def clean_transactions(raw: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Raw text rows -> typed rows with the 21 base columns before encoding."""
    typed = typed_transactions(raw)
    gaps = prior(typed, "User", [Previous("_previous")], hot_rows=hot_rows)
    hours = (F.unix_micros("ts") - F.unix_micros("_previous")) / 3.6e9
    return gaps.withColumn("hours_since_last", F.coalesce(hours, F.lit(0.0))).drop(
        "_previous", "Errors?", "Use Chip", "Card"
    )


def user_features(df: DataFrame, user: str = "user", amount: str = "amount", merchant: str = "merchant",
                  mcc: str = "mcc", channel: str = "channel", city: str = "city", state: str = "state",
                  ts: str = "ts", tx: str = "tx_id", hot_rows: int = HOT_ROWS, dealt: bool = False,
                  measure: DataFrame | None = None) -> DataFrame:
    """Amount history, familiarity, year-over-year, novelty and dormancy of each user."""
    place = "_place"
    a, t = F.col(amount), F.col(ts)
    keyed = df.withColumn(place, c.composite_key(city, state))
    gap = lambda d: d.withColumn(
        "days_since_last_tx", (F.unix_micros(t) - F.unix_micros("_previous")) / (DAY * 1e6)
    )
    out = prior(
        keyed, user,
        [
            Moments(amount, mean="user_hist_mean", std="user_hist_std", max="user_hist_max"),
            PriorCount("user_tx_count"),
            PriorCount("merchant_user_count", (merchant,)),
            PriorCount("mcc_user_count", (mcc,)),
            PriorCount("_n_place", (place,)),
            PriorCount("_n_channel", (channel,)),
            Previous("_previous"),
            LastYearMean(amount, "same_month_last_year_mean"),
        ],
        gap,
        [Moments("days_since_last_tx", n="_gaps", mean="_gap_mean", std="_gap_std")],
        ts=ts, tx=tx, hot_rows=hot_rows, dealt=dealt, measure=measure,
    )
    top = F.col("user_hist_max")
    once = lambda n: (F.col(n) == 0).cast("int")
    over = lambda k: (a > k * top).cast("int")
    # Rows are in time order, so a row opens a period when the previous row lies in another one.
    opens = lambda unit: (
        F.coalesce(F.date_trunc(unit, "_previous") != F.date_trunc(unit, t), F.lit(True)).cast("int")
    )
    late = F.col("days_since_last_tx") > F.col("_gap_mean") + 2 * F.col("_gap_std")
    return out.withColumns({
        "user_amount_zscore": c.safe_ratio(a - F.col("user_hist_mean"), "user_hist_std", 0.0),
        "user_amount_to_max_ratio": c.safe_ratio(a, top),
        "is_new_merchant": once("merchant_user_count"),
        "amount_vs_last_year_ratio": c.safe_ratio(a, "same_month_last_year_mean"),
        **c.seasonal(ts),
        "is_largest_ever": over(1), "is_2x_hist_max": over(2), "is_5x_hist_max": over(5),
        "first_mcc": once("mcc_user_count"),
        "first_city_state": once("_n_place"),
        "first_channel": once("_n_channel"),
        "is_dormant": F.when(F.col("_gaps") >= 2, late.cast("int")),
        "first_tx_this_month": opens("month"),
        "first_tx_this_year": opens("year"),
    }).drop(place, "_n_place", "_n_channel", "_previous", "_gaps", "_gap_mean", "_gap_std")


def merchant_features(df: DataFrame, merchant: str = "merchant", amount: str = "amount", ts: str = "ts",
                      tx: str = "tx_id", hot_rows: int = HOT_ROWS, measure: DataFrame | None = None,
                      scanned: bool = True) -> DataFrame:
    """Volume and amount history of each merchant over all users."""
    big = df.withColumn("_large", (F.abs(F.col(amount)) > LARGE_AMOUNT).cast("double"))
    out = prior(
        big, merchant,
        [
            PriorCount("merch_tx_count"),
            Moments(amount, mean="merch_hist_amount_mean", std="_merch_std", sample=False),
            Moments("_large", mean="merch_large_tx_rate"),
            KeyTotals(first="_merch_first"),
            Trailing("merch_7d_count", "merch_tx_count", 7 * DAY),
        ],
        ts=ts, tx=tx, hot_rows=hot_rows, measure=measure, scanned=scanned,
    )
    days = (F.unix_micros(ts) - F.unix_micros("_merch_first")) / (DAY * 1e6)
    usual = 7 * F.col("merch_tx_count") / F.greatest(F.col("merch_days_active"), F.lit(1.0))
    return out.withColumn("merch_days_active", days).withColumns({
        "merch_spike_ratio": F.when(usual > 0.1, F.col("merch_7d_count") / usual),
        "merch_amount_deviation": c.safe_ratio(F.col(amount) - F.col("merch_hist_amount_mean"), "_merch_std"),
    }).drop("_large", "_merch_std", "_merch_first")


def daily_volume(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def population_volume(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(day, pop_prior_day_count, pop_7d_avg_count) for every calendar day of the table.

    One row per day, so the windows below run over a table as long as the calendar.
    """
    daily = daily_volume(df, ts)
    span = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    every = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    full = every.join(daily, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.orderBy("day")
    return full.select(
        "day",
        F.coalesce(F.lag("n").over(w), F.lit(0)).cast("bigint").alias("pop_prior_day_count"),
        (F.coalesce(F.sum("n").over(w.rowsBetween(-7, -1)), F.lit(0)) / F.least(F.lit(7), F.row_number().over(w)))
        .alias("pop_7d_avg_count"),
    )


def population_features(df: DataFrame, ts: str = "ts", measure: DataFrame | None = None) -> DataFrame:
    volume = F.broadcast(population_volume(df if measure is None else measure, ts))  # at most one row per calendar day
    return df.withColumn("day", F.to_date(ts)).join(volume, "day", "left").drop("day")


def enrich(df: DataFrame, hot_rows: int = HOT_ROWS, **cols) -> DataFrame:
    """All 33 history features: one exchange by user, one by merchant."""
    shared = {k: cols[k] for k in ("merchant", "amount", "ts", "tx") if k in cols}
    out = user_features(df, hot_rows=hot_rows, **cols)
    out = merchant_features(out, hot_rows=hot_rows, measure=df, scanned=False, **shared)
    return population_features(out, cols.get("ts", "ts"), measure=df)


def amount_history(df: DataFrame, user: str = "user", amount: str = "amount", ts: str = "ts", tx: str = "tx_id",
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Only the running count, mean, deviation and maximum of the user's prior amounts."""
    return prior(
        df, user,
        [Moments(amount, n="user_tx_count", mean="user_hist_mean", std="user_hist_std", max="user_hist_max")],
        ts=ts, tx=tx, hot_rows=hot_rows,
    )


def familiarity(df: DataFrame, user: str = "user", pairs: Sequence[tuple[str, Sequence[str]]] = (), ts: str = "ts",
                tx: str = "tx_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Earlier visits of the user per named column combination."""
    return prior(df, user, [PriorCount(name, tuple(by)) for name, by in pairs], ts=ts, tx=tx, hot_rows=hot_rows)
