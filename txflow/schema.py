"""Column contracts. Order matters: it is the order of the model input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the raw format.
RAW_COLUMNS = (
    "User", "Card", "Year", "Month", "Day", "Time", "Amount", "Use Chip", "Merchant Name",
    "Merchant City", "Merchant State", "Zip", "MCC", "Errors?", "Is Fraud?",
)
ERROR_TYPES = (
    "Bad CVV", "Bad Card Number", "Bad Expiration", "Bad PIN", "Bad Zipcode",
    "Insufficient Balance", "Technical Glitch",
)
CHANNEL_VALUES = ("Chip Transaction", "Online Transaction", "Swipe Transaction")
ONLINE = "Online Transaction"
ONLINE_CITY = " ONLINE"

# Names and order of the model input and of the message fields, all that follows here.
BASE_COLUMNS = (
    "Merchant Name", "Merchant City", "Merchant State", "Zip", "MCC", "amount_raw", "amount_log",
    "hours_since_last", *["err_" + e for e in ERROR_TYPES], "hour", "day_of_week", "month",
    *["chip_" + c for c in CHANNEL_VALUES],
)
USER_FEATURES = (
    "user_hist_mean", "user_hist_std", "user_hist_max", "user_tx_count", "user_amount_zscore",
    "user_amount_to_max_ratio", "merchant_user_count", "mcc_user_count", "is_new_merchant",
    "same_month_last_year_mean", "amount_vs_last_year_ratio", "is_weekend", "is_holiday_season", "day_of_year",
)
MERCHANT_FEATURES = (
    "merch_tx_count", "merch_7d_count", "merch_spike_ratio", "merch_days_active", "merch_hist_amount_mean",
    "merch_amount_deviation", "merch_large_tx_rate", "pop_prior_day_count", "pop_7d_avg_count",
)
FLAGS = (
    "is_largest_ever", "is_2x_hist_max", "is_5x_hist_max", "first_mcc", "first_city_state", "first_channel",
    "days_since_last_tx", "is_dormant", "first_tx_this_month", "first_tx_this_year",
)
ENRICHED = USER_FEATURES + MERCHANT_FEATURES + FLAGS
FLAG_COLUMNS = tuple(f for f in FLAGS if f != "days_since_last_tx")
WINDOW = 10
N_FEATURES = WINDOW * len(BASE_COLUMNS) + len(ENRICHED)

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

MESSAGE_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("use_chip", T.StringType()),
    T.StructField("merchant_name", T.StringType()),
    T.StructField("merchant_city", T.StringType()),
    T.StructField("merchant_state", T.StringType()),
    T.StructField("zip_code", T.StringType()),
    T.StructField("mcc", T.StringType()),
    T.StructField("errors", T.ArrayType(T.StringType())),
])


def check_columns(columns: Sequence[str], required: Sequence[str], expected: Sequence[str] = ()) -> list[str]:
    """Raise if a required column is missing; return the expected ones that are."""
    missing = [c for c in required if c not in columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return [c for c in expected if c not in columns]


def assert_schema(df: DataFrame, required: Sequence[str], expected: Sequence[str] = ()) -> list[str]:
    return check_columns(df.columns, required, expected)


def column_order(df: DataFrame) -> list[str]:
    """The stored column order, read from the schema only (no job)."""
    return list(df.schema.names)


def slot_names(base: Sequence[str] = BASE_COLUMNS, size: int = WINDOW, extra: Sequence[str] = ENRICHED) -> list[str]:
    """Names of the flat model input: every base column oldest to newest, then the history features."""
    return [f"{c}_t{t}" for c in base for t in range(size)] + list(extra)
