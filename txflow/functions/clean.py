"""Column expressions that type and clean raw transaction fields."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txflow.schema import CHANNEL_VALUES, ERROR_TYPES, ONLINE, ONLINE_CITY

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_amount(text: ColumnOrName) -> Column:
    """'$1,077.05' or '$-500.00' as a double."""
    return F.replace(F.ltrim(_c(text), F.lit("$")), F.lit(","), F.lit("")).cast("double")


def signed_log1p(x: ColumnOrName) -> Column:
    return F.signum(_c(x)) * F.log1p(F.abs(_c(x)))


def build_timestamp(year: ColumnOrName, month: ColumnOrName, day: ColumnOrName, time: ColumnOrName) -> Column:
    clock = F.split(_c(time), ":", 2)
    part = lambda c: _c(c).cast("int")
    return F.make_timestamp(
        part(year), part(month), part(day), clock[0].cast("int"), clock[1].cast("int"), F.lit(0).cast("decimal(8,6)")
    )


def label_flag(text: ColumnOrName, positive: str = "Yes") -> Column:
    return (_c(text) == positive).cast("int")


def clean_zip(zip_code: ColumnOrName, channel: ColumnOrName) -> Column:
    z = F.regexp_replace(_c(zip_code), r"\.0$", "")
    return F.when(z != "", z).when(_c(channel) == ONLINE, "00000").otherwise("MISSING")


def clean_state(state: ColumnOrName, channel: ColumnOrName) -> Column:
    return F.when((_c(state) == "") & (_c(channel) == ONLINE), "ONLINE").otherwise(_c(state))


def clean_city(city: ColumnOrName, channel: ColumnOrName) -> Column:
    """Online rows always carry the city sentinel, whatever the message says."""
    return F.when(_c(channel) == ONLINE, ONLINE_CITY).otherwise(_c(city))


def error_flags(errors: ColumnOrName, kinds: Sequence[str] = ERROR_TYPES) -> dict[str, Column]:
    """One 0/1 column per known error in a comma-separated text."""
    text = F.coalesce(_c(errors), F.lit(""))
    return {"err_" + k: F.contains(text, F.lit(k)).cast("int") for k in kinds}


def error_flags_from_list(errors: ColumnOrName, kinds: Sequence[str] = ERROR_TYPES) -> dict[str, Column]:
    """The same for an array of error names."""
    return {"err_" + k: F.coalesce(F.array_contains(_c(errors), k), F.lit(False)).cast("int") for k in kinds}


def one_hot(c: ColumnOrName, values: Sequence[str] = CHANNEL_VALUES, prefix: str = "chip_") -> dict[str, Column]:
    return {prefix + v: F.coalesce(_c(c) == v, F.lit(False)).cast("int") for v in values}


def calendar(ts: ColumnOrName) -> dict[str, Column]:
    t = _c(ts)
    return {"hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t)}


def seasonal(ts: ColumnOrName) -> dict[str, Column]:
    t = _c(ts)
    return {
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
        "is_holiday_season": F.month(t).isin(11, 12).cast("int"),
        "day_of_year": F.dayofyear(t),
    }


def composite_key(*cols: ColumnOrName, sep: str = "|") -> Column:
    """Text key; a NULL part counts as empty."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols])


def safe_ratio(num: ColumnOrName, den: ColumnOrName, eps: float = 1e-8) -> Column:
    """num/den, NULL where |den| <= eps."""
    return F.when(F.abs(_c(den)) > eps, _c(num) / _c(den))


def missing_count(cols: Iterable[str]) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c).isNull().cast("int")
    return total


def nan_to_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Floating NaN becomes NULL, so that comparisons treat it as unknown."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def fill_missing(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def zero_out(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Ablation variant: the named feature group set to zero."""
    return df.withColumns({c: F.lit(0.0) for c in cols})


def mask_id(c: ColumnOrName) -> Column:
    return F.concat(F.lit("••••"), F.right(_c(c).cast("string"), F.lit(4)))


def bin_index(x: ColumnOrName, edges: Sequence[float]) -> Column:
    """Index of the right-open bin, 0 below the second edge; outer edges are open."""
    inner = list(edges)[1:-1]
    index = F.lit(0)
    for e in inner:
        index = index + (_c(x) >= F.lit(float(e))).cast("int")
    return index


def bin_in(x: ColumnOrName, edges: ColumnOrName) -> Column:
    """The same with the inner edges in an array column."""
    return F.size(F.filter(_c(edges), lambda e: e <= _c(x)))
