"""Fixed-length sequences of the latest rows of a user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txflow.operators.history import GROUP, HOT_ROWS, SLICE, Order, PriorCount, _carry, deal, measured, split_heavy
from txflow.schema import BASE_COLUMNS, WINDOW


def build_windows(df: DataFrame, cols: Sequence[str] = BASE_COLUMNS, keys: Sequence[str] = ("user", "split"),
                  size: int = WINDOW, stride: int = 1, ts: str = "ts", tx: str = "tx_id",
                  hot_rows: int = HOT_ROWS, measure: DataFrame | None = None, scanned: bool = True) -> DataFrame:
    """Add ``seq``: the row and the ``size - 1`` rows before it, oldest first.

    Rows with fewer predecessors are left out, so keys shorter than ``size`` vanish.
    A heavy key is cut into blocks of ``hot_rows`` rows; the last ``size - 1`` rows of
    a block also travel to the next one, so every sequence is complete in its block.
    ``measure`` and ``scanned`` are as in ``prior``.
    """
    order = Order(tuple(keys), ts, tx)
    block_rows = max(hot_rows, size)
    item = F.struct(*cols)
    rows, heavy = measured(df if measure is None else measure, keys, ts, hot_rows)
    cold, hot = split_heavy(df, keys, heavy, ts)
    spread = (ts, tx) if scanned else ()
    cold = deal(cold, rows, keys, hot_rows, spread)
    w = order.rows()
    out = cold.withColumns({
        "_at": F.row_number().over(w) - 1,
        "seq": F.collect_list(item).over(w.rowsBetween(1 - size, 0)),
    })
    if hot is not None:
        at = F.col("_at")
        ranked = _carry(deal(hot, rows, (GROUP, SLICE), hot_rows, spread), [PriorCount("_at")], Order((GROUP,), ts, tx)).drop(SLICE)
        home = F.floor(at / block_rows)
        halo = at % block_rows > block_rows - size
        placed = ranked.withColumn("_home", home).withColumn(
            "_block", F.explode(F.when(halo, F.array(home, home + 1)).otherwise(F.array(home)))
        )
        placed = deal(placed, rows, (GROUP, "_block"), hot_rows)
        block = Window.partitionBy(GROUP, "_block").orderBy("_at").rowsBetween(1 - size, 0)
        placed = placed.withColumn("seq", F.collect_list(item).over(block)).filter("_block = _home")
        out = out.unionByName(placed.select(*out.columns))
    keep = (F.size("seq") == size) & ((F.col("_at") - (size - 1)) % stride == 0)
    return out.filter(keep).drop("_at")


def flatten_window(seq: str = "seq", cols: Sequence[str] = BASE_COLUMNS) -> Column:
    """One array, all steps of the first column, then of the second, and so on."""
    def steps(name: str) -> Column:
        return F.transform(seq, lambda x: x.getField(name).cast("double"))

    return F.flatten(F.array(*[steps(c) for c in cols]))


def serving_vector(position: str = "user_tx_count", seq: str = "seq", cols: Sequence[str] = BASE_COLUMNS,
                   extra: Sequence[str] = (), size: int = WINDOW) -> Column:
    """Flat model input of one row, NULL while its history is too short."""
    flat = F.concat(flatten_window(seq, cols), F.array(*[F.col(c).cast("double") for c in extra]))
    return F.when((F.col(position) >= size - 1) & (F.size(seq) == size), flat)


def count_windows(df: DataFrame, user: str = "user", size: int = WINDOW) -> DataFrame:
    """(windows, users, users_skipped, rows_dropped) without building any window."""
    n = F.col("n")
    return df.groupBy(user).agg(F.count("*").alias("n")).agg(
        F.sum(F.greatest(n - size + 1, F.lit(0))).alias("windows"),
        F.count("*").alias("users"),
        F.count_if(n < size).alias("users_skipped"),
        F.sum(F.when(n < size, n).otherwise(0)).alias("rows_dropped"),
    )
