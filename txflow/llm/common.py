"""Helpers shared by the operators: row identity, Arrow columns, byte buffers and hashes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from txflow.session import cut

WORD_SPLIT = " \t\n\x0b\x0c\r"  # the six characters outside [^\x20\x09-\x0D]

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def numbered(df: DataFrame, row: str = "_row") -> DataFrame:
    """``df`` with a row id, so that repeated rows and repeated ids stay apart.

    The id is made of the partition and the place in it. Scans of a table give the same
    one each time they run; an input that is computed should be written first.
    """
    return df.withColumn(row, F.monotonically_increasing_id())


def filled(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def packed(df: DataFrame, *without: str) -> tuple[Column, dict[str, Column]]:
    """The columns of ``df`` as one struct ``_rest``, and columns that take them out again under their names.

    Beside it an operator can name its own columns freely, whatever the table's are called.
    """
    names = [c for c in df.columns if c not in without]
    held = F.struct(F.lit(0).alias("k"), *[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)]).alias("_rest")
    return held, {c: F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(names)}


def held_out(key: str = "doc_id") -> Column:
    """True for the quarter of ids whose crc32 is 2 modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sampled(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """About ``rows`` rows, all if there are fewer: those with the lowest hashes of ``cols``."""
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * (1 << 40))
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), *cols), F.lit(1 << 40)) < share)


def slices(b: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose ``column`` holds about ``limit`` bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    group = (np.cumsum(sizes) - sizes) // limit
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(sizes)], strict=True):
        yield b.slice(start, end - start)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** i modulo 2**64 for i < n."""
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits evenly (the finaliser of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class PrefixHash:
    """Polynomial hashes of all substrings of a buffer, each from two prefix sums."""

    _power = powers(1)
    _inverse = powers(1)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if n > len(PrefixHash._power):
            size = max(n, 1 << 16)
            PrefixHash._power, PrefixHash._inverse = powers(size), powers(size, INVERSE)
        self.sums = np.zeros(n, U64)
        np.cumsum((data.astype(U64) + U64(1)) * PrefixHash._power[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * PrefixHash._inverse[start]

    def every(self, length: int) -> np.ndarray:
        """Of all substrings of one length, by start."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * PrefixHash._inverse[:n]


def single_threaded() -> None:
    """Spark already runs one task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def with_struct(df: DataFrame, out: str, fields: T.StructType, compute: Callable[[list], list[list]], column: str = "text") -> DataFrame:
    """``df`` and a struct column of what ``compute`` gives, field by field, for a list of values of ``column``.

    A column of the table that is called ``out`` already gives way.
    """
    df = df.drop(out)
    kinds = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, column):
                found = compute(b.column(column).to_pylist())
                own = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(found, kinds, strict=True)], fields=list(kinds))
                yield pa.RecordBatch.from_arrays([*b.columns, own], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, fields)]))


def prefixed(df: DataFrame, order: list[Column], amount: str) -> DataFrame:
    """``df``, range-sorted by ``order`` and written, with ``_before``: the sum of ``amount`` (long) over all rows before.

    Two passes: every task adds up inside its range, then one row per range holds its total, and the
    prefix sums of these are the ranges' starts. Rows that are equal in ``order`` stand in any order.
    """
    names = [f"_order{i}" for i in range(len(order))]
    ranged = df.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)])
    # Grouped by the planner's ranges; the order keys go before the rows are written.
    ranged = ranged.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, part = 0, TaskContext.get().partitionId()
        for b in batches:
            own = b.column(amount).to_numpy(zero_copy_only=False)
            before = place + np.cumsum(own) - own
            place += int(own.sum())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(own), part, np.int64)), pa.array(before, pa.int64())], names=[*b.schema.names, "_part", "_inside"])

    fields = [T.StructField("_part", T.LongType()), T.StructField("_inside", T.LongType())]
    placed = cut(ranged.mapInArrow(run, T.StructType([*ranged.schema.fields, *fields])))
    totals = placed.groupBy("_part").agg(F.sum(amount).alias("_total"))  # one row per range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(totals.select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start")))
    return placed.join(starts, "_part").select(*df.columns, (F.col("_start") + F.col("_inside")).alias("_before"))
