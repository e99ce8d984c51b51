"""Joins used all over the library."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str) -> DataFrame:
    """Equi-join that matches NULL keys too and keeps the left columns.

    Columns with a leading underscore are the library's own and never NULL; they are
    compared plainly, so that a join can reuse the partitioning of a window before it.
    """
    right = right.select(*[F.col(c).alias("_j_" + c) if c in cols else F.col(c) for c in right.columns])
    pairs = [(left[c], right["_j_" + c], c.startswith("_")) for c in cols]
    on = reduce(lambda a, b: a & b, [a == b if own else a.eqNullSafe(b) for a, b, own in pairs])
    joined = left.join(right, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*["_j_" + c for c in cols])


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row.

    A scalar subquery: evaluated once, no join, and an error if there is a second row.
    """
    value = row.select(F.struct(*row.columns)).scalar()
    return df.withColumn("_row", value).select(*df.columns, "_row.*")
