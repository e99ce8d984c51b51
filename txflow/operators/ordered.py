"""Running totals, ranks and exact percentiles over a global order.

``Window.orderBy`` without partitions, and the ``percentile`` aggregate, pull a
whole column into one task. The functions here measure first. Orders too long for a task are cut into value ranges
at measured quantiles, so that every range has its own task and what lies before it arrives
as one small table; percentiles first narrow the search to a thin band of values
around each target, so that almost no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txflow.operators.joining import same, with_row
from txflow.session import cut

# Distinct values one task may order.
PART_ROWS = 4_000_000
# Rows of one value that are joined to its rank by a shuffle; they are narrow.
FREQUENT = 250_000
ACCURACY = 10_000
_PART = "_part"


def _parts(counts: DataFrame, value: str, groups: Sequence[str], part_rows: int) -> DataFrame | None:
    """Cut points of the groups too long for one task; None when there are none."""
    long = cut(counts.groupBy(*groups).agg(F.count("*").alias("_n")).filter(F.col("_n") > part_rows))
    most = long.agg(F.max("_n")).first()[0]
    if most is None:
        return None
    n = 1 + most // part_rows
    steps = F.array(*[F.lit(i / n) for i in range(1, n)])
    if groups:
        counts = same(counts, long.select(*groups), groups, "left_semi")
    # Written, so that every branch of the plan sees the same cut points.
    return cut(counts.groupBy(*groups).agg(
        F.array_distinct(F.percentile_approx(value, steps, max(ACCURACY, 10 * n))).alias("_cuts")
    ))


def running_totals(
    counts: DataFrame,
    value: str,
    sums: Mapping[str, str],
    groups: Sequence[str] = (),
    descending: bool = False,
    part_rows: int = PART_ROWS,
    rows: int | None = None,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``out = sum(column)`` over all rows up to and including this one.

    ``counts`` has one row per (groups, value). ``rows`` is an upper bound of its length
    if one is known; within ``part_rows`` no measuring is needed. Otherwise the counts are
    written once, since the measuring and both branches of the plan read them.
    ``totals`` adds ``out = sum(column)`` over the whole group.
    """
    groups, totals = list(groups), dict(totals or {})
    by = F.col(value).desc() if descending else F.col(value).asc()
    parts = None
    if rows is None or rows > part_rows:
        counts = cut(counts)
        parts = _parts(counts, value, groups, part_rows)
    if parts is None:
        whole = Window.partitionBy(*groups)
        w = whole.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumns({
            **{out: F.sum(c).over(w) for out, c in sums.items()}, **{out: F.sum(c).over(whole) for out, c in totals.items()},
        })

    if groups:
        tagged = same(counts, parts, groups, "left")
    else:
        tagged = with_row(counts, parts)
    index = F.coalesce(F.size(F.filter("_cuts", lambda e: e <= F.col(value))), F.lit(0))
    tagged = tagged.withColumn(_PART, index).drop("_cuts")
    inside = Window.partitionBy(*groups, _PART).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    # One row per part of a group.
    part_order = F.col(_PART).desc() if descending else F.col(_PART).asc()
    before = Window.partitionBy(*groups).orderBy(part_order).rowsBetween(Window.unboundedPreceding, -1)
    per_part = tagged.groupBy(*groups, _PART).agg(
        *[F.sum(c).alias("_t_" + out) for out, c in {**sums, **totals}.items()]
    ).withColumns({
        **{"_b_" + out: F.sum("_t_" + out).over(before) for out in sums},
        **{out: F.sum("_t_" + out).over(Window.partitionBy(*groups)) for out in totals},
    }).drop(*["_t_" + out for out in {**sums, **totals}])
    joined = same(
        tagged.withColumns({out: F.sum(c).over(inside) for out, c in sums.items()}), per_part, [*groups, _PART], "left",
    )
    return joined.select(
        *counts.columns, *[(F.col(out) + F.coalesce("_b_" + out, F.lit(0))).alias(out) for out in sums], *totals,
    )


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))


def _interpolate(total: Column, p: float, lo: Column, hi: Column) -> Column:
    # The terms in which the percentile aggregate adds up, so that every path gives the same last digit.
    pos = F.lit(float(p)) * (total - 1)
    return F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi)


def _at_ranks(first: Column, past: Column, value: Column, total: Column, p: float) -> tuple[Column, Column]:
    """Aggregates that pick the values at the two ranks around ``p``; a row holds ranks [first, past)."""
    pos = F.lit(float(p)) * (total - 1)
    pick = lambda at: F.max(F.when((first <= at) & (at < past), value))
    return pick(F.floor(pos)), pick(F.ceil(pos))


def percentiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Exact percentiles with linear interpolation: one row per group, array ``pcts``.

    Two scans of the values, whatever the size: a mergeable sketch gives each group's number of rows and a
    thin band of values around each target; then the rows inside the bands are counted by value, the others by the
    gap between bands in which they lie. Only counts are shuffled.
    """
    groups = list(groups)
    have = cut(df.select(*groups, F.col(value).cast("double").alias("_v")).filter("_v is not null"))
    bands = cut(have.groupBy(*groups).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(p) for p in band_probs(probs, accuracy)]), accuracy).alias("_q"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
    ).withColumn("_q", band_edges(accuracy)).drop("_min", "_max"))
    tagged = same(have, bands, groups, "inner") if groups else with_row(have, bands)
    v, q = F.col("_v"), F.col("_q")
    pairs = [(q[2 * i], q[2 * i + 1]) for i in range(len(probs))]
    inside = reduce(lambda x, y: x | y, [(v >= lo) & (v <= hi) for lo, hi in pairs])
    gap = sum(((lo <= v).cast("int") for lo, _ in pairs), F.lit(0))
    counts = tagged.groupBy(*groups, F.when(~inside, gap).alias("_gap"), F.when(inside, v).alias("_v")).agg(F.count("*").alias("n"))
    return percentiles_of_bands(counts, bands, probs, groups)


def band_probs(probs: Sequence[float], accuracy: int = ACCURACY) -> list[float]:
    """Where to ask a sketch of rank error 1 / accuracy, so that the exact ranks around each target lie between two answers."""
    return [min(1.0, max(0.0, p + side * 3 / accuracy)) for p in probs for side in (-1, 1)]


def band_edges(accuracy: int = ACCURACY) -> Column:
    """The sketch's answers ``_q``; in a group of few rows (``_n``) the two ranks around a target can lie outside, its bands are all its values."""
    whole = F.transform("_q", lambda _, i: F.when(i % 2 == 0, F.col("_min")).otherwise(F.col("_max")))
    return F.when(F.col("_n") < 10 * accuracy, whole).otherwise(F.col("_q"))


def percentiles_of_bands(counts: DataFrame, bands: DataFrame, probs: Sequence[float], groups: Sequence[str] = (), part_rows: int = PART_ROWS) -> DataFrame:
    """The percentiles from (groups, _gap, _v, n) and (groups, _n, _q).

    ``_v`` are the values inside bands; a row outside has a ``_gap`` instead: the number of bands that begin at or below it.
    """
    groups = list(groups)
    counts = cut(counts)
    gaps = counts.filter("_v IS NULL").groupBy(*groups).agg(F.collect_list(F.struct("_gap", "n")).alias("_gaps"))
    info = cut(same(bands, gaps, groups, "left") if groups else with_row(bands, gaps))
    values = counts.filter("_v IS NOT NULL").drop("_gap")
    cum = running_totals(values, "_v", {"upto": "n"}, groups, part_rows=part_rows, rows=values.count())
    cum = same(cum, info, groups, "left") if groups else with_row(cum, info)
    begun = F.size(F.filter("_q", lambda x, i: (i % 2 == 0) & (x <= F.col("_v"))))
    below = F.aggregate(F.filter(F.coalesce("_gaps", F.array()), lambda g: g["_gap"] < begun), F.lit(0).cast("long"), lambda t, g: t + g["n"])
    ranked = cum.withColumns({"_first": below + F.col("upto") - F.col("n"), "_past": below + F.col("upto")})
    aggs = [F.max("_n").alias("_n")]
    for i, p in enumerate(probs):
        lo, hi = _at_ranks(F.col("_first"), F.col("_past"), F.col("_v"), F.col("_n"), p)
        aggs += [lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}")]
    found = ranked.groupBy(*groups).agg(*aggs)
    pcts = []
    for i, p in enumerate(probs):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        outside = (F.col("_n") > 0) & (lo.isNull() | hi.isNull())
        sure = F.when(outside, F.raise_error(F.lit("percentile outside its band")).cast("double")).otherwise(lo)
        pcts.append(_interpolate(F.col("_n"), p, sure, hi))
    return found.select(*groups, F.when(F.col("_n") > 0, F.array(*pcts)).alias("pcts"))


def percentiles_of_counts(
    counts: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (), part_rows: int = PART_ROWS
) -> DataFrame:
    """The same from (groups, value, n) with one row per distinct value, for any number of groups."""
    groups = list(groups)
    cum = running_totals(counts, value, {"upto": "n"}, groups, part_rows=part_rows, totals={"total": "n"})
    v, first, past = F.col(value).cast("double"), F.col("upto") - F.col("n"), F.col("upto")
    aggs = [F.max("total").alias("total")]
    for i, p in enumerate(probs):
        lo, hi = _at_ranks(first, past, v, F.col("total"), p)
        aggs += [lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}")]
    found = cum.groupBy(*groups).agg(*aggs)
    pcts = [_interpolate(F.col("total"), p, F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i, p in enumerate(probs)]
    return found.select(*groups, F.array(*pcts).alias("pcts"))


def spearman(df: DataFrame, pairs: Mapping[str, tuple[str, str]], part_rows: int = PART_ROWS) -> DataFrame:
    """(pair, n, rho) for named column pairs; rows where either side is NULL are left out, pairs without rows too.

    Every column is ranked once, for all pairs whose rows are the column's own; a pair that loses
    rows to NULLs of its other column has ranks of its own. Ranks come from counts of
    values, so equal rows are merged before the shuffle, and return to the rows by row id.
    """
    columns = sorted({c for p in pairs.values() for c in p})
    at = {c: f"_c{i}" for i, c in enumerate(columns)}
    rows = cut(df.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).cast("double").alias(n) for c, n in at.items()]))
    sizes = rows.agg(*[F.count(n).alias(n) for n in at.values()], *[
        F.count_if(F.col(at[a]).isNotNull() & F.col(at[b]).isNotNull()).alias(f"_p{i}") for i, (a, b) in enumerate(pairs.values())]).first()
    # A ranking is a column, and the column that must not be NULL beside it if that takes rows away.
    ranking = lambda c, other, n: (at[c], None if sizes[at[c]] == n else at[other])
    sides = [(ranking(a, b, sizes[f"_p{i}"]), ranking(b, a, sizes[f"_p{i}"])) for i, (a, b) in enumerate(pairs.values())]
    rankings = list(dict.fromkeys(r for s in sides for r in s))
    values = rows.select("_row", F.inline(F.array(*[
        F.struct(F.lit(k).alias("_rank"), (F.col(c) if other is None else F.when(F.col(other).isNotNull(), F.col(c))).alias("_v"))
        for k, (c, other) in enumerate(rankings)]))).filter("_v IS NOT NULL")
    counts = values.groupBy("_rank", "_v").agg(F.count("*").alias("n"))
    cum = running_totals(counts, "_v", {"upto": "n"}, ["_rank"], part_rows=part_rows, totals={"total": "n"})
    # Average rank of equal values, measured from the middle rank (n + 1) / 2.
    centred = F.col("upto") - (F.col("n") - 1) / 2 - (F.col("total") + 1) / 2
    ranks = cut(cum.select("_rank", "_v", "n", centred.alias("_r")))
    # Values of many rows are few: written, so that the planner broadcasts them to their rows, and none of them fills a task.
    at_value, many = ["_rank", "_v"], min(part_rows, FREQUENT)
    frequent = cut(ranks.filter(F.col("n") > many).drop("n"))
    common = same(values, frequent, at_value, "inner")
    others = same(values, frequent, at_value, "left_anti")
    ranked = same(others, ranks.filter(F.col("n") <= many).drop("n"), at_value, "inner").unionByName(common)
    wide = ranked.groupBy("_row").agg(*[F.max(F.when(F.col("_rank") == k, F.col("_r"))).alias(f"_r{k}") for k in range(len(rankings))])
    sums = []
    for i, (one, two) in enumerate(sides):
        a, b = (F.col(f"_r{rankings.index(side)}") for side in (one, two))
        both = a.isNotNull() & b.isNotNull()
        sums += [F.count_if(both).alias(f"n{i}"), F.sum(a * b).alias(f"ab{i}"), F.sum(F.when(both, a * a)).alias(f"aa{i}"), F.sum(F.when(both, b * b)).alias(f"bb{i}")]
    out = wide.agg(*sums).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("pair"), *[F.col(f"{c}{i}").alias(c) for c in ("n", "ab", "aa", "bb")]) for i, name in enumerate(pairs)])))
    scale = F.sqrt(F.col("aa")) * F.sqrt(F.col("bb"))
    return out.filter("n > 0").select("pair", "n", (F.col("ab") / F.when(scale > 0, scale)).alias("rho"))
