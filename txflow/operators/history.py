"""Features of a row computed from earlier rows of the same key.

A window function puts all rows of one key into one task. That is right for
almost every user or merchant and wrong for the few that hold a large share of
the table. ``prior`` therefore measures the keys first: rows of ordinary keys
go through plain window functions (one exchange by key), rows of heavy keys are
cut into time slices of about ``hot_rows`` rows, each slice is scanned by its
own task, and what the earlier slices add is carried in from one aggregate per
slice. Both ways give the same values; only the distribution differs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txflow.operators.joining import same
from txflow.session import cut

# Rows of one key that one task may sort and scan; a task gets the rows of few keys, since about twice as many partitions are made.
# Keys just below it meet by chance: of hundreds of partitions the fullest gets four or five. A row of all features takes
# kilobytes there, as the sorts of a stage are held at once.
HOT_ROWS = 25_000
# Spark's spark.shuffle.sort.bypassMergeThreshold: to so many partitions rows are written without being sorted in memory.
DIRECT = 200

GROUP, SLICE, LO, CUTS, TOTAL = "_group", "_slice", "_lo", "_cuts", "_total"
_FIRST, _BEFORE = Window.unboundedPreceding, -1


@dataclass(frozen=True)
class Order:
    """Which rows belong together and how they are ordered."""

    keys: tuple[str, ...]
    ts: str
    tx: str
    cuts: DataFrame | None = None  # heavy keys with their cut points
    total: int = 0  # rows of the table
    hot_rows: int = HOT_ROWS

    def rows(self, *extra: str):
        return Window.partitionBy(*self.keys, *extra).orderBy(self.ts, self.tx)

    def prior(self, *extra: str):
        return self.rows(*extra).rowsBetween(_FIRST, _BEFORE)

    def slices(self, *extra: str):
        return Window.partitionBy(*self.keys, *extra).orderBy(SLICE)

    def micros(self) -> Column:
        return F.unix_micros(F.col(self.ts))


class Feature:
    """One feature family; the methods that matter are overridden."""

    @property
    def own_order(self) -> bool:
        """Needs a sort of its own rather than the key order."""
        return False

    def plain(self, o: Order) -> dict[str, Column]:
        raise NotImplementedError

    def local(self, o: Order) -> dict[str, Column]:
        """Parts seen inside the slice."""
        return {}

    def totals(self, o: Order) -> dict[str, Column]:
        """What one slice adds, as aggregates."""
        return {}

    def carried(self, o: Order) -> dict[str, Column]:
        """What all earlier slices add, as windows over the slice table."""
        return {}

    def centres(self, o: Order) -> dict[str, Column]:
        """Columns of the slice table that ``carried`` builds on."""
        return {}

    def attach(self, df: DataFrame, base: DataFrame, o: Order) -> DataFrame:
        """A join of its own, for features kept per (key, something else)."""
        return df

    def final(self, o: Order) -> dict[str, Column]:
        raise NotImplementedError


def _zero(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


@dataclass(frozen=True)
class Moments(Feature):
    """Count, mean, standard deviation and maximum of the prior values."""

    value: str
    n: str | None = None
    mean: str | None = None
    std: str | None = None
    max: str | None = None
    sample: bool = True

    @property
    def id(self) -> str:
        return f"_m_{self.value}_"

    def plain(self, o):
        w, v = o.prior(), F.col(self.value)
        spread = F.stddev_samp if self.sample else F.stddev_pop
        out = {}
        if self.n:
            out[self.n] = F.count(v).over(w)
        if self.mean:
            out[self.mean] = F.avg(v).over(w)
        if self.std:
            out[self.std] = self._spread(F.count(v).over(w), F.min(v).over(w), F.max(v).over(w), spread(v).over(w))
        if self.max:
            out[self.max] = F.max(v).over(w)
        return out

    def _spread(self, n: Column, low: Column, high: Column, otherwise: Column) -> Column:
        """Exactly zero for equal values, however the sums were added up."""
        return F.when(low == high, F.when(n > (1 if self.sample else 0), F.lit(0.0))).otherwise(otherwise)

    def local(self, o):
        w, v = o.prior(SLICE), F.col(self.value)
        return {
            self.id + "n": F.count(v).over(w),
            self.id + "mean": F.avg(v).over(w),
            self.id + "var": F.var_pop(v).over(w),
            self.id + "max": F.max(v).over(w),
            self.id + "min": F.min(v).over(w),
        }

    def totals(self, o):
        v = F.col(self.value)
        return {
            self.id + "tn": F.count(v),
            self.id + "tmean": F.avg(v),
            self.id + "tvar": F.var_pop(v),
            self.id + "tmax": F.max(v),
            self.id + "tmin": F.min(v),
        }

    def centres(self, o):
        key, n = Window.partitionBy(*o.keys), F.col(self.id + "tn")
        total = F.sum(n).over(key)
        mean = F.sum(n * F.col(self.id + "tmean")).over(key) / F.when(total > 0, total)
        return {self.id + "centre": mean}

    def carried(self, o):
        # Sums are taken around the key's own mean, so nothing large cancels.
        i, before = self.id, o.slices().rowsBetween(_FIRST, _BEFORE)
        n, mean, var = F.col(i + "tn"), F.col(i + "tmean"), F.col(i + "tvar")
        off = mean - F.col(i + "centre")
        return {
            i + "cn": _zero(F.sum(n).over(before)),
            i + "centre": F.col(i + "centre"),
            i + "csum": F.sum(n * off).over(before),
            i + "csq": F.sum(n * var + n * off * off).over(before),
            i + "cmax": F.max(F.col(i + "tmax")).over(before),
            i + "cmin": F.min(F.col(i + "tmin")).over(before),
        }

    def final(self, o):
        i = self.id
        n1, m1, v1 = F.col(i + "n"), _zero(i + "mean"), _zero(i + "var")
        n2 = _zero(i + "cn")
        some2 = F.when(n2 > 0, n2)
        m2 = _zero(F.col(i + "centre") + F.col(i + "csum") / some2)
        q2 = _zero(F.col(i + "csq") - F.col(i + "csum") * F.col(i + "csum") / some2)
        n = n1 + n2
        some = F.when(n > 0, n)
        low, high = F.least(i + "min", i + "cmin"), F.greatest(i + "max", i + "cmax")
        mean = F.when(low == high, low.cast("double")).otherwise((n1 * m1 + n2 * m2) / some)
        ss = n1 * v1 + q2 + (m1 - m2) * (m1 - m2) * n1 * n2 / some
        ss = F.greatest(ss, F.lit(0.0))
        div = F.when(n > 1, n - 1) if self.sample else some
        out = {}
        if self.n:
            out[self.n] = n
        if self.mean:
            out[self.mean] = mean
        if self.std:
            out[self.std] = self._spread(n, low, high, F.sqrt(ss / div))
        if self.max:
            out[self.max] = high
        return out


@dataclass(frozen=True)
class PriorCount(Feature):
    """Earlier rows of the key, or of the key with the same ``by`` columns."""

    out: str
    by: tuple[str, ...] = ()

    @property
    def own_order(self):
        return bool(self.by)

    @property
    def id(self) -> str:
        return f"_c_{self.out}"

    def plain(self, o):
        return {self.out: (F.row_number().over(o.rows(*self.by)) - 1).cast("bigint")}

    def local(self, o):
        return {self.id: F.row_number().over(o.rows(SLICE, *self.by)) - 1}

    def attach(self, df, base, o):
        cols = [*o.keys, *self.by]
        before = o.slices(*self.by).rowsBetween(_FIRST, _BEFORE)
        seen = (
            base.groupBy(*cols, SLICE).agg(F.count("*").alias("_k"))
            .withColumn(self.id + "_before", F.sum("_k").over(before)).drop("_k")
        )
        return same(df, seen, [*cols, SLICE], "left")

    def final(self, o):
        return {self.out: (F.col(self.id) + _zero(self.id + "_before")).cast("bigint")}


@dataclass(frozen=True)
class Previous(Feature):
    """Timestamp of the previous row of the key."""

    out: str

    def plain(self, o):
        return {self.out: F.lag(o.ts).over(o.rows())}

    def local(self, o):
        return {"_prev_ts": F.lag(o.ts).over(o.rows(SLICE))}

    def totals(self, o):
        return {"_last_ts": F.max(o.ts)}

    def carried(self, o):
        return {"_before_ts": F.max("_last_ts").over(o.slices().rowsBetween(_FIRST, _BEFORE))}

    def final(self, o):
        return {self.out: F.coalesce("_prev_ts", "_before_ts")}


@dataclass(frozen=True)
class KeyTotals(Feature):
    """Number of rows of the key, and its first timestamp."""

    total: str | None = None
    first: str | None = None

    def plain(self, o):
        w, out = Window.partitionBy(*o.keys), {}
        if self.total:
            out[self.total] = F.count("*").over(w)
        if self.first:
            out[self.first] = F.min(o.ts).over(w)
        return out

    def final(self, o):
        out = {}
        if self.total:
            out[self.total] = F.col(TOTAL)
        if self.first:
            out[self.first] = F.timestamp_micros(F.col(LO))
        return out


@dataclass(frozen=True)
class Trailing(Feature):
    """Earlier rows of the key no older than ``seconds``; needs the prior count ``count``."""

    out: str
    count: str
    seconds: int

    @property
    def own_order(self):
        return True

    @property
    def span(self) -> int:
        return self.seconds * 1_000_000

    def plain(self, o):
        w = (
            Window.partitionBy(*o.keys).orderBy(o.micros())
            .rangeBetween(_FIRST, -self.span - 1)
        )
        prior = F.row_number().over(o.rows()) - 1
        return {self.out: (prior - F.count("*").over(w)).cast("bigint")}

    def attach(self, df, base, o):
        # Every distinct timestamp is both a data point and a question "how many rows
        # lie before me minus the span"; questions are answered by one running sum.
        at = o.micros()
        points = base.groupBy(*o.keys, at.alias("_at")).agg(F.count("*").alias("_add"))
        both = points.select(
            *o.keys, "_at",
            F.explode(F.array(
                F.struct(F.col("_at").alias("pos"), F.lit(1).alias("q"), F.col("_add").alias("add")),
                F.struct((F.col("_at") - self.span).alias("pos"), F.lit(0).alias("q"),
                         F.lit(0).cast("bigint").alias("add")),
            )).alias("e"),
        ).select(*o.keys, "_at", "e.*")
        mixed = in_slices(both, F.col("pos"), o.cuts, o.keys)
        inside = Window.partitionBy(*o.keys, SLICE).orderBy("pos", "q").rowsBetween(_FIRST, 0)
        before = (
            mixed.groupBy(*o.keys, SLICE).agg(F.sum("add").alias("_t"))
            .withColumn("_b", F.sum("_t").over(o.slices().rowsBetween(_FIRST, _BEFORE))).drop("_t")
        )
        older = same(
            mixed.withColumn("_in", F.sum("add").over(inside)).filter("q = 0"),
            before, [*o.keys, SLICE], "left",
        ).select(*o.keys, "_at", (F.col("_in") + _zero("_b")).alias("_older_" + self.out))
        # The rows leave their slices for this join: dealt again, or AQE merges the partitions by their compressed size.
        rows = deal(df.withColumn("_at", at), o.total, (*o.keys, "_at"), o.hot_rows)
        return same(rows, older, [*o.keys, "_at"], "left").drop("_at")

    def final(self, o):
        return {self.out: (F.col(self.count) - F.col("_older_" + self.out)).cast("bigint")}


@dataclass(frozen=True)
class LastYearMean(Feature):
    """The key's mean value in the same month one year before the row."""

    value: str
    out: str

    @property
    def own_order(self):
        return True

    def plain(self, o):
        w = (
            Window.partitionBy(*o.keys, F.month(o.ts)).orderBy(F.year(o.ts)).rangeBetween(-1, -1)
        )
        return {self.out: F.avg(self.value).over(w)}

    def attach(self, df, base, o):
        monthly = base.groupBy(
            *o.keys, (F.year(o.ts) + 1).alias("_y"), F.month(o.ts).alias("_mo")
        ).agg(F.avg(self.value).alias("_ly"))
        tagged = df.withColumns({"_y": F.year(o.ts), "_mo": F.month(o.ts)})
        return same(tagged, monthly, [*o.keys, "_y", "_mo"], "left").drop("_y", "_mo")

    def final(self, o):
        return {self.out: F.col("_ly")}


def slice_of(micros: Column) -> Column:
    """Time slice of a position inside its heavy key; never decreases with time."""
    return F.size(F.filter(CUTS, lambda c: c < micros)).cast("bigint")


def in_slices(df: DataFrame, micros: Column, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose ``keys`` are in ``cuts``, with their slice; the cut points stay behind at the join."""
    return same(df, cuts, keys, "inner").withColumn(SLICE, slice_of(micros)).drop(CUTS)


def heavy_keys(df: DataFrame, keys: Sequence[str], ts: str = "ts", hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys with more than ``hot_rows`` rows, with the times at which each one is cut.

    The cuts are quantiles of the key's own timestamps, so slices hold about equally many rows however
    unevenly these lie in time; a moment that fills a slice alone gets one to itself. The table is written, so the
    planner knows its size: it is broadcast while it is small and joined by a shuffle beyond.
    """
    return measured(df, keys, ts, hot_rows)[1]


def measured(df: DataFrame, keys: Sequence[str], ts: str, hot_rows: int) -> tuple[int, DataFrame | None]:
    """Number of rows, and the heavy keys."""
    micros = F.unix_micros(F.col(ts))
    sizes = df.groupBy(*keys).agg(F.count("*").alias(TOTAL), F.min(micros).alias(LO))
    rows, most = sizes.agg(F.coalesce(F.sum(TOTAL), F.lit(0)), F.coalesce(F.max(TOTAL), F.lit(0))).first()
    if most <= hot_rows:
        return rows, None
    large = cut(sizes.filter(F.col(TOTAL) > hot_rows).withColumn(GROUP, F.monotonically_increasing_id()))
    n = -(-most // hot_rows)
    steps = F.array(*[F.lit(i / n) for i in range(1, n)])
    own = same(df.select(*keys, micros.alias("_at")), large, keys, "inner")
    found = own.groupBy(GROUP, TOTAL).agg(F.percentile_approx("_at", steps, max(10_000, 10 * n)).alias("_q"))
    # Each key takes as many of the n - 1 quantiles as its own rows need.
    slices = F.ceil(F.col(TOTAL) / hot_rows)
    found = found.withColumn("_q", F.filter("_q", lambda _, i: F.floor((i + 1) * slices / n) > F.floor(i * slices / n)))
    # A quantile that comes twice is a moment with more rows than a slice: cut before it too.
    twice = F.filter("_q", lambda c, i: (i > 0) & (c == F.get("_q", F.greatest(i - 1, F.lit(0)))))
    cuts = F.array_sort(F.array_distinct(F.concat("_q", F.transform(twice, lambda c: c - 1))))
    return rows, cut(large.join(found.select(GROUP, cuts.alias(CUTS)), GROUP))


def deal(df: DataFrame, rows: int, keys: Sequence[str], hot_rows: int = HOT_ROWS, spread: Sequence[str] = ()) -> DataFrame:
    """``df`` by ``keys``, in as many partitions as its number of rows asks for.

    The partitions of an ordinary shuffle grow with the input, and AQE merges them by their compressed size.
    That may leave a small table, of as many rows as can meet in a task anyway, in one partition.

    A task that writes for more than ``DIRECT`` partitions holds its rows in memory until all are sorted, and a scan gives it
    as many as a row group or a block of a file has. With ``spread``, columns that tell rows apart, rows are then first dealt evenly
    to ``DIRECT`` partitions, which takes no memory.
    """
    if rows <= 4 * max(hot_rows, HOT_ROWS):
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-2 * rows // max(hot_rows, HOT_ROWS)))
    if spread and parts > DIRECT:
        df = df.withColumn("_deal", F.xxhash64(*spread)).repartition(DIRECT, "_deal").drop("_deal")
    return df.repartition(parts, *keys)


def split_heavy(df: DataFrame, keys: Sequence[str], heavy: DataFrame | None, ts: str = "ts"):
    """(rows of ordinary keys, rows of heavy keys with their number and slice, or None)."""
    if heavy is None:
        return df, None
    cold = same(df, heavy, keys, "left_anti")
    return cold, in_slices(df, F.unix_micros(F.col(ts)), heavy, keys)


def prior(
    df: DataFrame,
    keys: str | Sequence[str],
    *layers: Sequence[Feature] | Callable[[DataFrame], DataFrame],
    ts: str = "ts",
    tx: str = "tx_id",
    hot_rows: int = HOT_ROWS,
    measure: DataFrame | None = None,
    dealt: bool = False,
    scanned: bool = True,
) -> DataFrame:
    """Add features of the earlier rows of ``keys`` in ``(ts, tx)`` order.

    ``measure`` is the table to count the keys on when ``df`` is costly to evaluate
    (same rows, fewer columns). A layer is a list of features, or a function that adds plain columns; a later
    layer may use the columns of an earlier one. ``dealt`` says that ``df`` comes from ``prior`` by the same keys, whose exchange then serves.
    ``scanned=False`` says that it comes from ``prior`` by any keys, so that its partitions hold few rows.
    """
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    order = Order(keys, ts, tx)
    rows, heavy = measured(df if measure is None else measure, keys, ts, hot_rows)
    cold, hot = split_heavy(df, keys, heavy, ts)
    spread = (ts, tx) if scanned and not dealt else ()
    if not dealt or heavy is not None:
        cold = deal(cold, rows, keys, hot_rows, spread)
    inner = Order((GROUP,), ts, tx, None if heavy is None else heavy.select(GROUP, CUTS), rows, hot_rows)
    for layer in layers:
        if callable(layer):
            cold = layer(cold)
            hot = hot if hot is None else layer(hot)
            continue
        # Features with a sort of their own first: the key order is then the last one
        # and serves the next layer too.
        for own in (True, False):
            cols = {k: c for f in layer if f.own_order is own for k, c in f.plain(order).items()}
            cold = cold.withColumns(cols) if cols else cold
        if hot is not None:
            hot = _carry(deal(hot, rows, (GROUP, SLICE), hot_rows, spread), layer, inner)
            spread = ()  # later layers come from partitions of few rows
    if hot is None:
        return cold
    return cold.unionByName(hot.select(*cold.columns))


def _carry(hot: DataFrame, layer: Sequence[Feature], o: Order) -> DataFrame:
    base = hot.columns
    totals = {k: c for f in layer for k, c in f.totals(o).items()}
    out = hot.withColumns({k: c for f in layer for k, c in f.local(o).items()})
    if totals:
        per_slice = hot.groupBy(*o.keys, SLICE).agg(*[c.alias(k) for k, c in totals.items()])
        per_slice = per_slice.withColumns({k: c for f in layer for k, c in f.centres(o).items()})
        carried = per_slice.select(
            *o.keys, SLICE, *[c.alias(k) for f in layer for k, c in f.carried(o).items()]
        )
        out = same(out, carried, [*o.keys, SLICE], "left")
    for f in layer:
        out = f.attach(out, hot, o)
    names = []
    for f in layer:
        done = f.final(o)
        names += done
        out = out.withColumns(done)
    return out.select(*base, *names)
