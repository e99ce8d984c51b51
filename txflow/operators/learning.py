"""Training, scoring and attribution jobs on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txflow.functions import decide
from txflow.operators import packed
from txflow.operators.joining import with_row
from txflow.schema import WINDOW
from txflow.session import cut

BLOCK_BYTES = 128 << 20

# --- input -------------------------------------------------------------------------------


def with_indicators(df: DataFrame, cols: Sequence[str], fill: float = 0.0) -> tuple[DataFrame, list[str]]:
    """NULL becomes ``fill`` plus an indicator column; returns the table and its input columns."""
    flags = {f"{c}__missing": F.col(c).isNull().cast("double") for c in cols}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(fill)) for c in cols}
    return df.withColumns(flags).withColumns(filled), [*cols, *flags]


def with_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight``: negatives per positive on positive rows, 1 elsewhere."""
    p = F.sum(F.col(label).cast("bigint"))
    ratio = df.agg(F.when(p > 0, (F.count("*") - p) / F.when(p > 0, p)).otherwise(F.lit(1.0)).alias("_w"))
    return with_row(df, ratio).withColumn("weight", F.when(F.col(label) == 1, F.col("_w")).otherwise(F.lit(1.0))).drop("_w")


def in_blocks(df: DataFrame, inputs: Sequence[str] | str, label: str) -> DataFrame:
    """Label and inputs, in partitions of at most about ``BLOCK_BYTES`` of numbers.

    Fits hold the rows of a partition in memory; stored vectors are compressed, and files are read by their size on disk.
    """
    wide = isinstance(inputs, str)
    rows = df.select(label, *([inputs] if wide else inputs))
    one = rows.select(F.size(vector_to_array(inputs))).first() if wide else (len(inputs),)
    parts = -(-rows.count() * (one[0] if one else 1) * 8 // BLOCK_BYTES)
    if parts <= rows.rdd.getNumPartitions():
        return rows
    return rows.withColumn("_id", F.monotonically_increasing_id()).repartition(parts, "_id").drop("_id")


def train(df: DataFrame, inputs: Sequence[str] | str, label: str = "label", kind: str = "trees", rounds: int = 300, depth: int = 6,
          step: float = 0.1, seed: int = 42) -> PipelineModel:
    """Class-weighted classifier: boosted trees, or a linear model that can be explained exactly.

    ``inputs`` are columns, or the name of one vector column.
    """
    vector = [] if isinstance(inputs, str) else [VectorAssembler(inputCols=list(inputs), outputCol="features")]
    common = dict(featuresCol=inputs if isinstance(inputs, str) else "features", labelCol=label, weightCol="weight")
    if kind == "trees":
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, cacheNodeIds=False, **common)
    else:
        model = LogisticRegression(maxIter=25, regParam=1e-4, **common)
    return without_summary(Pipeline(stages=[*vector, model]).fit(with_weight(in_blocks(df, inputs, label), label)))


def without_summary(model):
    """The model, or pipeline of models, without its training summary.

    The summary holds the session, which cannot travel to the workers once anything in it observes a query.
    """
    for stage in getattr(model, "stages", [model]):
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.apply(None))
    return model


def score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    done = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return done.drop("features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel | Linear, inputs: Sequence[str], spark, n: int = 30) -> DataFrame:
    """(rank, feature, importance), at most one row per input column."""
    stage = model if isinstance(model, Linear) else model.stages[-1]
    weights = stage.featureImportances if hasattr(stage, "featureImportances") else [abs(x) for x in stage.coefficients]
    pairs = sorted(zip(inputs, (float(x) for x in weights)), key=lambda p: (-p[1], p[0]))[:n]
    return spark.createDataFrame([(i + 1, f, w) for i, (f, w) in enumerate(pairs)], "rank int, feature string, importance double")


# --- augmentation ------------------------------------------------------------------------


def augment(df: DataFrame, synthetic: DataFrame, cols: Sequence[str], label: str = "label", evaders: DataFrame | None = None) -> DataFrame:
    """Real rows, synthetic rows filled up with the positive-class mean, and evaders, all extra rows labelled 1.

    Evaders must come from training rows; rows of the test period would leak into the model.
    """
    means = df.filter(F.col(label) == 1).agg(*[F.avg(c).alias("_mean_" + c) for c in cols])
    have = set(synthetic.columns)
    full = with_row(synthetic, means).select(*[
        (F.coalesce(F.col(c).cast("double"), F.col("_mean_" + c)) if c in have else F.col("_mean_" + c)).alias(c) for c in cols
    ])
    parts = [(df.select(*[F.col(c).cast("double").alias(c) for c in cols], label), "real")]
    parts.append((full.withColumn(label, F.lit(1)), "synthetic"))
    if evaders is not None:
        parts.append((evaders.select(*[F.col(c).cast("double").alias(c) for c in cols], F.lit(1).alias(label)), "evader"))
    out = None
    for part, name in parts:
        part = part.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def augment_slots(df: DataFrame, synthetic: DataFrame, names: Sequence[str], inputs: str = "inputs", label: str = "label",
                  evaders: DataFrame | None = None, step: int = WINDOW - 1) -> DataFrame:
    """(source, label, inputs): the same for vectors whose slots ``names`` tells.

    A column of ``synthetic`` named like a base column goes into the slot of the latest step, one named like a history feature into its
    own; where it is NULL, and in all other slots, stands the mean of the positive class, from one aggregate over the vectors.
    """
    place = {n: i for i, n in enumerate(names)}
    at = {c: place[f"{c}_t{step}"] if f"{c}_t{step}" in place else place[c] for c in synthetic.columns}
    mean = df.filter(F.col(label) == 1).select(Summarizer.mean(F.col(inputs)).alias("_m")).select(vector_to_array("_m").alias("_mean"))
    given = F.map_from_entries(F.array(*[F.struct(F.lit(i), F.col(f"`{c}`").cast("double")) for c, i in at.items()]))
    filled = with_row(synthetic.withColumn("_given", given), mean)
    slots = F.transform("_mean", lambda m, i: F.coalesce(F.try_element_at("_given", i), m))
    parts = [("real", df.select(F.col(label).cast("int").alias(label), inputs)), ("synthetic", filled.select(F.lit(1).alias(label), array_to_vector(slots).alias(inputs)))]
    if evaders is not None:
        parts.append(("evader", evaders.select(F.lit(1).alias(label), inputs)))
    return reduce(DataFrame.unionByName, [part.withColumn("source", F.lit(name)) for name, part in parts])


# --- ablation ----------------------------------------------------------------------------


def ablate(model: PipelineModel, df: DataFrame, groups: Mapping[str, Sequence[str]], names: Sequence[str], inputs: str = "inputs") -> DataFrame:
    """The columns of ``df`` but its vector, ``model`` (the variant's name) and ``score``, for each variant: the slots of its group set to zero.

    All variants of a row are scored by the fitted model in one pass over the rows.
    """
    rest = [c for c in df.columns if c != inputs]
    variants = []
    for name, zeroed in groups.items():
        out = set(zeroed)
        keep = F.array(*[F.lit(0.0 if n in out else 1.0) for n in names])
        variants.append(F.struct(F.lit(name).alias("model"), F.zip_with("_x", keep, lambda x, k: x * k).alias("x")))
    each = df.select(*rest, vector_to_array(inputs).alias("_x")).select(*rest, F.explode(F.array(*variants)).alias("_v"))
    return score(model, each.select(*rest, "_v.model", array_to_vector("_v.x").alias(inputs))).drop(inputs)


# --- attributions ------------------------------------------------------------------------


def vector_attributions(x: Column | str, coefficients: Sequence[float], means: Sequence[float]) -> Column:
    """coef * (x - mean) of every slot of an array; a missing slot counts as its mean. One expression, however wide the input."""
    array = lambda values: F.array(*[F.lit(float(v)) for v in values])
    off = F.zip_with(x, array(means), lambda v, m: F.coalesce(v - m, F.lit(0.0)))
    return F.zip_with(off, array(coefficients), lambda d, c: c * d)


def top_slots(shares: Column | str, names: Sequence[str], n: int = 5) -> Column:
    """ARRAY<STRUCT<feature, shap_value>>: the ``n`` slots of largest magnitude, the first on ties."""
    ranked = F.array_sort(F.transform(shares, lambda v, i: F.struct((-F.abs(v)).alias("order"), i.alias("at"), v.alias("shap_value"))))
    called = F.array(*[F.lit(c) for c in names])
    return F.transform(F.slice(ranked, 1, n), lambda e: F.struct(F.get(called, e["at"]).alias("feature"), e["shap_value"].alias("shap_value")))


def top_by_magnitude(values: dict[str, Column], n: int = 5) -> Column:
    """ARRAY<STRUCT<feature, shap_value>>: the ``n`` entries of largest magnitude, first named first on ties."""
    items = F.array(*[
        F.struct((-F.abs(v)).alias("order"), F.lit(i).alias("at"), F.lit(k).alias("feature"), v.cast("double").alias("shap_value"))
        for i, (k, v) in enumerate(values.items())
    ])
    return F.transform(F.slice(F.array_sort(items), 1, n), lambda e: F.struct(e["feature"].alias("feature"), e["shap_value"].alias("shap_value")))


def linear_attributions(df: DataFrame, coefficients: dict[str, float], means: dict[str, float]) -> dict[str, Column]:
    """coef * (x - mean): the exact additive attribution of a linear score; NULL counts as the mean."""
    return {
        c: F.lit(float(w)) * (F.coalesce(F.col(c).cast("double"), F.lit(float(means[c]))) - F.lit(float(means[c])))
        for c, w in coefficients.items()
    }


def top_frequency(df: DataFrame, top: str = "top_features", k: int = 3) -> DataFrame:
    """How often each feature is among the first ``k`` of a row."""
    names = df.select(F.explode(F.slice(top, 1, k)).alias("e")).select("e.feature")
    return names.groupBy("feature").agg(F.count("*").alias("n"))


def attributions_agree(top: DataFrame, importance: DataFrame, n: int = 5, column: str = "top_features") -> DataFrame:
    """One row: whether each of the ``n`` features that matter most over all rows leads some row's attributions."""
    seen = top.select(F.explode(column).alias("e")).select("e.feature").distinct()
    first = importance.filter(F.col("rank") <= n)
    met = first.join(seen.withColumn("met", F.lit(1)), "feature", "left")
    return met.agg(F.count("*").alias("features"), F.count("met").alias("found"), (F.count("met") == F.count("*")).alias("agree"))


def attribution_check(freq: DataFrame, importance: DataFrame, rows: DataFrame, n: int = 10) -> DataFrame:
    """Global rank next to the share of rows that list the feature on top."""
    total = rows.agg(F.count("*").alias("_n"))
    top = with_row(importance.filter(F.col("rank") <= n).join(freq, "feature", "left"), total)
    pct = F.coalesce(F.col("n"), F.lit(0)) * 100 / F.when(F.col("_n") > 0, F.col("_n"))
    return top.select("feature", "rank", pct.alias("top_pct"))


# What a feature means to an analyst. kind, text, limit.
PHRASES = {
    "first_mcc": ("flag", "this is the user's first transaction in this merchant category", 0.5),
    "first_city_state": ("flag", "this is the user's first transaction in this city or state", 0.5),
    "first_channel": ("flag", "this is the user's first time using this payment channel", 0.5),
    "is_new_merchant": ("flag", "the user has never transacted with this merchant before", 0.5),
    "first_tx_this_month": ("flag", "this is the user's first transaction this month", 0.5),
    "first_tx_this_year": ("flag", "this is the user's first transaction this year", 0.5),
    "is_dormant": ("flag", "the user's account had been inactive before this transaction", 0.5),
    "is_largest_ever": ("flag", "this is the largest transaction this user has ever made", 0.5),
    "is_2x_hist_max": ("flag", "the amount is more than double the user's previous largest transaction", 0.5),
    "is_5x_hist_max": ("flag", "the amount is more than five times the user's previous largest transaction", 0.5),
    "user_amount_zscore": (
        "number", "the amount is unusually high for this user (%.1f standard deviations above their average)", 1.0),
    "user_amount_to_max_ratio": ("number", "the amount is %.1fx this user's typical maximum transaction size", 1.0),
    "amount_vs_last_year_ratio": ("number", "the amount is %.1fx what this user spent in the same period last year", 1.5),
    "merch_amount_deviation": ("number", "the amount is unusually large for this merchant, at %.1fx normal", 1.0),
    "merch_spike_ratio": ("number", "this merchant is seeing an unusual spike in transaction volume, at %.1fx normal", 1.5),
    "merchant_user_count": ("rare", "visited this merchant", 3),
    "mcc_user_count": ("rare", "transacted in this merchant category", 3),
}
# Sentences of a rationale.
PATTERN_TEXT = (
    "the transaction's overall pattern (recent amounts, timing, and merchant activity) closely resembles historical "
    "fraud patterns, without any single unusual attribute standing out"
)
NO_RISK_TEXT = (
    "Feature values are consistent with this user's established transaction pattern; no unusual merchant, amount, or "
    "location signals were detected"
)
CALM_TEXT = "but overall the transaction pattern remains consistent with this user's established behavior."


def phrase(feature: Column, value: Column) -> Column:
    """The text of one feature, NULL when its value does not support one."""
    out = F.lit(None).cast("string")
    for name, (kind, text, limit) in PHRASES.items():
        if kind == "flag":
            said = F.when(value >= limit, F.lit(text))
        elif kind == "number":
            said = F.when(value > limit, F.format_string(text, value))
        else:
            n = F.rint(value).cast("int")
            often = F.when(n == 0, "never").when(n == 1, "only 1 time").otherwise(F.format_string("only %d times", n))
            said = F.when(value < limit, F.concat(F.lit("the user has "), often, F.lit(f" {text} before")))
        out = F.when(feature == name, said).otherwise(out)
    return out


def rationale(top: Column, prob: Column, threshold: float = decide.THRESHOLD) -> Column:
    """Sentence from the leading features: ``top`` is ARRAY<STRUCT<feature, shap_value, value>>."""
    flagged = prob >= threshold
    told = F.filter(top, lambda e: ~flagged | (e["shap_value"] > 0))
    said = F.array_distinct(F.filter(F.transform(told, lambda e: phrase(e["feature"], e["value"])), lambda p: p.isNotNull()))
    n, one, two = F.size(said), F.get(said, F.lit(0)), F.get(said, F.lit(1))
    alarm = F.when(n == 0, F.lit(PATTERN_TEXT)).when(n == 1, one).otherwise(F.concat(one, F.lit(", and "), two))
    both = F.when(n == 1, one).otherwise(F.concat(one, F.lit("; also "), two))
    calm = F.when(n == 0, F.lit(f"Not flagged. {NO_RISK_TEXT}.")).otherwise(
        F.concat(F.lit("Not flagged. Some risk indicators are present ("), both, F.lit(f"), {CALM_TEXT}")))
    return F.when(flagged, F.concat(F.lit("Flagged primarily because "), alarm, F.lit("."))).otherwise(calm)


def explain(df: DataFrame, coefficients: dict[str, float], means: dict[str, float], prob: str = "score",
            threshold: float = decide.THRESHOLD, top_n: int = 5, position: str = "user_tx_count") -> DataFrame:
    """Add top_features, confidence, verdict and rationale to scored rows; column expressions only."""
    shares = linear_attributions(df, coefficients, means)
    entries = F.array(*[
        F.struct((-F.abs(v)).alias("o"), F.lit(i).alias("i"), F.lit(k).alias("feature"), v.alias("shap_value"),
                 F.col(k).cast("double").alias("value")) for i, (k, v) in enumerate(shares.items())
    ])
    top = F.transform(F.slice(F.array_sort(entries), 1, top_n), lambda e: F.struct(
        e["feature"].alias("feature"), e["shap_value"].alias("shap_value"), e["value"].alias("value")))
    out = df.withColumns({"top_features": top, "_c": decide.confidence_struct(prob, threshold=threshold)})
    out = out.withColumns({"confidence_score": F.col("_c.score"), "confidence_reason": F.col("_c.reason")})
    verdict = decide.route(prob, "confidence_score", position, prob_block=threshold)
    return out.withColumn("_v", verdict).withColumns({
        "decision": F.col("_v.decision"), "rule": F.col("_v.rule"), "rationale": rationale(F.col("top_features"), F.col(prob), threshold),
    }).drop("_c", "_v")


# --- several models ----------------------------------------------------------------------


def train_per_bank(df: DataFrame, bank: str, n_banks: int, inputs: Sequence[str], label: str = "label", **kw) -> dict[int, PipelineModel]:
    """One model per bank; every fit is a distributed job on the bank's rows."""
    return {b: train(df.filter(F.col(bank) == b), inputs, label, **kw) for b in range(n_banks)}


def ensemble_score(models: dict[int, PipelineModel], df: DataFrame, out: str = "score") -> DataFrame:
    """Mean of the bank models' scores on the same rows."""
    total = F.lit(0.0)
    for b, m in models.items():
        df = score(m, df, f"_s{b}")
        total = total + F.col(f"_s{b}")
    return df.withColumn(out, total / len(models)).drop(*[f"_s{b}" for b in models])


class Linear(NamedTuple):
    """Coefficients by slot and intercept; a score is the logistic function of their sum."""

    coefficients: np.ndarray
    intercept: float


def _array(vector: str) -> Column:
    return F.when(F.col(vector).isNotNull(), vector_to_array(vector))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _sums_by_group(df: DataFrame, add: Callable[[object, np.ndarray, np.ndarray], np.ndarray], whole: object = None) -> dict[object, np.ndarray]:
    """``add(key, x, y)`` summed over all rows of each key, and under the key ``whole``, if given, over all rows: one scan, a task adds up its rows, Spark the
    tasks' sums by (key, place).

    As many numbers return to the driver as the keys' sums have.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {}
        for b in batches:
            x, y = packed.matrix(b.column("_x")), b.column("_y").to_numpy(zero_copy_only=False)
            coded = b.column("_g").dictionary_encode()
            code, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            parts = [(key, x[at], y[at]) for key, at in ((key, _run(code == k)) for k, key in enumerate(keys))]
            if whole is not None and b.num_rows:
                parts.append((whole, x, y))
            for key, its_x, its_y in parts:
                found = add(key, its_x, its_y)
                own[key] = own[key] + found if key in own else found
            if len(own) > 1_000:  # the tasks' memory stays bounded, however many keys there are
                yield _sent(own, b.schema.field("_g").type)
                own = {}
        if own:
            yield _sent(own, b.schema.field("_g").type)

    kind = df.schema["_g"].dataType.simpleString()
    parts = df.mapInArrow(run, f"_g {kind}, v array<double>").select("_g", F.posexplode("v").alias("k", "v"))
    out: dict[object, list] = {}
    for r in parts.groupBy("_g", "k").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["_g"], []).append((r["k"], r["v"]))
    return {key: np.array([v for _, v in sorted(found)]) for key, found in out.items()}


def _run(mine: np.ndarray) -> np.ndarray | slice:
    """The marked places, as a slice where they lie together: what it cuts out is then not copied."""
    at = np.flatnonzero(mine)
    return slice(at[0], at[-1] + 1) if len(at) and at[-1] - at[0] + 1 == len(at) else at


def _sent(sums: dict, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), kind), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["_g", "v"])


Point = tuple[float, float, float, np.ndarray]  # step, value, slope along the way, gradient
Search = Generator[np.ndarray, tuple[float, np.ndarray], Point | None]


def _step(x: np.ndarray, way: np.ndarray, value: float, slope: np.ndarray, first: float) -> Search:
    """A step from ``x`` against ``way`` that meets the strong Wolfe conditions, by Spark's rules: 10 steps that grow, 10 cubic ones between two."""
    fall = -(slope @ way)

    def at(t: float) -> Search:
        there, its_slope = yield x - t * way
        return t, there, -(its_slope @ way), its_slope

    def between(low: Point, high: Point) -> Search:
        for _ in range(10):
            (lt, lv, ld, _), (rt, rv, rd, _) = (low, high) if low[0] <= high[0] else (high, low)
            d1 = ld + rd - 3 * (lv - rv) / (lt - rt)
            d2 = np.sqrt(max(d1 * d1 - ld * rd, 0.0))
            t = rt - (rt - lt) * (rd + d2 - d1) / (rd - ld + 2 * d2)
            c = yield from at(min(max(t, lt + 0.1 * (rt - lt)), lt + 0.9 * (rt - lt)))
            if c[1] > value + 1e-4 * c[0] * fall or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(fall):
                return c
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        return None

    t, low = first, (0.0, value, fall, slope)
    for i in range(10):
        c = yield from at(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * fall or c[1] >= low[1] and i:
            return (yield from between(low, c))
        if abs(c[2]) <= 0.9 * abs(fall):
            return c
        if c[2] >= 0:
            return (yield from between(c, low))
        t, low = t * 1.5, c
    return None


def _minimum(size: int, rounds: int, tol: float, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS by the rules of Spark's logistic regression: yields points, is sent the value and gradient there, returns the minimum."""
    x = np.zeros(size)
    value, slope = yield x
    start, past, failed = value, [np.inf], False
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    done = 0
    while done < rounds and np.linalg.norm(slope) > max(tol * abs(value), 1e-8) and not abs(value - max(past)) <= tol * abs(start):
        way, kept = slope.copy(), []
        for s, y in reversed(pairs):
            kept.append((s @ way) / (s @ y))
            way -= kept[-1] * y
        if pairs:
            s, y = pairs[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), part in zip(pairs, reversed(kept), strict=True):
            way += (part - (y @ way) / (s @ y)) * s
        found = yield from _step(x, way, value, slope, 1.0 if done else 1.0 / np.linalg.norm(way))
        if found is None:  # once more from the gradient alone, then no further at this precision
            if failed:
                break
            failed, pairs = True, []
            continue
        step, value, _, its_slope = found
        s, y = -step * way, its_slope - slope
        if s @ y > 0:
            pairs = [*pairs, (s, y)][-memory:]
        x, slope, past, done = x + s, its_slope, [*past, value][-20:], done + 1
    return x


def train_linear(df: DataFrame, inputs: str, label: str = "label", **kw) -> Linear:
    """The model of ``train(kind="linear")``, by passes over stored packed rows; Spark's own fit writes them to the executors' disks once dealt and once in blocks."""
    return train_grouped(df.withColumn("_one", F.lit(0)), "_one", inputs, label, **kw)[0]


def train_grouped(df: DataFrame, group: str, inputs: str, label: str = "label", penalty: float = 1e-4, rounds: int = 25,
                  tol: float = 1e-6, whole: object = None) -> dict[object, Linear]:
    """One class-weighted linear model per value of ``group``, and under the key ``whole``, if given, one of all rows, all fitted by the same passes.

    The models are those of ``train(kind="linear")`` on each group's rows, by the same steps: positives weigh as much as negatives, the L2
    penalty is on coefficients of inputs scaled to unit deviation. Each pass scans the rows once, written as (group, label, inputs) unless ``inputs`` are packed
    rows, which are taken to be stored, and sums loss and gradient of every group at that group's own point; the optimisers, one per group, move in step. The number
    of jobs depends on the slowest group, not on how many there are. The driver holds a few vectors per group, as it does the models.

    ``inputs`` is a vector column, or one of packed rows, without missing values. Rows without a group, a label or inputs are left out; a group with
    one class has zero coefficients and an infinite intercept, as Spark's fit gives; an input that is constant in a group gets 0.
    """
    stored = isinstance(df.schema[inputs].dataType, T.BinaryType)
    rows = df.select(F.col(group).alias("_g"), F.col(label).cast("double").alias("_y"), F.col(inputs).alias("_x") if stored else _array(inputs).alias("_x"))
    rows = rows.dropna(subset=["_y", "_x"] if whole is not None else None)
    rows = rows if stored else cut(packed.packed(rows.withColumnRenamed("_x", "_a"), "_a", "_x"), wide=True)

    def totals(key, x, y):
        return np.concatenate(([len(y), y.sum()], x[y > 0].sum(axis=0), x[y <= 0].sum(axis=0)))

    first = _sums_by_group(rows, totals, whole)
    out, mean, weight = {}, {}, {}
    for key, t in first.items():
        n, positive, width = t[0], t[1], (len(t) - 2) // 2
        if positive in (0, n):
            out[key] = Linear(np.zeros(width), np.inf if positive else -np.inf)
            continue
        weight[key] = (n - positive) / positive
        mean[key] = (weight[key] * t[2 : 2 + width] + t[2 + width :]) / (2 * (n - positive))
    if not mean:
        return out
    rows = rows.filter(F.col("_g").isin(list(mean))) if out and whole is None else rows

    def squares(key, x, y):
        if key not in mean:
            return np.zeros(0)
        return np.where(y > 0, weight[key], 1.0) @ (x - mean[key]) ** 2

    spread = {}
    for key, t in _sums_by_group(rows, squares, whole).items():
        n, positive = first[key][:2]
        total = 2 * (n - positive)  # of the weights; Spark's unbiased variance
        spread[key] = np.sqrt(t / (total - (n - positive + positive * weight[key] ** 2) / total))
        spread[key][spread[key] <= 1e-12 * np.abs(mean[key])] = 0.0  # rounding of the mean

    def model(key, point):
        flat = spread[key] == 0
        coefficients = np.where(flat, 0.0, point[:-1] / np.where(flat, 1.0, spread[key]))
        return Linear(coefficients, point[-1] - coefficients @ mean[key])

    running = {key: _minimum(len(mean[key]) + 1, rounds, tol) for key in mean}
    points = {key: next(r) for key, r in running.items()}
    while points:
        at = {key: model(key, p) for key, p in points.items()}

        def gradients(key, x, y, at=at):
            if key not in at:
                return np.zeros(0)
            w = np.where(y > 0, weight[key], 1.0)
            z = x @ at[key].coefficients + at[key].intercept
            loss = w @ (np.logaddexp(0.0, z) - y * z)
            error = w * (_logistic(z) - y)
            return np.concatenate(([loss, error.sum()], error @ x))

        found, points_now, points = _sums_by_group(rows, gradients, whole), points, {}
        for key, p in points_now.items():
            n, positive = first[key][:2]
            loss, off, by_input = found[key][0], found[key][1], found[key][2:]
            flat = spread[key] == 0
            scaled = np.where(flat, 0.0, (by_input - off * mean[key]) / np.where(flat, 1.0, spread[key]))
            total = 2 * (n - positive)
            value = loss / total + penalty / 2 * (p[:-1] @ p[:-1])
            slope = np.append(scaled / total + penalty * p[:-1], off / total)
            try:
                points[key] = running[key].send((value, slope))
            except StopIteration as end:
                out[key] = model(key, end.value)
    return out


def linear_scores(models: Sequence[Linear], df: DataFrame, inputs: str, out: str = "score") -> DataFrame:
    """``df`` and the mean score of linear models on the vector column ``inputs``; NULL where that is NULL."""
    weights, offsets = np.array([m.coefficients for m in models]), np.array([m.intercept for m in models])

    @F.pandas_udf("double")
    def mean_score(x: pd.Series) -> pd.Series:
        known = x.notna()
        found = pd.Series(np.nan, x.index).astype(object)
        if known.any():
            found[known] = _logistic(np.stack(x[known].to_numpy()) @ weights.T + offsets).mean(axis=1)
        return found.where(known, None).astype("Float64")

    return df.withColumn(out, mean_score(_array(inputs)))


def packed_scores(models: Mapping[str, Sequence[Linear]], df: DataFrame, inputs: str) -> DataFrame:
    """``df`` with one column for each entry of ``models``: the mean score of its linear models on the packed rows ``inputs``."""
    by_name = {name: (np.array([m.coefficients for m in own]).T, np.array([m.intercept for m in own])) for name, own in models.items()}

    def fill(b: pa.RecordBatch) -> dict[str, pa.Array]:
        x = packed.matrix(b.column(inputs))
        return {n: pa.array(_logistic(x @ w + at).mean(axis=1) if len(x) else np.zeros(0)) for n, (w, at) in by_name.items()}

    return packed.mapped(df, [T.StructField(n, T.DoubleType()) for n in by_name], fill, [])


def packed_ablate(model: Linear, df: DataFrame, groups: Mapping[str, Sequence[str]], names: Sequence[str], inputs: str) -> DataFrame:
    """``ablate`` for a linear model on packed rows: a row's scores come from one product."""
    left = {v: Linear(np.where([n in set(zeroed) for n in names], 0.0, model.coefficients), model.intercept) for v, zeroed in groups.items()}
    rest = [c for c in df.columns if c != inputs]
    wide = packed_scores({f"_s{i}": [m] for i, m in enumerate(left.values())}, df, inputs)
    each = F.array(*[F.struct(F.lit(v).alias("model"), F.col(f"_s{i}").alias("score")) for i, v in enumerate(left)])
    return wide.select(*rest, F.explode(each).alias("_v")).select(*rest, "_v.*")


def packed_means(df: DataFrame, inputs: str) -> np.ndarray:
    """The mean of every place of packed rows."""
    rows = df.select(F.lit(0).alias("_g"), F.lit(0.0).alias("_y"), F.col(inputs).alias("_x"))
    total = _sums_by_group(rows, lambda key, x, y: np.concatenate(([len(y)], x.sum(axis=0))))[0]
    return total[1:] / total[0]


def packed_top_slots(model: Linear, means: np.ndarray, df: DataFrame, names: Sequence[str], inputs: str, n: int = 5, out: str = "top_features") -> DataFrame:
    """``df`` with ``top_slots`` of the attributions coef * (x - mean) in place of its packed rows."""
    called = np.array(names, dtype=object)

    def fill(b: pa.RecordBatch) -> dict[str, pa.Array]:
        shares = (packed.matrix(b.column(inputs)) - means) * model.coefficients if b.num_rows else np.zeros((0, len(called)))
        at = np.argsort(-np.abs(shares), axis=1, kind="stable")[:, :n]
        items = pa.StructArray.from_arrays([pa.array(called[at].ravel(), pa.string()), pa.array(np.take_along_axis(shares, at, axis=1).ravel())], names=["feature", "shap_value"])
        return {out: pa.ListArray.from_arrays(pa.array(np.arange(len(shares) + 1, dtype=np.int32) * at.shape[1]), items)}

    item = T.StructType([T.StructField("feature", T.StringType()), T.StructField("shap_value", T.DoubleType())])
    return packed.mapped(df, [T.StructField(out, T.ArrayType(item))], fill, [inputs])
