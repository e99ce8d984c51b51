"""Raw rows to model input, scored rows to verdicts, and the drift-triggered refit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txflow.functions import decide
from txflow.functions.clean import missing_count
from txflow.operators import drift, encode, evaluate, learning, packed
from txflow.operators.features import clean_transactions, merchant_features, population_features, typed_transactions, user_features
from txflow.operators.joining import with_row
from txflow.operators.metrics import metrics_at, score_summary
from txflow.operators.split import chrono_split, recent_slice
from txflow.operators.windows import build_windows, serving_vector
from txflow.schema import BASE_COLUMNS, ENRICHED, WINDOW
from txflow.session import cut
from txflow.sources.io import load_encoders, save_encoders

FREQUENCY = ("Merchant Name", "Merchant City", "Zip")
LABEL = ("MCC", "Merchant State")
GAP = "hours_since_last"
# Base columns that are scaled; flags stay 0 or 1.
SCALED = tuple(c for c in BASE_COLUMNS if not c.startswith(("err_", "chip_")))


@dataclass
class Encoding:
    """What the model input needs of the training rows: code tables, and one row of means and deviations of ``SCALED``."""

    codes: dict[str, DataFrame]
    stats: DataFrame

    def save(self, path: str) -> None:
        save_encoders(self.codes, f"{path}/codes")
        self.stats.write.mode("overwrite").parquet(f"{path}/scaler")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Encoding:
        return cls(load_encoders(spark, f"{path}/codes", (*FREQUENCY, *LABEL)), spark.read.parquet(f"{path}/scaler"))

    def coded(self, rows: DataFrame) -> DataFrame:
        """Codes in place of keys; the rows may be a stream, the tables are then joined to each micro-batch."""
        return encode.encode(rows, self.codes).withColumns({c: F.col(f"`{c}`").cast("double") for c in SCALED if c in rows.columns})

    def scaled_window(self, window: str = "window") -> Column:
        """The slots of an unscaled window, scaled: all steps of a column share its mean and deviation."""
        stats = self.stats.first()
        at = {c: i for i, c in enumerate(SCALED)}
        shift = F.array(*[F.lit(float(stats[f"m_{at[c]}"]) if c in at else 0.0) for c in BASE_COLUMNS])
        width = F.array(*[F.lit(float(stats[f"s_{at[c]}"]) if c in at else 1.0) for c in BASE_COLUMNS])
        column = lambda i: F.floor(i / F.lit(WINDOW)).cast("int")
        return F.transform(window, lambda x, i: (x - F.get(shift, column(i))) / F.get(width, column(i)))


def fit_encoding(train: DataFrame) -> Encoding:
    """From clean training rows; the tables are written, since every use reads them again."""
    codes = {c: cut(t) for c, t in encode.fit_encoders(train, FREQUENCY, LABEL).items()}
    unscaled = Encoding(codes, train)
    return Encoding(codes, cut(encode.scaler_stats(unscaled.coded(train), SCALED)))


def keyed_rows(rows: DataFrame) -> DataFrame:
    """Typed rows with their raw keys beside the columns that will be encoded."""
    keep = {f"raw_{n}": F.col(c) for n, c in (
        ("merchant", "Merchant Name"), ("mcc", "MCC"), ("city", "Merchant City"), ("state", "Merchant State"))}
    channel = F.when(F.col("`chip_Chip Transaction`") == 1, "chip").when(F.col("`chip_Online Transaction`") == 1, "online").otherwise("swipe")
    return rows.withColumns({**keep, "raw_channel": channel})


def clean_split(raw: DataFrame, frac: float = 0.8) -> DataFrame:
    """Clean rows with their split: the rows an encoding is fitted on are those of 'train'."""
    return chrono_split(clean_transactions(raw), "User", frac, dealt=True)


def model_input(raw: DataFrame, frac: float = 0.8) -> DataFrame:
    """(tx_id, User, ts, split, label, position, the 33 features, window, vector) from raw text rows.

    Clean, split, encode with training codes, add history features, take windows inside
    each split. The history columns keep the raw keys; the windows get the encoded ones.
    """
    seq = windowed(raw, frac)
    return seq.withColumns({
        "vector": serving_vector("user_tx_count", "seq", BASE_COLUMNS, ENRICHED), "n_missing": missing_count(ENRICHED),
    }).select("tx_id", "User", "ts", "split", "label", *ENRICHED, "n_missing", "vector")


def windowed(raw: DataFrame, frac: float = 0.8) -> DataFrame:
    """The rows of ``model_input`` with ``seq``, their window as an array of structs, in place of the vector."""
    rows = keyed_rows(clean_transactions(raw))
    typed = keyed_rows(typed_transactions(raw))  # the same rows without an exchange, for counting
    # Gap, user features and split share the exchange by user; merchants need their own.
    rich = user_features(rows, "User", "amount_raw", "raw_merchant", "raw_mcc", "raw_channel", "raw_city", "raw_state", dealt=True, measure=typed)
    rich = chrono_split(rich, "User", frac, measure=typed, dealt=True)
    rich = merchant_features(rich, "raw_merchant", "amount_raw", measure=typed, scanned=False)
    parts = cut(population_features(rich, measure=typed))  # read by every encoder and by the rows themselves
    encoding = fit_encoding(parts.filter("split = 'train'"))
    coded = encode.scale(encoding.coded(parts), encoding.stats, SCALED)
    return build_windows(coded, BASE_COLUMNS, ("User", "split"), measure=parts, scanned=False)  # each of the parts' files holds few rows


SLOTS = [f"{c}_t{t}" for c in BASE_COLUMNS for t in range(WINDOW)]
INPUTS = [*SLOTS, *ENRICHED, *(f"{c}__missing" for c in ENRICHED)]


def packed_slots(raw: DataFrame, frac: float = 0.8) -> DataFrame:
    """(tx_id, User, ts, split, label, user_tx_count, x) of rows with a full window: the 243 slots packed, missing ones NaN."""
    rows = windowed(raw, frac).filter(F.col("user_tx_count") >= WINDOW - 1)
    given = rows.select("tx_id", "User", "ts", "split", "label", F.col("user_tx_count").alias("_n"), "seq", *ENRICHED)
    x = packed.packed_windows(given, "seq", BASE_COLUMNS, ENRICHED, "x")
    return x.select("tx_id", "User", "ts", "split", "label", F.col("_n").alias("user_tx_count"), "x")


def packed_inputs(raw: DataFrame, frac: float = 0.8) -> DataFrame:
    """The same with ``x`` as ``INPUTS`` names it: missing slots are 0, and flags tell which history features were missing."""
    def fill(b):
        x = packed.matrix(b.column("x"))
        missing = np.isnan(x)
        return {"x": packed.binary(np.hstack([np.where(missing, 0.0, x), missing[:, len(SLOTS):]]))}

    rows = packed_slots(raw, frac)
    return packed.mapped(rows, [rows.schema["x"]], fill, ["x"])


def training_rows(raw: DataFrame, frac: float = 0.8) -> DataFrame:
    """(tx_id, User, ts, split, label, user_tx_count, inputs) of rows with a full window.

    ``inputs`` is the whole model input as a vector named by ``INPUTS``: 210 window slots, 33 history features and a
    flag for each of these that is missing (its slot holds 0 then).
    """
    return packed.as_vectors(packed_inputs(raw, frac), "x", "inputs")


def window_rows(raw: DataFrame, frac: float = 0.8) -> DataFrame:
    """The same with ``window_inputs``, the first 210 slots, in place of ``inputs``."""
    return packed.as_vectors(packed_inputs(raw, frac), "x", "window_inputs", len(SLOTS))


def model_vector(slots: str) -> Column:
    """The vector that ``INPUTS`` names, from the 243 slots: missing ones become 0, and flags tell which history features were."""
    filled = F.transform(slots, lambda x: F.coalesce(x, F.lit(0.0)))
    flags = F.transform(F.slice(slots, len(SLOTS) + 1, len(ENRICHED)), lambda x: F.when(x.isNull(), 1.0).otherwise(0.0))
    return array_to_vector(F.concat(filled, flags))


def verdicts(scored: DataFrame, threshold: float = decide.THRESHOLD, coefficients: dict | None = None, means: dict | None = None) -> DataFrame:
    """Verdict records of scored rows; rows with too little history carry no score."""
    enough = F.col("user_tx_count") >= decide.COLDSTART_MAX + 1
    df = scored.withColumn("score", F.when(enough, F.col("score")))
    out = learning.explain(df, coefficients or {}, means or {}, "score", threshold) if coefficients else _without_attributions(df, threshold)
    return out.select(
        F.col("tx_id").cast("string").alias("transaction_id"), F.col("user").cast("string").alias("user_id"), "amount",
        F.col("ts").alias("timestamp"), "decision", "rule", "rationale", "top_features", F.col("score").alias("fraud_score_raw"),
        F.when(F.col("score").isNotNull(), F.col("confidence_score")).alias("confidence_score"),
        F.when(F.col("score").isNotNull(), F.col("confidence_reason")).alias("confidence_reason"),
        F.col("user_tx_count").alias("position"), F.col("score").isNotNull().alias("model_invoked"),
    )


def _without_attributions(df: DataFrame, threshold: float) -> DataFrame:
    conf = df.withColumn("_c", decide.confidence_struct("score", threshold=threshold))
    conf = conf.withColumns({"confidence_score": F.col("_c.score"), "confidence_reason": F.col("_c.reason")})
    empty = F.expr("cast(array() as array<struct<feature:string,shap_value:double,value:double>>)")
    v = decide.route("score", "confidence_score", "user_tx_count", prob_block=threshold)
    return conf.withColumn("_v", v).withColumns({
        "decision": F.col("_v.decision"), "rule": F.col("_v.rule"), "top_features": empty,
        "rationale": learning.rationale(empty, F.coalesce(F.col("score"), F.lit(0.0)), threshold),
    }).drop("_c", "_v")


@dataclass
class Refit:
    """Outcome of one drift check; ``candidate`` is set only when a refit ran."""

    trigger: DataFrame
    gate: DataFrame | None = None
    candidate: PipelineModel | None = None
    promoted: bool = False


def refit_on_drift(current: PipelineModel | learning.Linear, reference: DataFrame, monitored: DataFrame, test: DataFrame, inputs: Sequence[str] | str,
                   features: Sequence[str], threshold: float, label: str = "label", kind: str = "trees", recent: float = 0.2, **fit) -> Refit:
    """Drift report -> trigger -> fit on the recent slice -> gate on one test set.

    ``inputs`` are columns, of which ``features`` are watched, or one vector column with the slots ``features``, all watched. It may also name packed rows, with a
    linear ``current``; the candidate's rows alone are then made vectors.
    The candidate's score is the mean of the old and the new model: Spark's trees cannot
    be grown further, and an average keeps what the current model knows.
    """
    rowwise = isinstance(current, learning.Linear)
    if rowwise:
        both = reference.select(inputs, F.lit(True).alias("_ref")).unionByName(monitored.select(inputs, F.lit(False).alias("_ref")))
        table = cut(drift.psi_of_packed(cut(packed.first_of(both, inputs, len(features), "_x"), wide=True), features))
    elif isinstance(inputs, str):
        sides = [d.select(F.slice(vector_to_array(inputs), 1, len(features)).alias("_x")) for d in (reference, monitored)]
        table = cut(drift.psi_of_arrays(*sides, features))
    else:
        table = cut(drift.psi_between(reference, monitored, features))
    trigger = drift.should_retrain(table)
    if not trigger.first()["retrain"]:
        return Refit(trigger)
    latest = recent_slice(reference.unionByName(monitored), recent)
    if rowwise:
        old = packed.as_vectors(learning.packed_scores({"old": [current]}, test.select(label, inputs), inputs), inputs, "_v")
        latest, inputs = cut(packed.as_vectors(latest.select(label, inputs), inputs, "_v")), "_v"
    else:
        old = learning.score(current, test, "old")
    fresh = learning.train(latest, inputs, label, kind=kind, **fit)
    scores = learning.score(fresh, old, "new").withColumn("candidate", decide.fuse("old", "new", 0.5, 0.5))
    both = cut(scores.drop("_v"))

    def judged(score: str) -> DataFrame:
        ap = score_summary(both, score, label).select("average_precision")
        return with_row(ap, metrics_at(both, threshold, score, label).select("f1"))

    result = cut(evaluate.gate(judged("old"), judged("candidate")))
    return Refit(trigger, result, fresh, result.first()["decision"] == "promote")
