"""Confidence score, routing and the labels built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txflow.functions.clean import _c

# Fixed values of the decision rules.
THRESHOLD = 0.9497
CERT_BELOW_SCALE, CERT_ABOVE_SCALE = 0.30, 0.04
HISTORY_FULL = 200
MERCHANT_FULL, MCC_FULL = 50, 30
NOVELTY_COST = {"first_mcc": 0.30, "first_city_state": 0.15, "first_channel": 0.10}
MISSING_COST, N_INPUTS = 5.0, 243
WEIGHTS = {"certainty": 0.35, "history": 0.15, "familiarity": 0.20, "novelty": 0.20, "completeness": 0.10}
REASONS = {
    "certainty": "prediction near decision threshold",
    "history": "thin user history",
    "familiarity": "unfamiliar merchant or category",
    "novelty": "first-time merchant/location/channel",
    "completeness": "missing feature data",
}
ALL_STRONG = "all signals strong"
STRONG_FROM = 0.85
PROB_BLOCK, CONF_STEPUP, COLDSTART_MAX = 0.9497, 0.75, 8
REVIEW_BAND_LOW = 0.90


def confidence_components(
    prob, user_tx_count="user_tx_count", merchant_user_count="merchant_user_count", mcc_user_count="mcc_user_count",
    first_mcc="first_mcc", first_city_state="first_city_state", first_channel="first_channel",
    n_missing="n_missing", threshold: float = THRESHOLD, n_inputs: int = N_INPUTS,
) -> dict[str, Column]:
    """The five components, each in [0, 1]."""
    p, t = _c(prob), F.lit(float(threshold))
    one, zero = F.lit(1.0), F.lit(0.0)

    def depth(count, full):
        return F.least(F.log1p(_c(count)) / F.log1p(F.lit(float(full))), one)

    paid = one
    for name, col in (("first_mcc", first_mcc), ("first_city_state", first_city_state), ("first_channel", first_channel)):
        paid = paid - F.lit(NOVELTY_COST[name]) * _c(col)
    return {
        "certainty": F.when(p < t, F.least((t - p) / CERT_BELOW_SCALE, one))
        .otherwise(F.least((p - t) / CERT_ABOVE_SCALE, one)),
        "history": F.least(_c(user_tx_count) / F.lit(float(HISTORY_FULL)), one),
        "familiarity": F.least(depth(merchant_user_count, MERCHANT_FULL), depth(mcc_user_count, MCC_FULL)),
        "novelty": F.greatest(paid, zero),
        "completeness": F.greatest(one - F.lit(MISSING_COST) * _c(n_missing) / F.lit(float(n_inputs)), zero),
    }


def confidence(components: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * components[name]
    return total


def weakest(components: dict[str, Column]) -> Column:
    """Name of the lowest component, the first one on ties."""
    low = F.least(*components.values())
    names = [F.when(c == low, F.lit(name)) for name, c in components.items()]
    return F.coalesce(*names)


def confidence_reason(components: dict[str, Column]) -> Column:
    low = F.least(*components.values())
    texts = [F.when(c == low, F.lit(REASONS[name])) for name, c in components.items()]
    return F.when(low >= STRONG_FROM, F.lit(ALL_STRONG)).otherwise(F.coalesce(*texts))


def confidence_struct(prob, **kwargs) -> Column:
    """STRUCT<score, reason, weakest, components>."""
    parts = confidence_components(prob, **kwargs)
    return F.struct(
        confidence(parts).alias("score"), confidence_reason(parts).alias("reason"),
        weakest(parts).alias("weakest"), F.struct(*[c.alias(n) for n, c in parts.items()]).alias("components"),
    )


def route(
    prob, conf, position, prob_block=PROB_BLOCK, conf_stepup=CONF_STEPUP, coldstart_max: int = COLDSTART_MAX
) -> Column:
    """STRUCT<decision, rule>; the first matching rule wins.

    ``prob_block`` and ``conf_stepup`` may be columns, for what-if sweeps.
    """
    def num(x):
        return x if isinstance(x, Column) else F.lit(float(x))

    def verdict(decision, rule):
        return F.struct(F.lit(decision).alias("decision"), F.lit(rule).alias("rule"))

    pos, sure, p = _c(position), F.coalesce(_c(conf), F.lit(0.0)), _c(prob)
    return (
        F.when(pos == 0, verdict("step_up", "cold_start_first_tx"))
        .when(pos <= coldstart_max, verdict("approve", "cold_start_safe"))
        .when(sure < num(conf_stepup), verdict("step_up", "low_confidence"))
        .when(p >= num(prob_block), verdict("block", "high_prob_high_conf"))
        .otherwise(verdict("approve", "confident_approve"))
    )


def confidence_tier(score) -> Column:
    s = _c(score)
    return F.when(s >= 0.85, "High").when(s >= 0.75, "Moderate").when(s.isNotNull(), "Low").otherwise("N/A")


def segment(position) -> Column:
    """History depth: no history, cold start, or enough for the model."""
    p = _c(position)
    return F.when(p == 0, "step_up").when(p <= COLDSTART_MAX, "cold_start").otherwise("main_model")


def fuse(a, b, w1: float = 0.9, w2: float = 0.1) -> Column:
    return F.lit(w1) * _c(a) + F.lit(w2) * _c(b)


def rare_slices(zscore="user_amount_zscore", mean="user_hist_mean", std="user_hist_std", amount="amount",
                first_mcc="first_mcc", first_city_state="first_city_state", z_limit: float = 2.0) -> dict[str, Column]:
    """Boolean slice masks. With zero prior spread any amount above the mean is unusual."""
    spike = F.coalesce(_c(zscore) > z_limit, (_c(std) == 0) & (_c(amount) > _c(mean)), F.lit(False))
    mcc, place = _c(first_mcc) == 1, _c(first_city_state) == 1
    rare = spike | mcc | place
    return {"amount_unusual": spike, "new_mcc": mcc, "new_location": place, "rare_any": rare, "ordinary": ~rare}
