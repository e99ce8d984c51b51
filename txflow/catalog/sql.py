"""Common table expressions for the oracle queries, written for DuckDB."""

from __future__ import annotations

_EVENT = """
 SELECT event_id AS tx_id, user_id AS "user", ts, value AS amount, k AS merchant, event_type AS mcc,
  CASE k % 3 WHEN 0 THEN 'Swipe Transaction' WHEN 1 THEN 'Online Transaction' ELSE 'Chip Transaction' END AS channel,
  'City' || (k % 17) AS city, 'S' || (k % 5) AS state, CAST(event_type = 'error' AS INTEGER) AS label
 FROM (SELECT *, CAST(props ->> '$.k' AS BIGINT) AS k FROM events)"""

_ORDER = """
 SELECT o_orderkey AS tx_id, o_custkey AS "user", o_orderdate AS ts, o_totalprice AS amount,
  CAST(c_nationkey AS BIGINT) AS merchant, o_orderpriority AS mcc, o_orderstatus AS channel,
  'City' || (o_orderkey % 17) AS city, 'S' || (o_orderkey % 5) AS state,
  CAST(o_orderstatus = 'F' AS INTEGER) AS label
 FROM orders JOIN customer ON o_custkey = c_custkey"""

_RAW = """
 SELECT event_id AS tx_id, CAST(user_id AS VARCHAR) AS "User", CAST(event_id % 3 AS VARCHAR) AS "Card",
  CAST(year(ts) AS VARCHAR) AS "Year", CAST(month(ts) AS VARCHAR) AS "Month", CAST(day(ts) AS VARCHAR) AS "Day",
  hour(ts) || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') AS "Time",
  '$' || CASE WHEN event_id % 10 = 0 THEN '-' ELSE '' END || format('{:,.2f}', value * 10) AS "Amount",
  CASE k % 3 WHEN 0 THEN 'Swipe Transaction' WHEN 1 THEN 'Online Transaction' ELSE 'Chip Transaction' END AS "Use Chip",
  'M' || k AS "Merchant Name",
  CASE WHEN k % 3 = 1 THEN ' ONLINE' ELSE 'City' || (k % 17) END AS "Merchant City",
  CASE WHEN k % 3 = 1 THEN '' ELSE 'S' || (k % 5) END AS "Merchant State",
  CASE WHEN k % 3 = 1 OR event_id % 50 = 0 THEN '' ELSE (k + 10000) || '.0' END AS "Zip",
  CAST(k % 12 + 5000 AS VARCHAR) AS "MCC",
  CASE WHEN event_id % 77 = 0 THEN 'Bad PIN,Insufficient Balance,' WHEN event_id % 7 = 0 THEN 'Bad PIN,'
   WHEN event_id % 13 = 0 THEN 'Technical Glitch,' ELSE '' END AS "Errors?",
  CASE WHEN event_type = 'error' THEN 'Yes' ELSE 'No' END AS "Is Fraud?"
 FROM (SELECT *, CAST(props ->> '$.k' AS BIGINT) AS k FROM events)"""

_ERRS = ("Bad CVV", "Bad Card Number", "Bad Expiration", "Bad PIN", "Bad Zipcode", "Insufficient Balance", "Technical Glitch")

_CLEAN = """
 SELECT tx_id, "User", "Merchant Name", "Merchant City",
  CASE WHEN "Merchant State" = '' AND "Use Chip" = 'Online Transaction' THEN 'ONLINE' ELSE "Merchant State" END AS "Merchant State",
  CASE WHEN "Zip" <> '' THEN regexp_replace("Zip", '[.]0$', '') WHEN "Use Chip" = 'Online Transaction' THEN '00000'
   ELSE 'MISSING' END AS "Zip", "MCC", amount_raw, sign(amount_raw) * ln(1 + abs(amount_raw)) AS amount_log,
  coalesce(epoch(ts - lag(ts) OVER (PARTITION BY "User" ORDER BY ts, tx_id)) / 3600.0, 0) AS hours_since_last,
  """ + ", ".join(f"""CAST("Errors?" LIKE '%{e}%' AS INTEGER) AS "err_{e}" """ for e in _ERRS) + """,
  hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month,
  CAST("Use Chip" = 'Chip Transaction' AS INTEGER) AS "chip_Chip Transaction",
  CAST("Use Chip" = 'Online Transaction' AS INTEGER) AS "chip_Online Transaction",
  CAST("Use Chip" = 'Swipe Transaction' AS INTEGER) AS "chip_Swipe Transaction",
  CAST("Is Fraud?" = 'Yes' AS INTEGER) AS label, ts
 FROM (SELECT *, CAST(replace(ltrim("Amount", '$'), ',', '') AS DOUBLE) AS amount_raw,
   strptime("Year" || '-' || lpad("Month", 2, '0') || '-' || lpad("Day", 2, '0') || ' ' || lpad("Time", 5, '0'), '%Y-%m-%d %H:%M') AS ts
  FROM raw)"""


def _user(src: str) -> str:
    return f"""
 SELECT *, CAST(cnt AS BIGINT) AS user_tx_count,
  CASE WHEN user_hist_std > 0 THEN (amount - user_hist_mean) / user_hist_std END AS user_amount_zscore,
  CASE WHEN abs(user_hist_max) > 1e-8 THEN amount / user_hist_max END AS user_amount_to_max_ratio,
  CAST(merchant_user_count = 0 AS INTEGER) AS is_new_merchant,
  CASE WHEN abs(same_month_last_year_mean) > 1e-8 THEN amount / same_month_last_year_mean END AS amount_vs_last_year_ratio,
  CAST(isodow(ts) > 5 AS INTEGER) AS is_weekend, CAST(month(ts) IN (11, 12) AS INTEGER) AS is_holiday_season,
  dayofyear(ts) AS day_of_year,
  CASE WHEN cnt > 0 THEN CAST(amount > user_hist_max AS INTEGER) END AS is_largest_ever,
  CASE WHEN cnt > 0 THEN CAST(amount > 2 * user_hist_max AS INTEGER) END AS is_2x_hist_max,
  CASE WHEN cnt > 0 THEN CAST(amount > 5 * user_hist_max AS INTEGER) END AS is_5x_hist_max,
  CAST(mcc_user_count = 0 AS INTEGER) AS first_mcc,
  CASE WHEN gaps >= 2 THEN CAST(days_since_last_tx > gap_mean + 2 * gap_std AS INTEGER) END AS is_dormant
 FROM (SELECT *,
   count(days_since_last_tx) OVER p AS gaps, avg(days_since_last_tx) OVER p AS gap_mean,
   stddev_samp(days_since_last_tx) OVER p AS gap_std
  FROM (SELECT t.*,
    avg(amount) OVER p AS user_hist_mean, stddev_samp(amount) OVER p AS user_hist_std, max(amount) OVER p AS user_hist_max,
    count(*) OVER p AS cnt,
    row_number() OVER (PARTITION BY "user", merchant ORDER BY ts, tx_id) - 1 AS merchant_user_count,
    row_number() OVER (PARTITION BY "user", mcc ORDER BY ts, tx_id) - 1 AS mcc_user_count,
    CAST(row_number() OVER (PARTITION BY "user", city, state ORDER BY ts, tx_id) = 1 AS INTEGER) AS first_city_state,
    CAST(row_number() OVER (PARTITION BY "user", channel ORDER BY ts, tx_id) = 1 AS INTEGER) AS first_channel,
    CAST(row_number() OVER (PARTITION BY "user", year(ts), month(ts) ORDER BY ts, tx_id) = 1 AS INTEGER) AS first_tx_this_month,
    CAST(row_number() OVER (PARTITION BY "user", year(ts) ORDER BY ts, tx_id) = 1 AS INTEGER) AS first_tx_this_year,
    epoch_us(ts) / 864e8 - lag(epoch_us(ts)) OVER (PARTITION BY "user" ORDER BY ts, tx_id) / 864e8 AS days_since_last_tx,
    ly.m AS same_month_last_year_mean
   FROM {src} t LEFT JOIN (SELECT "user" AS u, year(ts) + 1 AS y, month(ts) AS mo, avg(amount) AS m FROM {src} GROUP BY ALL) ly
    ON ly.u = t."user" AND ly.y = year(t.ts) AND ly.mo = month(t.ts)
   WINDOW p AS (PARTITION BY "user" ORDER BY ts, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WINDOW p AS (PARTITION BY "user" ORDER BY ts, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _merchant(src: str) -> str:
    return f"""
 SELECT *, CASE WHEN 7 * merch_tx_count / greatest(merch_days_active, 1.0) > 0.1
   THEN merch_7d_count / (7 * merch_tx_count / greatest(merch_days_active, 1.0)) END AS merch_spike_ratio,
  CASE WHEN abs(mstd) > 1e-8 THEN (amount - merch_hist_amount_mean) / mstd END AS merch_amount_deviation
 FROM (SELECT *, count(*) OVER p AS merch_tx_count,
   row_number() OVER (PARTITION BY merchant ORDER BY ts, tx_id) - 1
    - count(*) OVER (PARTITION BY merchant ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '7 days 1 microsecond' PRECEDING)
    AS merch_7d_count,
   (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY merchant))) / 864e8 AS merch_days_active,
   avg(amount) OVER p AS merch_hist_amount_mean, stddev_pop(amount) OVER p AS mstd,
   avg(CAST(abs(amount) > 200 AS INTEGER)) OVER p AS merch_large_tx_rate
  FROM {src}
  WINDOW p AS (PARTITION BY merchant ORDER BY ts, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _population(src: str) -> str:
    return f"""
 SELECT day, n, coalesce(lag(n) OVER (ORDER BY day), 0) AS pop_prior_day_count,
  coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0)
   / CAST(least(7, row_number() OVER (ORDER BY day)) AS DOUBLE) AS pop_7d_avg_count
 FROM (SELECT d.day, coalesce(c.n, 0) AS n
  FROM (SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS day FROM {src}) d
  LEFT JOIN (SELECT ts::DATE AS day, count(*) AS n FROM {src} GROUP BY 1) c ON c.day = d.day)"""


CONFIDENCE = """
 SELECT *, .35 * certainty + .15 * history + .20 * familiarity + .20 * novelty + .10 * completeness AS conf,
  least(certainty, history, familiarity, novelty, completeness) AS low
 FROM (SELECT *,
   CASE WHEN score_a < CAST(0.9497 AS DOUBLE) THEN least((CAST(0.9497 AS DOUBLE) - score_a) / 0.3, 1)
    ELSE least((score_a - CAST(0.9497 AS DOUBLE)) / 0.04, 1) END AS certainty,
   least(user_tx_count / 200.0, 1) AS history,
   least(ln(1 + merchant_user_count) / ln(51.0), ln(1 + mcc_user_count) / ln(31.0), 1) AS familiarity,
   greatest(1 - CAST(.3 AS DOUBLE) * first_mcc - CAST(.15 AS DOUBLE) * first_city_state - CAST(.1 AS DOUBLE) * first_channel, 0) AS novelty,
   greatest(1 - CAST(5 AS DOUBLE) * n_missing / 243, 0) AS completeness
  FROM (SELECT *, CAST(user_hist_mean IS NULL AS INTEGER) + CAST(user_hist_std IS NULL AS INTEGER)
    + CAST(user_hist_max IS NULL AS INTEGER) + CAST(user_amount_zscore IS NULL AS INTEGER)
    + CAST(same_month_last_year_mean IS NULL AS INTEGER) + CAST(days_since_last_tx IS NULL AS INTEGER) AS n_missing
   FROM sc))"""

REASON = """CASE WHEN low >= 0.85 THEN 'all signals strong' WHEN certainty = low THEN 'prediction near decision threshold'
 WHEN history = low THEN 'thin user history' WHEN familiarity = low THEN 'unfamiliar merchant or category'
 WHEN novelty = low THEN 'first-time merchant/location/channel' ELSE 'missing feature data' END"""


def route_sql(p="score_a", c="conf", pos="user_tx_count", block="0.9497", stepup="0.75") -> tuple[str, str]:
    rule = (
        f"CASE WHEN {pos} = 0 THEN 'cold_start_first_tx' WHEN {pos} <= 8 THEN 'cold_start_safe' "
        f"WHEN {c} < CAST({stepup} AS DOUBLE) THEN 'low_confidence' WHEN {p} >= CAST({block} AS DOUBLE) "
        "THEN 'high_prob_high_conf' ELSE 'confident_approve' END"
    )
    decision = (
        f"CASE WHEN {pos} = 0 THEN 'step_up' WHEN {pos} <= 8 THEN 'approve' WHEN {c} < CAST({stepup} AS DOUBLE) "
        f"THEN 'step_up' WHEN {p} >= CAST({block} AS DOUBLE) THEN 'block' ELSE 'approve' END"
    )
    return decision, rule


_DECISION, _RULE = route_sql()
# The routing queries use thresholds inside the range the closed-form score reaches.
_DECISION_LOW, _RULE_LOW = route_sql(block="0.7", stepup="0.6")

# (name, needed before it, definition)
_CTES = {
    "tx": ((), _EVENT),
    "txo": ((), _ORDER),
    "raw": ((), _RAW),
    "clean": (("raw",), _CLEAN),
    "uf": (("tx",), _user("tx")),
    "ufo": (("txo",), _user("txo")),
    "mf": (("tx",), _merchant("tx")),
    "mfo": (("txo",), _merchant("txo")),
    "pop": (("tx",), _population("tx")),
    "popo": (("txo",), _population("txo")),
    "sc": (("uf",), """
 SELECT *, round(amount / (amount + 50), 3) AS score_a, round(amount / (amount + 20 + merchant), 3) AS score_b,
  coalesce(user_amount_zscore > 2, false) OR coalesce(user_hist_std = 0 AND amount > user_hist_mean, false) AS amount_unusual
 FROM uf"""),
    "cf": (("sc",), CONFIDENCE),
    "rt": (("cf",), f"SELECT *, {_DECISION_LOW} AS decision, {_RULE_LOW} AS rule FROM cf"),
    "long": (("sc",), """
 SELECT tx_id, label, user_tx_count, amount_unusual, first_mcc, first_city_state, m AS model, s AS score
 FROM sc, LATERAL (SELECT unnest(['a', 'b']) AS m, unnest([score_a, score_b]) AS s)"""),
    # cumulative counts per model, best score first
    "curve": (("long",), """
 SELECT model, score, sum(n) OVER w AS flagged, sum(p) OVER w AS tp, sum(p) OVER (PARTITION BY model) AS pos,
  sum(n) OVER (PARTITION BY model) AS total, n, p
 FROM (SELECT model, score, count(*) AS n, sum(label) AS p FROM long GROUP BY ALL)
 WINDOW w AS (PARTITION BY model ORDER BY score DESC)"""),
}


def head(*names: str) -> str:
    """The WITH list of the named expressions and what they need, to be continued."""
    need: list[str] = []

    def add(n):
        for d in _CTES[n][0]:
            add(d)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in need) + "\n"


def S(body: str, *names: str) -> str:  # noqa: N802
    """``body`` with the named expressions in front."""
    return (head(*names) if names else "") + body
