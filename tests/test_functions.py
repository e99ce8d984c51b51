import math

import pytest
from pyspark.sql import functions as F

from txflow.functions import clean as c
from txflow.functions import decide
from txflow.operators import encode, learning
from txflow.schema import BASE_COLUMNS, ENRICHED, N_FEATURES, check_columns, slot_names

# prob, confidence, position -> decision, rule
ROUTER = [
    (.50, .90, 0, "step_up", "cold_start_first_tx"), (.99, .90, 5, "approve", "cold_start_safe"),
    (.99, .99, 8, "approve", "cold_start_safe"), (.99, .99, 9, "block", "high_prob_high_conf"),
    (.98, .90, 1000, "block", "high_prob_high_conf"), (.01, .95, 1000, "approve", "confident_approve"),
    (.96, .60, 5000, "step_up", "low_confidence"), (.9497, .75, 100, "block", "high_prob_high_conf"),
    (.96, .7499, 100, "step_up", "low_confidence"), (.05, .40, 50, "step_up", "low_confidence"),
    (.93, .80, 5000, "approve", "confident_approve"), (.9496, .80, 100, "approve", "confident_approve"),
]


def test_router_cases(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROUTER)], "p double, c double, pos int, d string, r string, i int")
    got = df.withColumn("v", decide.route("p", "c", "pos")).collect()
    assert [(r["v"]["decision"], r["v"]["rule"]) for r in got] == [(r["d"], r["r"]) for r in got]


def test_confidence_by_hand(spark):
    df = spark.createDataFrame([(0.99, 400, 60, 40, 0, 0, 0, 0), (0.95, 0, 0, 0, 1, 1, 1, 33)],
                               "p double, user_tx_count int, merchant_user_count int, mcc_user_count int, first_mcc int, first_city_state int, first_channel int, n_missing int")
    a, b = [r["c"] for r in df.select(decide.confidence_struct("p").alias("c")).collect()]
    assert a["score"] == pytest.approx(1.0) and a["reason"] == "all signals strong"
    certainty = (0.95 - 0.9497) / 0.04
    assert b["score"] == pytest.approx(.35 * certainty + .2 * .45 + .1 * (1 - 5 * 33 / 243))
    assert b["reason"] == "thin user history" and b["weakest"] == "history"


def test_cleaning_edges(spark):
    df = spark.createDataFrame([("$-1,077.05", "", "Online Transaction", ""), ("$0.00", "", "Swipe Transaction", "NY"), ("$12.5", "11201.0", "Chip Transaction", "CA")],
                               "a string, z string, u string, s string")
    got = df.select(c.parse_amount("a"), c.clean_zip("z", "u"), c.clean_state("s", "u"), c.clean_city("s", "u")).collect()
    assert [tuple(r) for r in got] == [(-1077.05, "00000", "ONLINE", " ONLINE"), (0.0, "MISSING", "NY", "NY"), (12.5, "11201", "CA", "CA")]


def test_guarded_ratio_and_bins(spark):
    row = spark.range(1).select(
        c.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("none"), c.safe_ratio(F.lit(1.0), F.lit(4.0)).alias("some"),
        c.bin_index(F.lit(0.5), [0, .5, .7, 1]).alias("edge"), c.bin_index(F.lit(-3), [0, .5, 1]).alias("low"), c.signed_log1p(F.lit(-1.0)).alias("log")).first()
    assert row["none"] is None and row["some"] == 0.25 and row["edge"] == 1 and row["low"] == 0 and row["log"] == pytest.approx(-math.log(2))


def test_unseen_codes_and_scaling(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 3.0), ("a", 5.0)], "k string, x double")
    test = spark.createDataFrame([("a", 3.0), ("zz", 3.0), (None, 1.0)], "k string, x double")
    labels = encode.apply_codes(test, encode.label_table(train, "k"), "k", "code").collect()
    assert sorted((r["k"] or "", r["code"]) for r in labels) == [("", 0), ("a", 0), ("zz", 0)]
    assert {r["k"]: r["code"] for r in encode.apply_codes(train, encode.label_table(train, "k"), "k", "code").collect()} == {"a": 0, "b": 1}
    freq = {r["k"]: r["code"] for r in encode.apply_codes(test, encode.frequency_table(train, "k"), "k", "code").collect()}
    assert freq["a"] == pytest.approx(math.log(3)) and freq["zz"] == 0
    flat = train.withColumn("same", F.lit(2.0))
    z = encode.scale(flat, encode.scaler_stats(flat, ["x", "same"]), ["x", "same"]).collect()
    std = math.sqrt(sum((v - 3) ** 2 for v in (1, 3, 5)) / 3)
    assert sorted(r["x"] for r in z) == pytest.approx([-2 / std, 0, 2 / std]) and all(r["same"] == 0 for r in z)


def test_input_layout():
    names = slot_names()
    assert len(BASE_COLUMNS) == 21 and len(ENRICHED) == 33 and len(names) == N_FEATURES == 243
    assert names[39] == "Zip_t9" and names[0] == "Merchant Name_t0" and names[210] == "user_hist_mean"


def test_missing_columns():
    with pytest.raises(ValueError):
        check_columns(["a"], ["a", "b"])
    assert check_columns(["a"], ["a"], ["c"]) == ["c"]


def test_rationale_texts(spark):
    top = "array(named_struct('feature','first_mcc','shap_value',{s1}D,'value',1.0D),named_struct('feature','merchant_user_count','shap_value',{s2}D,'value',{v}D))"
    def say(s1, s2, v, p):
        return spark.range(1).select(learning.rationale(F.expr(top.format(s1=s1, s2=s2, v=v)), F.lit(p), 0.9)).first()[0]
    both = say(0.5, 0.2, 0.0, 0.95)
    assert both == ("Flagged primarily because this is the user's first transaction in this merchant category, and "
                    "the user has never visited this merchant before.")
    assert say(-0.5, 0.2, 2.0, 0.95) == "Flagged primarily because the user has only 2 times visited this merchant before."
    assert say(-0.5, -0.2, 2.0, 0.95).startswith("Flagged primarily because the transaction's overall pattern")
    assert "Some risk indicators are present (this is" in say(-0.5, 0.2, 1.0, 0.1)
    assert "only 1 time visited" in say(-0.5, 0.2, 1.0, 0.1)
    calm = spark.range(1).select(learning.rationale(F.expr("cast(array() as array<struct<feature:string,shap_value:double,value:double>>)"), F.lit(.1), .9)).first()[0]
    assert calm.startswith("Not flagged. Feature values are consistent")


def test_attributions_add_up(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, -4.0)], "a double, b double")
    shares = learning.linear_attributions(df, {"a": 2.0, "b": -1.0}, {"a": 0.5, "b": 1.0})
    got = df.select(shares["a"].alias("a"), shares["b"].alias("b"), learning.top_by_magnitude(shares, 1)[0]["feature"].alias("t")).collect()
    assert [tuple(r) for r in got] == [(1.0, -1.0, "a"), (0.0, 5.0, "b")]
