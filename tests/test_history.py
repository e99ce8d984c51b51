"""History features against a plain Python loop, with ties, NULL amounts and heavy keys."""

import math
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txflow.operators import features as ft
from txflow.operators.history import Moments, PriorCount, Trailing, heavy_keys, prior
from txflow.operators.split import chrono_split, leaks, mismatches
from txflow.operators.windows import build_windows, count_windows
from txflow.schema import ENRICHED
from txflow.sources.tables import tx_events, tx_orders

T0 = datetime(2024, 1, 1)
SCHEMA = "tx_id long, user long, ts timestamp, amount double, merchant long, mcc string, channel string, city string, state string, label int"

rows = st.lists(
    st.tuples(st.integers(0, 2), st.integers(0, 40), st.one_of(st.none(), st.integers(-300, 300)), st.integers(0, 3), st.integers(0, 2)),
    min_size=1, max_size=25,
)


def frame(spark, data):
    out = [
        (i, u, T0 + timedelta(hours=17 * h), None if a is None else float(a), m, f"c{k}", f"h{k}", f"t{m}", f"s{k}", int(k == 0))
        for i, (u, h, a, m, k) in enumerate(data)
    ]
    return spark.createDataFrame(out, SCHEMA)


def brute(data):
    seq = sorted(((T0 + timedelta(hours=17 * h), i, u, a, m, k) for i, (u, h, a, m, k) in enumerate(data)), key=lambda r: (r[0], r[1]))
    out = {}
    for at, (ts, i, u, a, m, k) in enumerate(seq):
        mine = [r for r in seq[:at] if r[2] == u]
        vals = [r[3] for r in mine if r[3] is not None]
        shop = [r for r in seq[:at] if r[4] == m]
        times = [r[0] for r in mine] + [ts]
        gaps = [(b - c).total_seconds() / 86400 for c, b in zip(times, times[1:])]
        past = gaps[:-1]
        dormant = None
        if len(past) >= 2:
            dormant = int(gaps[-1] > np.mean(past) + 2 * np.std(past, ddof=1))
        out[i] = {
            "user_hist_mean": np.mean(vals) if vals else None,
            "user_hist_std": np.std(vals, ddof=1) if len(vals) > 1 else None,
            "user_hist_max": max(vals) if vals else None,
            "user_tx_count": len(mine),
            "merchant_user_count": sum(r[4] == m for r in mine),
            "first_mcc": int(all(r[5] != k for r in mine)),
            "first_tx_this_month": int(all((r[0].year, r[0].month) != (ts.year, ts.month) for r in mine)),
            "days_since_last_tx": gaps[-1] if gaps else None,
            "is_dormant": dormant,
            "merch_tx_count": len(shop),
            "merch_7d_count": sum(r[0] >= ts - timedelta(days=7) for r in shop),
        }
    return out


def check(got, want):
    for i, expected in want.items():
        for name, v in expected.items():
            g = got[i][name]
            if v is None:
                assert g is None, (i, name, g)
            else:
                assert g is not None and math.isclose(g, v, rel_tol=1e-9, abs_tol=1e-7), (i, name, g, v)


@pytest.mark.parametrize("hot_rows", [10**6, 3])
def test_against_loop(spark, hot_rows):
    @settings(max_examples=6 if hot_rows == 3 else 10, deadline=None, suppress_health_check=list(HealthCheck))
    @given(rows)
    def run(data):
        df = frame(spark, data)
        out = ft.merchant_features(ft.user_features(df, hot_rows=hot_rows), hot_rows=hot_rows, measure=df)
        got = {r["tx_id"]: r.asDict() for r in out.collect()}
        assert len(got) == len(data)
        check(got, brute(data))

    run()


def test_one_key_holding_a_third_is_sliced_and_equal(spark):
    data = [(0 if i % 3 == 0 else i, i % 37, (i * 7919) % 500, i % 5, i % 3) for i in range(300)]
    df = frame(spark, data)
    specs = [Moments("amount", n="n", mean="mean", std="std", max="top"), PriorCount("c"), PriorCount("cm", ("merchant",)), Trailing("t", "c", 5 * 86400)]
    plain = {r["tx_id"]: r for r in prior(df, "user", specs).collect()}
    sliced = prior(df, "user", specs, hot_rows=20)
    assert "_slice" in sliced._jdf.queryExecution().analyzed().toString()
    for r in sliced.collect():
        p = plain[r["tx_id"]]
        assert (r["n"], r["c"], r["cm"], r["t"], r["top"]) == (p["n"], p["c"], p["cm"], p["t"], p["top"])
        for c in ("mean", "std"):
            assert (r[c] is None) == (p[c] is None) and (r[c] is None or math.isclose(r[c], p[c], rel_tol=1e-9))


def test_cut_points_stay_out_of_the_shuffles_of_rows(spark):
    data = [(0 if i % 3 else i % 7, i % 37, (i * 7919) % 500, i % 5, i % 3) for i in range(400)]
    specs = [Moments("amount", n="n", mean="mean"), PriorCount("c"), PriorCount("cm", ("merchant",)), Trailing("t", "c", 5 * 86400)]
    df = frame(spark, data)
    for out in (prior(df, "user", specs, hot_rows=20), build_windows(df.withColumn("split", F.lit("train")), cols=("amount",), hot_rows=20)):
        plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
        exchanged = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
        assert len(exchanged) > 2 and any("_slice" in x or "_block" in x for x in exchanged)
        assert not any("_cuts" in x for x in exchanged)


def test_each_heavy_key_has_the_cuts_it_needs(spark):
    data = [(0, i, 1, 0, 0) for i in range(200)] + [(1, i, 1, 0, 0) for i in range(25)] + [(2, 5, 1, 0, 0) for _ in range(60)]
    cuts = {r["user"]: r["_cuts"] for r in heavy_keys(frame(spark, data), ["user"], hot_rows=20).collect()}
    assert len(cuts[0]) == 9 and len(cuts[1]) == 1
    assert len(cuts[2]) == 2  # one moment, alone in its slice


def test_null_keys_are_one_group_on_both_paths(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1, T0 + timedelta(hours=i), 1.0 * i) for i in range(20)], "tx_id long, user long, ts timestamp, amount double")
    a = {r["tx_id"]: r["n"] for r in prior(df, "user", [PriorCount("n")]).collect()}
    b = {r["tx_id"]: r["n"] for r in prior(df, "user", [PriorCount("n")], hot_rows=4).collect()}
    assert a == b and len(a) == 20


def test_all_features_equal_on_both_paths(spark, sf):
    tx = tx_orders(spark, sf)
    a = {r["tx_id"]: r.asDict() for r in ft.enrich(tx).collect()}
    b = {r["tx_id"]: r.asDict() for r in ft.enrich(tx, hot_rows=15).collect()}
    assert a.keys() == b.keys()
    for i, row in a.items():
        for c in ENRICHED:
            x, y = row[c], b[i][c]
            assert (x is None) == (y is None), (i, c)
            assert x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (i, c, x, y)


def test_features_need_two_exchanges_of_the_rows(spark, sf):
    plan = ft.merchant_features(ft.user_features(tx_events(spark, sf)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(user") == 1
    assert plan.count("Exchange hashpartitioning(merchant") == 1
    assert plan.count("Exchange") == 2


@pytest.mark.parametrize("hot_rows", [10**6, 25])
def test_windows_are_complete_across_blocks(spark, sf, hot_rows):
    df = tx_events(spark, sf)
    got = {r["tx_id"]: [s["tx_id"] for s in r["seq"]] for r in build_windows(df, ["tx_id"], ["user"], hot_rows=hot_rows).collect()}
    by_user = {}
    for r in df.select("user", "ts", "tx_id").orderBy("ts", "tx_id").collect():
        by_user.setdefault(r["user"], []).append(r["tx_id"])
    want = {ids[i]: ids[i - 9:i + 1] for ids in by_user.values() for i in range(9, len(ids))}
    assert got == want
    assert count_windows(df).first()["windows"] == len(want)


def test_window_lengths_nine_ten_eleven(spark):
    data = [(u, i, 1, 0, 0) for u, n in ((0, 9), (1, 10), (2, 11)) for i in range(n)]
    out = build_windows(frame(spark, data), ["amount"], ["user"]).groupBy("user").count().collect()
    assert {r["user"]: r["count"] for r in out} == {1: 1, 2: 2}


def test_split_cutoff_and_no_leak(spark):
    data = [(u, 0, 1, 0, 0) for u, n in ((0, 5), (1, 10), (2, 1)) for _ in range(n)]
    for hot in (10**6, 3):
        sp = chrono_split(frame(spark, data), hot_rows=hot)
        train = {r["user"]: r["count"] for r in sp.filter("split = 'train'").groupBy("user").count().collect()}
        assert train == {0: 4, 1: 8}
        assert leaks(sp).count() == 0


def test_mismatches_finds_missing_and_changed(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "k long, v string")
    assert mismatches(a, a, "k", ["v"]).count() == 0
    assert mismatches(a, b, "k", ["v"]).count() == 3


def test_heavy_rows_are_exchanged_once_by_slice(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = prior(tx_events(spark, sf), "user", [PriorCount("n"), PriorCount("m", ("merchant",)), Moments("amount", mean="x")], hot_rows=10)
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Every other exchange lies above an aggregate and carries one row per slice.
    rows = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(" in x and "HashAggregate" not in lines[i + 1] and "Project" not in lines[i + 1]]
    assert sum("_slice" in lines[i] or "user" in lines[i] for i in rows) <= 2


def test_rows_of_a_task_stay_bounded(spark, sf, monkeypatch):
    """An exchange gets as many partitions as its rows ask for, and AQE does not merge them."""
    from txflow.operators import history

    monkeypatch.setattr(history, "HOT_ROWS", 100)
    df = tx_events(spark, sf)
    out = prior(df, "user", [PriorCount("n"), PriorCount("m", ("merchant",))], hot_rows=100)
    rows = df.count()
    assert out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] < rows / 2
    assert out.select("tx_id", "n", "m").exceptAll(prior(df, "user", [PriorCount("n"), PriorCount("m", ("merchant",))], hot_rows=10**6).select("tx_id", "n", "m")).count() == 0


def test_keys_below_the_bound_do_not_fill_a_task_together(spark):
    """Twenty keys of 60,000 rows: the fullest of their partitions stays near the bound of one key."""
    df = spark.range(1_200_000).select(F.col("id").alias("tx_id"), (F.col("id") % 20).alias("user"), F.timestamp_seconds("id").alias("ts"))
    out = prior(df, "user", [PriorCount("n")])
    assert out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] <= 100_000
    assert out.filter(F.col("n") != F.floor(F.col("tx_id") / 20)).isEmpty()


def test_rows_of_a_trailing_count_are_dealt_by_their_number(spark, sf, monkeypatch):
    from txflow.operators import history

    monkeypatch.setattr(history, "HOT_ROWS", 100)
    specs = [PriorCount("c"), Trailing("t", "c", 5 * 86400)]
    out = prior(tx_events(spark, sf), "merchant", specs, hot_rows=5)
    # A number of partitions that is asked for is one that AQE leaves as it is.
    assert any("_group" in x and "_at" in x and "REPARTITION_BY_NUM" in x for x in out._jdf.queryExecution().executedPlan().toString().split("\n"))
    plain = prior(tx_events(spark, sf), "merchant", specs, hot_rows=10**6)
    assert out.select("tx_id", "c", "t").exceptAll(plain.select("tx_id", "c", "t")).isEmpty()


def test_scanned_rows_are_not_sorted_for_many_partitions(spark, sf, monkeypatch):
    """A scan's task would hold all its rows in memory to sort them by more than 200 partitions; dealt evenly before, it holds few."""
    from txflow.operators import history

    monkeypatch.setattr(history, "HOT_ROWS", 5)
    df = tx_events(spark, sf)
    specs = [PriorCount("n"), PriorCount("m", ("merchant",))]

    def below(out):
        """The operators under the first exchange by user."""
        lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
        return "\n".join(lines[next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(user#" in x) + 1:][:3])

    out = prior(df, "user", specs, hot_rows=5)
    for dealt in (out, build_windows(df, ["amount"], ["user"], hot_rows=5)):
        assert "Exchange hashpartitioning(_deal#" in below(dealt) and ", 200), REPARTITION_BY_NUM" in below(dealt)
    assert "_deal" not in below(prior(df, "user", specs, hot_rows=5, scanned=False))
    plain = prior(df, "user", specs, hot_rows=10**6)
    assert out.count() == df.count() and out.select("tx_id", "n", "m").exceptAll(plain.select("tx_id", "n", "m")).isEmpty()
