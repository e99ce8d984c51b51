"""Files, artifacts, and the message stream from JSON to verdicts."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from txflow.operators import encode, learning
from txflow.plans import flows
from txflow.sources import io
from txflow.sources.tables import raw_events, tx_events
from txflow.streaming import verdicts as st

# hour, merchant, mcc, amount, channel -> merchant_user_count, first_mcc, first_channel, is_dormant
CASE = [
    (0, "M-A", "5411", 20, "Chip", 0, 1, 1, None), (1, "M-A", "5411", 25, "Chip", 1, 0, 0, None), (3, "M-B", "5812", 30, "Chip", 0, 1, 0, None),
    (4, "M-A", "5411", 22, "Chip", 2, 0, 0, 0), (6, "M-C", "5812", 28, "Online", 0, 0, 1, 0), (7, "M-B", "5812", 31, "Chip", 1, 0, 0, 0),
    (9, "M-A", "5999", 200, "Chip", 3, 1, 0, 0), (129, "M-A", "5411", 24, "Chip", 4, 0, 0, 1), (130, "M-D", "6011", 15, "Chip", 0, 1, 0, 0),
    (132, "M-A", "5411", 26, "Chip", 5, 0, 0, 0),
]
START = datetime(2026, 3, 1, 10)


def messages(rows=CASE, first=0):
    return [json.dumps({
        "transaction_id": f"txn-{first + i}", "user_id": "stream-test-user", "timestamp": (START + timedelta(hours=r[0])).isoformat(),
        "amount": float(r[3]), "use_chip": f"{r[4]} Transaction", "merchant_name": r[1], "merchant_city": "Testville", "merchant_state": "NY",
        "zip_code": "10001", "mcc": r[2], "errors": []}) for i, r in enumerate(rows)]


def drain(spark, folder, build, out="out"):
    stream = io.read_topic(spark, "text", path=str(folder / "in"))
    run = st.start(build(st.transactions_of(stream)), str(folder / out), str(folder / "checkpoint"), drain=True)
    run.awaitTermination()
    return spark.read.parquet(str(folder / out))


def put(folder, name, lines):
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / name).write_text("\n".join(lines) + "\n")


def test_ten_row_case_with_restart(spark, tmp_path):
    put(tmp_path, "a.txt", messages(CASE[:6]))
    drain(spark, tmp_path, st.stream_features)
    put(tmp_path, "b.txt", messages(CASE[6:], 6))
    rows = {r["tx_id"]: r for r in drain(spark, tmp_path, st.stream_features).collect()}
    assert len(rows) == 10
    for i, r in enumerate(CASE):
        g = rows[f"txn-{i}"]
        assert (g["merchant_user_count"], g["first_mcc"], g["first_channel"], g["is_dormant"]) == r[5:], i
        assert g["user_tx_count"] == i and g["is_late"] == 0
        assert (g["window"] is not None) == (i == 9)
    assert len(rows["txn-9"]["window"]) == 50


def test_verdicts_cold_start_then_scored(spark, tmp_path):
    put(tmp_path, "a.txt", messages())
    score = lambda d: d.withColumn("score", F.lit(0.99))
    rows = sorted(drain(spark, tmp_path, lambda s: st.score_stream(s, score)).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(10))
    assert [r["model_invoked"] for r in rows] == [False] * 9 + [True]
    assert rows[0]["decision"] == "step_up" and rows[0]["rule"] == "cold_start_first_tx" and rows[0]["fraud_score_raw"] is None
    assert all(r["rule"] == "cold_start_safe" for r in rows[1:9])
    assert rows[9]["fraud_score_raw"] == 0.99 and rows[9]["confidence_score"] is not None and rows[9]["rationale"].startswith("Flagged")


def test_late_row_is_marked_and_does_not_move_time(spark, tmp_path):
    put(tmp_path, "a.txt", messages(CASE[:3]))
    drain(spark, tmp_path, st.stream_features)
    put(tmp_path, "b.txt", messages([(2, "M-A", "5411", 5, "Chip"), (5, "M-A", "5411", 5, "Chip")], 3))
    # One file is one micro-batch, sorted by time: the late row comes first.
    rows = {r["tx_id"]: r for r in drain(spark, tmp_path, st.stream_features).collect()}
    assert rows["txn-3"]["is_late"] == 1 and rows["txn-3"]["days_since_last_tx"] is None
    assert rows["txn-4"]["is_late"] == 0 and rows["txn-4"]["days_since_last_tx"] == pytest.approx(2 / 24)


def test_erase_forgets_a_user(spark, tmp_path):
    def build(s):
        return st.stream_features(s.withColumn("erase", F.col("tx_id") == "txn-4"))

    put(tmp_path, "a.txt", messages(CASE[:6]))
    rows = {r["tx_id"]: r["user_tx_count"] for r in drain(spark, tmp_path, build).collect()}
    assert rows == {"txn-0": 0, "txn-1": 1, "txn-2": 2, "txn-3": 3, "txn-5": 0}


def test_missing_id_is_derived_from_the_message(spark):
    text = json.dumps({"user_id": "u", "amount": 1.0})
    df = spark.createDataFrame([(text,), (text,)], "value string")
    ids = [r["transaction_id"] for r in io.parse_messages(df).collect()]
    assert ids[0] == ids[1] and ids[0].startswith("gen-")


def test_csv_keeps_empty_text_and_checks_header(spark, tmp_path, sf):
    raw = raw_events(spark, sf).drop("tx_id")
    raw.coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    back = io.read_raw_csv(spark, str(tmp_path / "csv"))
    assert set(dict(back.dtypes).values()) == {"string"}
    assert back.filter("`Errors?` is null").count() == 0 and back.filter("`Errors?` = ''").count() == raw.filter("`Errors?` = ''").count()
    raw.drop("Amount").coalesce(1).write.option("header", True).csv(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        io.read_raw_csv(spark, str(tmp_path / "bad"))


def test_tables_reports_and_encoders_round_trip(spark, tmp_path, sf):
    df = tx_events(spark, sf)
    io.write_table(df.withColumn("split", F.lit("train")), str(tmp_path / "t"), ["split"])
    assert io.read_table(spark, str(tmp_path / "t"), ["tx_id", "amount"]).columns == ["tx_id", "amount"]
    codes = encode.fit_encoders(df, ["city"], ["mcc"])
    io.save_encoders(codes, str(tmp_path / "enc"))
    back = io.load_encoders(spark, str(tmp_path / "enc"), ["city", "mcc"])
    assert encode.encode(df, back).exceptAll(encode.encode(df, codes)).count() == 0
    io.write_report(df.groupBy("mcc").count(), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.json"))) == 1
    io.write_windows(df.select("tx_id", F.array("amount").alias("window"), "label"), str(tmp_path / "w"))
    assert dict(spark.read.parquet(str(tmp_path / "w")).dtypes)["window"] == "array<float>"


def test_pruned_scan(spark, sf):
    plan = tx_events(spark, sf).select("tx_id", "amount")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_model_save_and_score(spark, tmp_path, sf):
    from pyspark.ml import PipelineModel

    df, inputs = learning.with_indicators(tx_events(spark, sf), ["amount", "merchant"])
    model = learning.train(df, inputs, kind="linear")
    model.write().overwrite().save(str(tmp_path / "m"))
    a, b = learning.score(model, df), learning.score(PipelineModel.load(str(tmp_path / "m")), df)
    assert a.select("tx_id", "score").exceptAll(b.select("tx_id", "score")).count() == 0


def test_no_refit_without_drift(spark, sf):
    df, inputs = learning.with_indicators(tx_events(spark, sf), ["amount", "merchant"])
    model = learning.train(df, inputs, kind="linear")
    out = flows.refit_on_drift(model, df, df, df, inputs, ["amount"], 0.5, kind="linear")
    assert out.gate is None and not out.promoted and out.trigger.first()["retrain"] == 0


def test_running_decision_counters(spark, tmp_path):
    put(tmp_path, "a.txt", messages())
    stream = st.transactions_of(io.read_topic(spark, "text", path=str(tmp_path / "in")))
    counts = st.decision_counters(st.score_stream(stream, lambda d: d.withColumn("score", F.lit(0.99))))
    st.start_table(counts, str(tmp_path / "out"), str(tmp_path / "checkpoint"), drain=True).awaitTermination()
    got = {r["decision"]: (r["n"], r["model_invoked"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["approve"] == (8, 0) and sum(n for n, _ in got.values()) == 10 and sum(m for _, m in got.values()) == 1


def test_merchant_table_joins_the_stream(spark, tmp_path):
    put(tmp_path, "a.txt", messages())
    table = spark.createDataFrame([("M-A", 0.25)], "merchant string, merch_large_tx_rate double")
    score = lambda d: d.withColumn("score", F.coalesce("merch_large_tx_rate", F.lit(0.0)))
    rows = drain(spark, tmp_path, lambda s: st.score_stream(s, score, merchants=table)).collect()
    assert len(rows) == 10 and [r["fraud_score_raw"] for r in rows if r["position"] == 9] == [0.25]


def test_state_of_one_user_can_be_read_back(spark, tmp_path):
    put(tmp_path, "a.txt", messages())
    drain(spark, tmp_path, st.stream_features)
    state = io.read_state(spark, str(tmp_path / "checkpoint"), stateVarName="moments")
    row = io.user_history(state.select("key.user", "value.*"), "stream-test-user").first()
    assert row["n"] == 10 and row["top"] == 200


def test_scoring_under_an_observation(spark, sf):
    """A model must not hold on to the session: an observed query cannot be sent to the workers with it."""
    from pyspark.sql import Observation

    df, inputs = learning.with_indicators(tx_events(spark, sf), ["amount", "merchant"])
    model, seen = learning.train(df, inputs, kind="linear"), Observation()
    scored = learning.score(model, df).observe(seen, F.count(F.lit(1)).alias("n"))
    scored.write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == df.count()
    again = learning.score(model, df).filter("score >= 0")
    assert again.count() == df.count()


def held(spark, folder, hold, files):
    """Rows of ten users in time slices, each row in its own slice's file or two files later."""
    rows = []
    for i in range(400):
        at = START + timedelta(minutes=30 * i)
        rows.append((at, f"txn-{i}", f"u{i * 7 % 10}", float(5 + i * 37 % 90), f"M{i % 6}", i // (400 // files) + 2 * (i * 13 % 3 == 0)))
    for k in range(files + 2):
        lines = [json.dumps({"transaction_id": t, "user_id": u, "timestamp": at.isoformat(), "amount": a, "use_chip": "Chip Transaction", "merchant_name": m,
                             "merchant_city": "C", "merchant_state": "S", "zip_code": "1", "mcc": m, "errors": []}) for at, t, u, a, m, f in rows[::-1] if f == k]
        put(folder, f"{k}.txt", lines)
        __import__("os").utime(folder / "in" / f"{k}.txt", (k + 1, k + 1))
    stream = st.transactions_of(io.read_topic(spark, "text", path=str(folder / "in"), maxFilesPerTrigger=1))
    begin = lambda s: st.start(st.stream_features(s, hold=hold), str(folder / "out"), str(folder / "checkpoint"), drain=True)
    if hold:
        st.drain(stream, str(folder / "ends"), begin)
    else:
        begin(stream).awaitTermination()
    return sorted(spark.read.parquet(str(folder / "out")).collect(), key=lambda r: r["ts"])


def test_held_rows_come_in_the_order_of_their_times(spark, tmp_path):
    rows = held(spark, tmp_path, f"{30 * 200} minutes", 5)
    assert len(rows) == 400 and not any(r["is_late"] for r in rows)
    seen, last = {}, {}
    for r in rows:
        assert r["user_tx_count"] == seen.get(r["user"], 0), r["tx_id"]
        gap = (r["ts"] - last[r["user"]]).total_seconds() / 86400 if r["user"] in last else None
        assert r["days_since_last_tx"] == (None if gap is None else pytest.approx(gap))
        seen[r["user"]], last[r["user"]] = seen.get(r["user"], 0) + 1, r["ts"]
    # Nothing waits any more.
    assert io.read_state(spark, str(tmp_path / "checkpoint"), stateVarName="held").count() == 0


def test_rows_past_the_watermark_are_scored_and_marked(spark, tmp_path):
    rows = held(spark, tmp_path, "1 minute", 5)
    assert len(rows) == 400 and 0 < sum(r["is_late"] for r in rows) < 200


def test_without_holding_the_borders_of_batches_show(spark, tmp_path):
    rows = held(spark, tmp_path, None, 5)
    assert len(rows) == 400 and any(r["is_late"] for r in rows)


def test_counts_by_batch_survive_a_repeated_batch(spark, tmp_path):
    put(tmp_path, "a.txt", messages(CASE[:6]))
    score = lambda d: d.withColumn("score", F.lit(0.99))
    path = str(tmp_path / "counts")

    def run():
        stream = st.transactions_of(io.read_topic(spark, "text", path=str(tmp_path / "in")))
        st.start_counts(st.score_stream(stream, score), path, str(tmp_path / "checkpoint"), drain=True).awaitTermination()
        return sum(r["n"] for r in st.read_counts(spark, path).collect())

    assert run() == 6
    before = {tuple(r) for r in st.read_counts(spark, path).collect()}
    st.minute_counts(spark.createDataFrame([(START, "block", True)], "timestamp timestamp, decision string, model_invoked boolean").limit(0))
    last = st.compact_counts(spark, path)
    assert {tuple(r) for r in st.read_counts(spark, path).collect()} == before
    put(tmp_path, "b.txt", messages(CASE[6:], 6))
    assert run() == 10
    # The batch after the merge is done again: its counts are replaced, not added.
    again = spark.read.parquet(f"{path}/upto=-1/batch={last + 1}").collect()
    spark.createDataFrame(again).write.mode("overwrite").parquet(f"{path}/upto=-1/batch={last + 1}")
    assert sum(r["n"] for r in st.read_counts(spark, path).collect()) == 10
    assert st.compact_counts(spark, path, "2026-03-01 12:00:00") > last
    assert min(r["minute"] for r in st.read_counts(spark, path).collect()) >= datetime(2026, 3, 1, 12)


def test_fitted_model_inside_the_stream(spark, sf, tmp_path):
    """All rows of the stream get the score, decision and rule that the same model gives on batch windows."""
    from pyspark.ml.functions import vector_to_array

    from txflow.catalog import streams
    from txflow.operators import encode as enc
    from txflow.operators.features import clean_transactions, user_features
    from txflow.operators.windows import build_windows, serving_vector
    from txflow.schema import BASE_COLUMNS, ENRICHED, MERCHANT_FEATURES

    raw = raw_events(spark, sf)
    encoding = flows.fit_encoding(flows.clean_split(raw).filter("split = 'train'"))
    encoding.save(str(tmp_path / "encoding"))
    encoding = flows.Encoding.load(spark, str(tmp_path / "encoding"))
    rows = user_features(flows.keyed_rows(clean_transactions(raw)), "User", "amount_raw", "raw_merchant", "raw_mcc", "raw_channel", "raw_city", "raw_state")
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in MERCHANT_FEATURES})
    merchants = rows.groupBy(F.col("raw_merchant").alias("merchant")).agg((F.count("*") % 7).cast("double").alias("merch_large_tx_rate"))
    rows = rows.drop("merch_large_tx_rate").join(merchants, rows["raw_merchant"] == merchants["merchant"])
    seq = build_windows(enc.scale(encoding.coded(rows), encoding.stats, flows.SCALED), BASE_COLUMNS, ("User",))
    batch = seq.withColumn("slots", serving_vector("user_tx_count", "seq", BASE_COLUMNS, ENRICHED)).withColumn("inputs", flows.model_vector("slots"))
    model = learning.train(batch, "inputs", kind="linear")
    want = {str(r["tx_id"]): r for r in learning.score(model, batch.withColumn("x", vector_to_array("inputs"))).select("tx_id", "score").collect()}

    score = st.model_score(model, encoding, [(merchants, "merchant")])
    out = streams._drain(spark, raw, lambda s, hold: st.score_stream(streams._encoded(s, encoding), score, 0.5, hold=hold),
                         time=streams.build_timestamp("Year", "Month", "Day", "Time")).collect()
    assert len(out) == raw.count()
    scored = [r for r in out if r["model_invoked"]]
    assert {r["transaction_id"] for r in scored} == set(want) and len(want) > 500
    assert all(r["fraud_score_raw"] == pytest.approx(want[r["transaction_id"]]["score"], rel=1e-6, abs=1e-9) for r in scored)
    assert all((r["decision"] == "block") == (r["rule"] == "high_prob_high_conf") for r in out)
    assert all(r["fraud_score_raw"] >= 0.5 and r["confidence_score"] >= 0.75 for r in scored if r["decision"] == "block")
    assert len({r["decision"] for r in scored}) > 1


def test_messages_give_all_base_columns(spark, tmp_path):
    put(tmp_path, "a.txt", messages())
    df = st.transactions_of(spark.read.text(str(tmp_path / "in")))
    codes = {c: spark.createDataFrame([("5411", 3.0), ("M-A", 7.0), ("10001", 2.0)], "value string, code double") for c in (*flows.FREQUENCY, *flows.LABEL)}
    rows = st.encoded(df, flows.Encoding(codes, None), st.message_columns()).collect()
    assert len(rows) == 10 and all(len(r["base"]) == 21 for r in rows)
    first = next(r for r in rows if r["tx_id"] == "txn-0")
    assert first["mcc"] == "5411" and first["base"][:5] == [7.0, 0.0, 0.0, 2.0, 3.0] and first["base"][7] is None
    assert first["base"][-3:] == [1.0, 0.0, 0.0] and first["base"][15:18] == [10.0, 6.0, 3.0]


def test_a_slice_of_many_files_is_one_batch(spark, sf, monkeypatch):
    """However many files the rows of a slice come in, no row is overtaken by the watermark."""
    from txflow.catalog import streams

    rows = tx_events(spark, sf)
    one = streams._drain(spark, rows, streams._features)
    monkeypatch.setattr(streams, "FILE_ROWS", 60)
    many = streams._drain(spark, rows.repartition(6), streams._features)
    assert many.filter("is_late = 1").count() == 0
    assert many.count() == rows.count() and many.exceptAll(one).count() == 0


class Calls:
    """A state variable in memory, which counts the calls."""

    def __init__(self):
        self.value, self.map, self.rows, self.n = None, {}, [], 0

    def __getattribute__(self, name):
        if name in ("value", "map", "rows", "n", "__class__"):
            return object.__getattribute__(self, name)
        self.n += 1
        return object.__getattribute__(self, name)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value, self.map = None, {}

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value


@pytest.mark.parametrize("turns", [1, 4])
def test_state_calls_do_not_grow_with_the_rows(monkeypatch, turns):
    from types import SimpleNamespace

    from txflow.streaming import state

    def run(slot_keys, rows):
        monkeypatch.setattr(state, "SLOT_KEYS", slot_keys)
        calls, user, out = Calls(), state.UserHistory(), []
        user.init(SimpleNamespace(getValueState=lambda *_: calls, getMapState=lambda *_: calls))
        for part in range(turns):
            new = [(str(i), "u", i * 10**9, i * 10**9, float(i % 50), f"M{i * 7 % 90}", f"C{i % 5}", "chip", f"T{i % 11}", "S", None, False, False)
                   for i in range(part * rows, (part + 1) * rows)]
            out += [tuple(r) for r in user.handleInputRows(("u",), iter(new), None)]
        return out, calls

    packed, calls = run(1000, 60)
    spread, slots = run(4, 60)
    assert packed == spread and len(packed) == 60 * turns and len(slots.map) > 8 and list(calls.map) == [("0",)]
    merchant = state.OUTPUT_SCHEMA.names.index("merchant_user_count")
    seen = {}
    for i, r in enumerate(packed):
        m = f"M{i * 7 % 90}"
        assert r[merchant] == seen.get(m, 0)
        seen[m] = seen.get(m, 0) + 1
    assert calls.n <= 4 * turns and run(1000, 400)[1].n == calls.n
