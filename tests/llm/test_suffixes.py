import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from txflow.llm import suffixes


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def random_text(rng, n, letters=4):
    return bytes(rng.integers(97, 97 + letters, n, dtype=np.uint8)).decode()


def sample(seed=1):
    rng = np.random.default_rng(seed)
    shared = [random_text(rng, 60) for _ in range(3)]
    texts = [random_text(rng, int(rng.integers(0, 200))) + shared[k % 3][int(rng.integers(0, 20)) : int(rng.integers(30, 60))] + random_text(rng, int(rng.integers(0, 80)))
             for k in range(120)]
    return [*texts, "a" * 300, "ab" * 200, "", None, "a" * 30, "xyz" * 100, "xyz" * 100, "é" * 40, "né" * 40]


@pytest.mark.parametrize(("length", "gram", "runs"), [(24, 12, 2048), (24, 24, 2048), (24, 12, 2), (17, 8, 2048)])
def test_against_brute_force(spark, monkeypatch, length, gram, runs):
    monkeypatch.setattr(suffixes.repeated_spans, "__defaults__", (length, gram, runs))
    texts = sample(length + runs)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:5] for r in suffixes.remove_repeats(df, length=length, gram=gram).collect()}
    assert got == dict(enumerate(brute([(t or "").encode() for t in texts], length)))


def test_long_texts_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    passage = random_text(rng, 700, 20)
    texts = [random_text(rng, 300_000, 20) + passage + random_text(rng, 250_000, 20), random_text(rng, 10, 20) + passage, passage[:200], passage[:199]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.remove_repeats(df).collect()}
    assert got == {0: (700, 1), 1: (700, 1), 2: (200, 1), 3: (0, 0)}


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3_000, dtype=np.uint8)
    starts = rng.permutation(2_900)
    order, _ = suffixes.suffix_order(data, suffixes.PrefixHash(data), starts, 100)
    heads = [data[s : s + 100].tobytes() for s in order]
    assert heads == sorted(heads) and sorted(order.tolist()) == list(range(2_900))


def test_common_length():
    data = np.frombuffer(b"abcabcabd" + b"x" * 20, np.uint8)
    found = suffixes.common_length(suffixes.PrefixHash(data), np.array([0, 0, 9]), np.array([3, 1, 10]), 12)
    assert found.tolist() == [5, 0, 12]


def test_a_lying_hash_is_found_out(monkeypatch):
    monkeypatch.setattr(suffixes, "common_length", lambda hashes, i, j, limit: np.full(len(i), limit))
    data = np.frombuffer(b"12345678aaaa" + b"12345678bbbb" + b"12345678aaaa" + b"12345678cccc", np.uint8)
    assert suffixes.repeated_heads(data, np.array([0, 12, 24, 36]), 12).tolist() == [0, 24]


def test_odd_rows(odd):
    rows = odd.collect()
    got = Counter(tuple(r)[:5] for r in suffixes.remove_repeats(odd).collect())
    assert got == Counter((r.doc_id, *x) for r, x in zip(rows, brute([(r.text or "").encode() for r in rows], 200), strict=True))
    kept = suffixes.cut_from(odd)
    assert kept.columns == odd.columns
    gone = sum(1 for x in brute([(r.text or "").encode() for r in rows], 200) if x[0] and x[1] == x[0])
    assert kept.count() == len(rows) - gone and kept.filter("text IS NULL").count() == sum(r.text is None for r in rows)


def test_empty(empty):
    assert suffixes.remove_repeats(empty).collect() == [] and suffixes.cut_from(empty).collect() == []


def common_passage(n, seed=8):
    """A passage of 230 bytes in n documents with different surroundings."""
    rng = np.random.default_rng(seed)
    passage = random_text(rng, 230, 20)
    return [random_text(rng, 150, 20) + passage + random_text(rng, 150, 20) for _ in range(n)]


def test_a_passage_of_many_documents(spark, monkeypatch):
    monkeypatch.setattr(suffixes.repeated_spans, "__defaults__", (200, 64, 20))
    texts = common_passage(600)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:5] for r in suffixes.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts], 200)))


@pytest.mark.parametrize("seen", [1 << 16, 400])
def test_a_task_sends_an_equal_window_twice(seen):
    texts = common_passage(3_000)
    rims = [[{"gram": 5, "low": 120, "windows": 80, "repeated": i % 7 == 0, "deal": 3}] for i in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({"_row": list(range(len(texts))), "text": texts, "rims": rims})
    out = [r for b in suffixes._fetch(200, seen)(iter([batch])) for r in b.to_pylist()]
    sent = Counter(r["bytes"] for r in out)
    assert {sent[texts[0][k : k + 200].encode()] for k in range(150, 181)} == {2}
    order = sorted(out, key=lambda r: (r["gram"], r["bucket"], r["bytes"] or b""))
    batches = [pa.RecordBatch.from_pylist(order[k : k + 100], pa.schema([
        *((c, pa.int64()) for c in ("gram", "bucket", "_row", "low", "high")), ("repeated", pa.bool_()), ("dealt", pa.bool_()), ("bytes", pa.binary())]))
        for k in range(0, len(order), 100)]
    gone = {(r["_row"], k) for b in suffixes._sort_rims(200)(iter(batches)) for r in b.to_pylist() for k in range(r["low"], r["high"] - 199)}
    times = Counter(t[k : k + 200] for t in texts for k in range(120, 200))
    assert gone == {(i, k) for i, t in enumerate(texts) if i % 7 for k in range(120, 200) if times[t[k : k + 200]] > 1}
