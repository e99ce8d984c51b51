"""The mix against a plain simulation of the queues, its shares over time, and the defined cases."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from tests.compare import compare, connect
from txflow.llm import mixing
from txflow.llm.queries import OP12_SQL, op12_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict, share=1.5, epochs=2) -> dict:
    """Rounds of resharing as the contract words them."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (budget - sum(fixed.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > epochs * sizes[s]]
        if not above:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: epochs * sizes[s] for s in above}


def simulate(rows):
    """(id, size, source size, target, taken) by going through each source's queue word by word."""
    docs = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    goal, out = targets(sizes), []
    for s in sizes:
        left, own = math.floor(goal[s]), [[i, n, 0] for i, x, n in docs if x == s]
        for epoch in range(2):
            order = sorted(own, key=lambda d: (hashlib.md5(f"12:{epoch}:{'null' if d[0] is None else d[0]}".encode()).hexdigest(), d[1]))
            for d in order:
                take = min(d[1], left)
                d[2], left = d[2] + take, left - take
        out += [(i, n, sizes[s], goal[s], t) for i, n, t in own]
    return out


def rows_of(df):
    return sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def test_against_simulation(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = simulate([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert rows_of(op12_mixing(spark, sf)) == sorted((str(i), n, s, round(g, 6), t) for i, n, s, g, t in want)


def test_sql(spark, sf):
    assert compare(spark, connect(sf), sf, op12_mixing, OP12_SQL) == "ok"


def test_odd_rows(spark, odd, empty):
    want = simulate([(r.doc_id, r.text, r.source) for r in odd.collect()])
    found = mixing.shares(odd)
    assert rows_of(found) == sorted((str(i), n, s, round(g, 6), t) for i, n, s, g, t in want)
    assert rows_of(mixing.shares(odd)) == rows_of(found)
    assert mixing.shares(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.shares(df).collect()] == [(0, 0.0, 0)] * 2


def test_hot_source_full_sources_and_sharing(spark):
    rows = [(i, "w " * (1 + i % 37), "hot" if i % 3 else f"s{i % 30:02d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = simulate(rows)
    assert rows_of(mixing.shares(df)) == sorted((str(i), n, s, round(g, 6), t) for i, n, s, g, t in want)
    assert all(t <= 2 * n for _, n, _, _, t in want) and sum(t for *_, t in want) <= 1.5 * sum(n for _, n, *_ in want)


def test_the_mix_is_fair_at_every_moment(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mix = sorted(mixing.schedule(docs).filter("taken > 0").collect(), key=lambda r: r.position)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    largest, goal, got, at = {}, {}, {}, 0
    for r in mix:
        assert r.position == at  # gapless
        at += r.taken
        s = source[r.doc_id]
        goal[s], largest[s] = r.target, max(largest.get(s, 0), r.size)
    total = 0
    for r in mix:
        s = source[r.doc_id]
        got[s], total = got.get(s, 0) + r.taken, total + r.taken
        time = min(1.0, r.finish)
        assert all(goal[x] * time - largest[x] - 1 <= got.get(x, 0) <= goal[x] * time + 1 for x in goal)


def test_mixture_cuts_texts(spark, odd):
    mix = mixing.mixture(odd)
    assert mix.columns == [*odd.columns, "mix_position", "mix_epoch"]
    taken = mix.withColumn("n_words", mixing.words()).agg(F.sum("n_words")).first()[0]
    assert taken == sum(r.taken for r in mixing.shares(odd).collect())
    rows = sorted(mix.select("mix_position", "text").collect())
    at = 0
    for r in rows:
        assert r.mix_position == at
        at += len(WORD.findall(r.text))


@pytest.mark.parametrize("share", [0.1, 5.0])
def test_small_and_great_budgets(spark, sf, share):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.shares(docs, share=share).collect()
    total, taken = sum(r.size for r in rows), sum(r.taken for r in rows)
    assert taken <= min(share, 2) * total and taken >= min(share, 2) * total - 20
