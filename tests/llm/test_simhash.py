import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from txflow.llm import simhash
from txflow.llm.components import components


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_roots(codes, distance=3):
    codes = np.array(codes, np.uint64)
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= distance):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_fingerprints(odd):
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in simhash.fingerprints(odd.select("doc_id", "text")).collect())
    assert got == Counter((r.doc_id, brute_fingerprint(r.text)) for r in odd.collect())


def signed(codes):
    return np.array(codes, np.uint64).view(np.int64).tolist()


def clusters(seed):
    rng = np.random.default_rng(seed)
    codes = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    for base in codes[:15]:
        for _ in range(60):
            code = base
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                code ^= 1 << int(k)
            codes.append(code)
    hot = codes[0] & 0xFFFF << 48
    codes += [hot | int(x) for x in rng.integers(0, 1 << 48, 300, dtype=np.uint64)]  # one segment that many share
    return sorted({*codes, 0, 1, 7, (1 << 64) - 1})


@pytest.mark.parametrize("block", [4096, 5])
def test_links_against_brute_force(spark, block):
    codes = clusters(block)
    df = spark.createDataFrame([(c,) for c in signed(codes)], "fp long")
    root = {r.node: r.root for r in components(simhash.near_edges(df, block=block)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for c, r in zip(signed(codes), brute_roots(codes), strict=True):
        got[root.get(c, c)].add(c)
        want[r].add(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_gray_rank_orders_neighbours_one_bit_apart(spark):
    df = spark.range(256).selectExpr("id << 56 AS code")
    order = [r.code for r in df.select("code", simhash.gray_rank(df["code"]).alias("r")).orderBy("r").collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") == 1 for a, b in zip(order, order[1:]))


def test_search_inside_and_between_lists():
    codes = np.array(clusters(3), np.uint64)
    a, b = codes[::2], codes[1::2]
    for left, right in ((codes, None), (a, b)):
        other = left if right is None else right
        want = {(i, int(j)) for i in range(len(left)) for j in np.flatnonzero(np.bitwise_count(other ^ left[i]) <= 3) if right is not None or j >= i}
        got = {(int(i), int(j)) for x, y in simhash.near_pairs(left, right) for i, j in zip(x, y, strict=True)}
        assert got == want


def test_classes_of_odd_rows(odd):
    rows = odd.collect()
    roots = brute_roots([brute_fingerprint(r.text) for r in rows])
    ids = defaultdict(list)
    for r, k in zip(rows, roots, strict=True):
        ids[k].append(r.doc_id)
    want = Counter((r.doc_id, min((i for i in ids[k] if i is not None), default=None)) for r, k in zip(rows, roots, strict=True))
    assert Counter((r.doc_id, r.component_id) for r in simhash.classes(odd).collect()) == want


def test_one_of_each_class_stays_with_its_columns(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(brute_roots([brute_fingerprint(r.text) for r in odd.collect()])))
    assert not {tuple(r) for r in kept.collect()} - {tuple(r) for r in odd.collect()}


def test_empty(empty):
    assert simhash.classes(empty).collect() == [] and simhash.keep_one(empty).collect() == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(5, 5), (900, 800)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {800: 800, 900: 800}
