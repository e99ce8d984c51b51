import random
import tracemalloc
from collections import Counter
from itertools import combinations
from math import ceil

import numpy as np
import pytest

from txflow.llm import decontaminate as dc

random.seed(7)
WORDS = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randint(2, 8))) for _ in range(3_000)]


def prose(n, seed):
    return [*random.Random(seed).choices(WORDS, k=n)]


ITEMS = {1: prose(40, 1), 2: prose(15, 2), 3: prose(57, 3), 4: prose(5, 4), 5: prose(9_000, 5)}


def planted():
    """Documents and the items they hold."""
    out = []
    for k, (item, words) in enumerate(ITEMS.items()):
        for swaps in (0, 1, 4):
            body = [w if swaps == 0 or i % 10 >= swaps else "zzz" for i, w in enumerate(words)]
            text = " ".join([*prose(60, 100 + k), *body, *prose(30, 200 + k)])
            out.append((text.upper() if swaps == 1 else text.replace(" ", ", "), item if swaps == 0 or swaps < 4 and len(words) >= dc.TOLERANT else None))
    out.append((" ".join([*prose(80, 300), *ITEMS[3][10:40], *prose(80, 301)]), 3))
    out.append((" ".join([*prose(80, 302), *ITEMS[3][10:24], *prose(80, 303)]), None))
    out.append((" ".join([*prose(80, 304), *ITEMS[5][4_085:4_115], *prose(80, 305)]), 5))  # across a border of segments
    out += [(" ".join(prose(400, s)), None) for s in range(400, 430)]
    out.append((" ".join([*prose(30_000, 500), *ITEMS[1], *prose(30_000, 501), *ITEMS[2]]), (1, 2)))
    return out


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(k, " ".join(w), "x") for k, w in ITEMS.items()] + [(9, " ".join(ITEMS[1]).upper(), "copy"), (None, None, None), (10, "", "")]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


@pytest.mark.parametrize("filter_bits", [dc.FILTER_BITS, 1 << 16])
def test_planted_passages(spark, bench, filter_bits, monkeypatch):
    monkeypatch.setattr(dc, "FILTER_BITS", filter_bits)  # a crowded filter lets more windows pass, the result stays
    docs = planted()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: tuple(r.item_ids) for r in dc.contaminated(df, bench).collect()}
    assert got == {i: w if isinstance(w, tuple) else (w,) for i, (_, w) in enumerate(docs) if w}
    kept = {r.doc_id for r in dc.remove_contaminated(df, bench).collect()}
    assert kept == set(range(len(docs))) - set(got)


def test_a_seed_ignores_unmarked_tokens():
    a = np.arange(1, 12, dtype=np.uint64)
    mask = dc.MASKS[0][0]
    b = a.copy()
    b[mask.index("0")] = 99
    assert dc.seeds(a, mask, 0)[0] == dc.seeds(b, mask, 0)[0]
    b[0] = 99
    assert dc.seeds(a, mask, 0)[0] != dc.seeds(b, mask, 0)[0]
    assert len(dc.seeds(a[:3], mask, 0)) == 0


def test_odd_rows(odd, empty, bench, spark):
    assert dc.contaminated(odd, bench).collect() == []
    assert Counter(tuple(r) for r in dc.remove_contaminated(odd, bench).collect()) == Counter(tuple(r) for r in odd.collect())
    own = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the river bank.")], "item_id long, text string")
    hit = dc.contaminated(odd, own)
    assert Counter(r.doc_id for r in hit.collect()) == Counter(r.doc_id for r in odd.collect() if r.text and r.text.startswith("The quick"))
    assert dc.remove_contaminated(odd, own).columns == odd.columns
    assert dc.contaminated(empty, bench).collect() == [] and dc.contaminated(odd, bench.limit(0)).collect() == []


@pytest.mark.parametrize(("first", "last", "stop"), [(0x4E00, 0x9FA5, "。"), (0x30A1, 0x30F6, "、"), (0x0E01, 0x0E2E, " ")])
def test_scripts_without_spaces(spark, first, last, stop):
    def text(n, seed):
        return "".join(chr(c) if k % 9 else chr(c) + stop for k, c in enumerate(random.Random(seed).choices(range(first, last), k=n)))

    items = {1: text(40, 1), 2: text(12, 2)}
    swapped = "".join("Z" if k % 10 == 3 else c for k, c in enumerate(items[1]))
    docs = [text(70, 3) + items[1] + text(50, 4), text(30, 5) + swapped + text(30, 6), text(25, 7) + items[2].replace(stop, "!") + text(9, 8), text(300, 9)]
    own = spark.createDataFrame(list(items.items()), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r.doc_id: r.item_ids for r in dc.contaminated(df, own).collect()} == {0: [1], 1: [1], 2: [2]}


def test_tokens():
    for text in ("naïve “déjà” – vu…", "中文，abc中文 3月。", "ไทย", "한국어 문장", "a\u00a0b\u3000c", "", "。", "𠀀𠀁x", "é"):
        data, want, open_word = text.encode(), [], False
        for c in text:
            single = any(low <= ord(c) <= high for low, high in dc.NO_SPACES)
            if not single and not c.isalnum():
                open_word = False
            elif single or not open_word:
                want.append(c)
                open_word = not single
            else:
                want[-1] += c
        start = dc.tokens_of(data)[1].tolist()
        if text != "ไทย":
            want = [w for w in want if w not in "，。"]
        assert [data[s:].decode()[: len(w)] for s, w in zip(start, want, strict=True)] == want
    assert len(dc.tokens_of(b"a\xff\x80b c\xe4")[0]) == 2


@pytest.mark.parametrize("length", range(1, dc.STRETCH + 1))
def test_masks_find_every_pattern(length):
    """Whatever tokens are substituted, as many as verification allows: some mask's marked positions keep clear of them."""
    swaps = length - ceil(dc.AGREE * length) if length >= dc.TOLERANT else 0
    placed = []
    for k in dc.masks_of(length):
        mask = dc.MASKS[k][0]
        marks = sum(1 << i for i, c in enumerate(mask) if c == "1")
        placed += [marks << at for at in range(length - len(mask) + 1)]
    for gone in combinations(range(length), swaps):
        hidden = sum(1 << i for i in gone)
        assert any(not p & hidden for p in placed), gone
    assert dc.masks_of(1_000) == dc.masks_of(dc.STRETCH)


def every_alignment(text, item):
    """True if some shift, of all there are, has a stretch that agrees far enough."""
    a, b = dc.tokens_of(text.lower().encode())[0], dc.tokens_of(item.lower().encode())[0]
    width = min(dc.STRETCH, len(b))
    need = width if len(b) < dc.TOLERANT else dc.AGREE * width
    for shift in range(-len(b) + 1, len(a)):
        low, high = max(0, shift), min(len(a), len(b) + shift)
        equal = (a[low:high] == b[low - shift : high - shift]).astype(int)
        if len(equal) >= width > 0 and np.convolve(equal, np.ones(width, int), "valid").max() >= need:
            return True
    return False


def test_equals_all_alignments(spark):
    """Few words, so that windows agree by chance too; items of 1 to 70 tokens, substituted at random."""
    rng = random.Random(11)
    few = [f"w{k}" for k in range(40)]
    items = {k: rng.choices(few, k=n) for k, n in enumerate([1, 2, 3, 5, 7, 8, 8, 9, 9, 10, 11, 12, 13, 16, 17, 20, 21, 30, 45, 70])}
    docs = [" ".join(rng.choices(few, k=rng.randint(0, 90))) for _ in range(40)]
    for words in list(items.values()) * 4:
        body = list(words)
        for at in rng.sample(range(len(body)), rng.randint(0, len(body) // 3)):
            body[at] = "other"
        docs.append(" ".join([*rng.choices(few, k=rng.randint(0, 400)), *body, *rng.choices(few, k=rng.randint(0, 30))]))
    docs += [" ".join(["w1"] * 900), docs[-1], docs[-1]]
    items[50] = ["w1"] * 600
    own = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in dc.contaminated(df, own).collect()}
    want = {i: [k for k, w in items.items() if every_alignment(t, " ".join(w))] for i, t in enumerate(docs)}
    assert got == {i: w for i, w in want.items() if w}
    some = {r.doc_id for r in dc.contaminated(df, own, shortest=8).collect()}
    assert some == {i for i, w in want.items() if any(len(items[k]) >= 8 for k in w)}


def test_repeated_words_need_little_memory():
    tokens = np.full(60_000, 5, np.uint64)
    item = tokens[: dc.SEGMENT]
    keys = np.unique(np.concatenate([dc.seeds(item, dc.MASKS[k][0], k) for k in dc.masks_of(2_000)]))
    words = np.full(1 << 10, (1 << 64) - 1, np.uint64)
    tracemalloc.start()
    found = list(dc.regions_of(tokens, np.array([0, len(tokens)]), dc.Filter(words, dc.masks_of(2_000)), dc.STRETCH))
    assert all(set(r[3].tolist()) == set(keys.tolist()) and r[2] - r[1] <= dc.CELL + 60 for r in found)
    assert len(found) == -(-len(tokens) // dc.CELL)
    for _, low, high, _ in found[:20]:
        assert dc.best_stretch(tokens[low:high], item, 2_000, dc.STRETCH, dc.AGREE)[:2] == (20, 20)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
