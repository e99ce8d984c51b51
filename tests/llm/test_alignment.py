"""Alignment against encoding each text whole and listing all links one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from txflow.llm import alignment
from txflow.llm.queries import op13_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def tokens(text, coders):
    """(ids, ends) of both sides, or None where the bytes differ."""
    a, b = coders
    if not text:
        return None
    vocabulary = alignment._byte_characters()
    found = a.encode(" " + text, add_special_tokens=False)
    one = [(i, bytes(vocabulary[c] for c in t)) for i, t in zip(found.ids, found.tokens, strict=True)]
    two = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        two.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (one, two)):
        return None
    return one, two


def brute(texts, coders):
    docs, counts = [], Counter()
    for text in texts:
        found = tokens(text, coders)
        if not found:
            docs.append(None)
            continue
        ends = [[], []]
        for side, own in zip(found, ends, strict=True):
            at = 0
            for _, x in side:
                at += len(x)
                own.append(at)
        common = set(ends[0]) & set(ends[1])
        groups, at = [], [0, 0]
        for end in sorted(common):
            group = []
            for k in (0, 1):
                stop = ends[k].index(end, at[k]) + 1
                group.append([i for i, _ in found[k][at[k] : stop]])
                at[k] = stop
            groups.append(group)
        links = Counter((i, j) for one, two in groups for i in one for j in two)
        counts.update(links.keys())
        docs.append((len(found[0]), len(found[1]), groups, links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        written = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, two)) for one, two in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]),
                    sum(n * counts[p] for p, n in links.items()), hashlib.sha256(written.encode()).hexdigest()))
    return out


def result(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def check(spark, rows, coders):
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _slice int, a long, groups string")
    found, _ = alignment.aligned(df, A, B)
    want = brute([r[1] for r in rows], coders)
    assert result(found) == sorted((str(r[0]), *w) for r, w in zip(rows, want, strict=True))


def test_documents(spark, sf, coders):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text for r in docs], coders)
    out = op13_alignment(spark, sf)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert result(out) == sorted((str(r.doc_id), *w) for r, w in zip(docs, want, strict=True))


def test_random_texts(spark, coders):
    draw = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "\x0b", "\x85", " ", "　", "the", "internationalisation", "don't", "123456", "!?;", "中文", "🙂", "é", "▁", "\x00",
            "<|endoftext|>", "</s>", "<unk>", "<0x41>", "aaaaaaaaaaaaaaaaa", "=====", "Ġ", "of", "ing", "XYZZY", "ﬁ", "ș", "​"]
    rows = [(i, "".join(draw.choice(bits) for _ in range(draw.randrange(14))), "k", 1, 2, "g") for i in range(400)]
    check(spark, rows, coders)


def test_odd_rows(spark, odd, empty, coders):
    found, _ = alignment.aligned(odd, A, B)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute([t for _, t in rows], coders)
    assert result(found) == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))
    assert alignment.aligned(empty, A, B)[0].count() == 0


def test_many_slices(spark, coders, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 60)
    rows = [(i % 20, f"some words of document {i % 7} and {'long ' * (i % 5)}", "k", 1, 2, "g") for i in range(60)]
    check(spark, rows, coders)


def test_one_long_group_stays_small(coders):
    """Runs of one character end at few common bytes: links are products of counts, not rows."""
    text = "a" * 200_001 + "́" * 50_000
    columns, pairs = alignment._align_slice(pa.array([text]), alignment.words_of(A, B))
    assert columns["n_links"][0].as_py() >= columns["n_a"][0].as_py() and len(pairs) < 1000


def test_pair_counts_are_documents(spark):
    df = spark.createDataFrame([(1, "one two one one"), (2, "one"), (2, "one"), (3, None)], "doc_id long, text string")
    _, pairs = alignment.aligned(df, A, B)
    rows = pairs.orderBy(F.desc("docs")).collect()
    assert rows[0].docs == 3 and all(r.best for r in rows if r.docs == 3) and sorted(r.docs for r in rows) == [1, 3]
