from collections import Counter

import public_tokenizers
import pytest

from txflow.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def whole(rows):
    texts = [r["text"] or "" for r in rows]
    return Counter((r["doc_id"], len(t.encode()), len(t), n) for r, t, n in zip(rows, texts, tokens.model(PATH).count(texts), strict=True))


def counted(df, **how):
    return Counter(tuple(r) for r in tokens.count_tokens(df, PATH, **how).collect())


@pytest.mark.parametrize("how", [{}, {"chunk": 200, "overlap": 30}, {"chunk": 64, "overlap": 4}])
def test_equals_whole_texts(odd, how):
    assert counted(odd, **how) == whole(odd.collect())


def test_widens_where_no_boundary_is_stable(spark):
    df = spark.createDataFrame([(1, "a" * 3000), (2, "ab" * 2000 + " end"), (3, "中文" * 900 + "x y")], "doc_id long, text string")
    assert counted(df, chunk=64, overlap=8) == whole(df.collect())


def test_stable_pairs_are_never_inside_a_piece():
    coder = tokens.model(PATH)
    assert coder.splits and coder.stable("a", " ") and not coder.stable("t", "h")


def test_real_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert counted(df, chunk=500, overlap=60) == whole(df.collect())


def test_empty(empty):
    assert tokens.count_tokens(empty, PATH).collect() == []


def test_overlap_is_bounded(odd):
    with pytest.raises(ValueError, match="half a chunk"):
        tokens.count_tokens(odd, PATH, chunk=10, overlap=6)
