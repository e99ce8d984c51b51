from collections import Counter

import corpus_pipeline
from tests.llm.test_simhash import brute_fingerprint, brute_roots
from tests.llm.test_suffixes import brute as brute_repeats
from txflow.llm import language


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near copies", "repeats", "decontamination", "packing"]

    given = docs.collect()
    left = stages["language"](spark, docs, sf)
    known = language.fit(docs.filter("crc32(cast(doc_id as string)) % 4 <> 2"))
    accepted = language.classify([r.text for r in given], known)[3]
    assert rows_of(left) == Counter(tuple(r) for r, ok in zip(given, accepted, strict=True) if ok)

    given = docs.orderBy("doc_id").collect()
    left = stages["near copies"](spark, docs, sf)
    first = {}
    for r, k in zip(given, brute_roots([brute_fingerprint(r.text) for r in given]), strict=True):
        first.setdefault(k, r)
    assert rows_of(left) == Counter(tuple(r) for r in first.values())

    left = {r.doc_id: r for r in stages["repeats"](spark, docs, sf).collect()}
    for r, (size, gone, _, _) in zip(given, brute_repeats([r.text.encode() for r in given], 200), strict=True):
        if gone == size:
            assert r.doc_id not in left
        elif gone == 0:
            assert left[r.doc_id].text == r.text and left[r.doc_id].n_chars == r.n_chars
        else:
            assert size - gone - 8 <= len(left[r.doc_id].text.encode()) <= size - gone and left[r.doc_id].n_chars == len(left[r.doc_id].text)


def test_odd_rows_and_clashing_names(spark, odd, empty, sf):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert 0 < out.count() and (name == "packing" or out.columns == odd.columns)
        assert stage(spark, empty, sf).count() == 0


def test_run(spark, sf):
    pieces = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(pieces.columns) and 0 < pieces.count()
