from collections import Counter

from txflow.llm import language
from txflow.llm.common import held_out
from txflow.llm.queries import op9_language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op9_language(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.96 * len(got)
    sure = [r for r in got if r.accepted]
    assert len(sure) > 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_odd_rows(odd):
    known = language.fit(odd)
    got = language.identify(odd.select("doc_id", "text", "score", "rank"), known).collect()
    assert len(got) == odd.count()
    for r in got:
        none = r.text is None or not any(map(str.isalpha, r.text))
        assert (r.language.lang == "und") == none and r.language.lang in ("en", "de", "und")
        assert not none or (r.language.score == 0 and not r.language.accepted)


def test_without_training_text(odd, empty):
    assert language.fit(empty) == ()
    assert Counter(r.language.lang for r in language.identify(odd.select("text"), ()).collect()) == {"und": odd.count()}
    assert language.identify(empty.select("text"), language.fit(odd)).collect() == []


def test_a_narrow_margin_is_rejected():
    known = (("x", b"alpha beta gamma delta " * 20), ("y", b"alpha beta gamma delta " * 20))
    (lang,), (score,), (margin,), (accepted,) = language.classify(["alpha beta"], known)
    assert (lang, margin, accepted) == ("x", 0.0, False) and score == 0.5


def test_copies_of_one_text_do_not_fill_a_dictionary(spark):
    rows = [(i, "same words again and again", "en") for i in range(5_000)] + [(9_000 + i, f"rare text number {i} of many", "en") for i in range(50)]
    (_, content), = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert content.count(b"same words") == 1 and content.count(b"rare text") == 50


def test_held_out_ids(spark):
    import zlib
    rows = spark.range(50).selectExpr("id AS doc_id").withColumn("h", held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
