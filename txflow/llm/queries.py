"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txflow.llm import alignment, chat, decontaminate, language, lines, mixing, packing, quality, simhash, suffixes, tokens, urls, whitening
from txflow.llm.common import held_out
from txflow.session import ship

Query = Callable[[SparkSession, str], DataFrame]
OVER = 4096


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = tokens.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > OVER).alias("over_limit"))


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("_row")


def op3_chat_examples(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    return chat.digest(chat.expand(given.unionByName(extra)))


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.classes(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Fixed by the query's contract: host, path, verdict.
GIVEN_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def page_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the documents that pages show: the number in a page's path is a document's id."""
    number = F.regexp_extract("url", "://[^?#]*/([0-9]+)", 1).try_cast("bigint")
    pages = table(spark, sf, "pages").select("url", number.alias("doc_id"))
    return pages.join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))


def op5_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"), page_labels(spark, sf), GIVEN_RULES)


def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf, "documents"), with_text=False)
    return found.drop("kept_text")


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    learn = docs.filter(~held_out())
    model = quality.fit(learn.join(good, "doc_id", "left_semi"), learn)
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "quality.score", "quality.predicted")


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    known = language.fit(docs.filter(~held_out()))
    found = language.identify(docs.select("doc_id", "text"), known)
    return found.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.margin", "language.accepted")


def op10_line_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = lines.judge(table(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "n_lines", "n_removed_lines", "line_chars", "removed_chars")


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    model = whitening.fit(vectors)
    rows = whitening.whiten(vectors, model).select(
        "vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("component", "whitened"))
    explained = F.array(*[F.lit(float(e)) for e in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    return rows.select("vec_id", (F.col("component") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("component")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op12_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(table(spark, sf, "documents"))


# The same queues: full sources by ratio of cap and weight, then cumulative words in md5 order.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rk FROM s0),
s2 AS (SELECT *, CAST([3, 1, 2][rk % 3 + 1] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * (SELECT CAST(sum(source_size) AS DOUBLE) FROM s2) - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s2),
l AS (SELECT lv AS level FROM s3 WHERE lv <= cap / w ORDER BY cap / w, rk LIMIT 1),
s AS (SELECT source, rk, source_size, least(cap, (SELECT level FROM l) * w) AS target FROM s3),
q AS (SELECT r, doc_id, size, rk, source_size, target, e, md5('12:' || e || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, (SELECT unnest([0, 1]) AS e) WHERE e = 0 OR (source_size < target AND size > 0)),
c AS (SELECT *, sum(size) OVER (PARTITION BY rk ORDER BY e, h, size, r) AS upto FROM q),
t AS (SELECT *, CAST(greatest(0, least(size, floor(target) - (upto - size))) AS BIGINT) AS taken, CASE WHEN target > 0 THEN CAST(upto AS DOUBLE) / target ELSE 0 END AS f FROM c),
p AS (SELECT *, sum(taken) OVER (ORDER BY f, rk, e, h, size, r) - taken AS pos FROM t)
SELECT doc_id, size, source_size, target, CAST(sum(taken) AS BIGINT) AS taken, CAST(min(CASE WHEN taken > 0 THEN pos END) AS BIGINT) AS first_position
FROM p GROUP BY r, doc_id, size, source_size, target
"""


def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    per_doc, _ = alignment.aligned(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return per_doc


# Words and lines as the query takes them; a line counts once for each document of a host.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, string_split_regex(t, '[ \t\n\v\f\r]+') AS parts FROM d),
ww AS (SELECT r, list_filter(parts, lambda x: x <> '') AS words FROM w),
tri AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM ww WHERE len(words) >= 3),
tri2 AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM tri),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM tri2) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY r),
pl AS (SELECT * FROM (SELECT l.r, d.source, trim(lower(regexp_replace(line, '[ \t\v\f\r]+', ' ', 'g')), ' ') AS line
       FROM ln l JOIN d USING (r)) WHERE line <> ''),
fr AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT r) AS docs FROM pl GROUP BY source, line) a
       JOIN (SELECT source AS host, count(*) AS size FROM d GROUP BY source) b ON source IS NOT DISTINCT FROM host WHERE docs > 20 AND docs > 0.01 * size),
lost AS (SELECT p.r, count(*) AS n_lines, sum(length(p.line)) AS line_chars, count(f.line) AS n_removed_lines,
         sum(CASE WHEN f.line IS NULL THEN 0 ELSE length(p.line) END) AS removed_chars
         FROM pl p LEFT JOIN fr f ON p.source IS NOT DISTINCT FROM f.source AND p.line = f.line GROUP BY p.r),
b AS (SELECT d.r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \t\n\v\f\r]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines,
      CAST(coalesce(line_chars, 0) AS BIGINT) AS line_chars, CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars
      FROM d JOIN ww USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND removed_chars <= 0.5 * line_chars AS kept, n_lines, n_removed_lines, line_chars, removed_chars FROM f
"""

def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(ship(spark), sf)


QUERIES: dict[str, Query] = {
    "pipeline": pipeline,
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_chat_examples": op3_chat_examples,
    "op4_simhash": op4_simhash,
    "op5_url_rules": op5_url_rules,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_language": op9_language,
    "op10_line_rules": op10_line_rules,
    "op11_whitening": op11_whitening,
    "op12_mixing": op12_mixing,
    "op13_alignment": op13_alignment,
}
ORACLES: dict[str, str] = {"op10_line_rules": OP10_SQL, "op12_mixing": OP12_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
