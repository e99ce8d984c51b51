"""Quality rules with the document frequency of lines, in DataFrame functions only.

Lines are normalised (lower case, one space for white space) and hashed. For each host the
number of documents that hold a line is counted, once each; lines above the limit are boilerplate and are
removed. A document that loses too large a share of its line characters is rejected, and so is
one that fails the base rules. Copies are documents like others: a text with more copies than the limit loses all its lines.

One scan of the texts gives a slim row per document (figures and line hashes); counting, joining and
the verdict read those. Counts are pre-aggregated before each shuffle and keyed by host and line, so
a host with a third of all rows spreads over its lines.

Defined cases: a null text has no word and fails; a null host is a host of its own; repeated rows and ids
each get a row; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txflow.llm.common import WORD_SPLIT, filled, numbered, packed
from txflow.session import cut

MIN_DOCS = 20  # a line in at most this many documents of a host stays
MAX_SHARE = 0.01  # nor is one removed that at most this share of the host's documents holds
DEPLETED = 0.5  # share of line characters that may go
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # percent


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, WORD_SPLIT, " " * len(WORD_SPLIT)), " "), lambda w: w != "")


def _normal(text: Column) -> Column:
    """Lower case, white space other than newlines as single spaces; lines keep their borders."""
    return F.lower(F.regexp_replace(F.translate(text, WORD_SPLIT.replace("\n", ""), " " * 5), " +", " "))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def base_figures(docs: DataFrame, text: str = "_text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text column without nulls."""
    t = F.col(text)
    df = docs.withColumn("_words", _words(t)).withColumn("n_words", F.size("_words").cast("long"))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_words") - 3),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    df = df.withColumn("_windows", F.when(F.col("n_words") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(repeated, F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.filter("_sorted", lambda x, j: (x["h"] == F.get("_sorted", j + 1)["h"]) | ((j > 0) & (x["h"] == F.get("_sorted", F.greatest(j - 1, F.lit(0)))["h"])))
    df = df.withColumn("_at", F.sort_array(F.transform(at, lambda x: x["i"])))
    # A window covers three words, fewer if the next one begins among them.
    steps = F.transform("_at", lambda i, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - i, F.lit(3))))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, WORD_SPLIT, "") != "")
    df = df.withColumn("_lines", lines)
    return df.withColumns({
        "word_chars": F.length(F.translate(t, WORD_SPLIT, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
    }).drop("_words", "_windows", "_sorted", "_at", "_lines")


def frequent_lines(slim: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(_of, line, docs): host, hash and documents of lines that more documents of the host hold than the limit allows."""
    sizes = slim.groupBy(F.col("_host").alias("_of")).agg(F.count("*").alias("size"))
    held = slim.select("_host", F.explode(F.array_distinct(F.transform("_pieces", lambda x: x["h"]))).alias("h"))
    counts = held.groupBy("_host", "h").agg(F.count("*").alias("docs")).filter(F.col("docs") > min_docs)
    both = counts.join(sizes, F.col("_host").eqNullSafe(F.col("_of")))
    return both.filter(F.col("docs") > max_share * F.col("size")).select(F.col("_host").alias("_of"), F.col("h").alias("line"), "docs")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS,
          max_share: float = MAX_SHARE, depleted: float = DEPLETED) -> DataFrame:
    """One row per document: the base figures, base_failed, n_lines, n_removed_lines, line_chars, removed_chars, removed (hashes), kept."""
    base = numbered(docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"), filled(text).alias("_text")))
    pieces = F.filter(F.transform(F.split(_normal(F.col("_text")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    slim = base_figures(base).withColumns({
        "_pieces": F.transform(pieces, lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("chars"))),
    }).drop("_text")
    slim = cut(slim)
    frequent = frequent_lines(slim, min_docs, max_share)
    each = slim.select("_row", "_host", F.inline("_pieces"))
    lost = each.join(frequent, F.col("_host").eqNullSafe(F.col("_of")) & (F.col("h") == F.col("line"))).groupBy("_row").agg(
        F.count("*").alias("n_removed_lines"), F.sum("chars").alias("removed_chars"), F.collect_set("line").alias("removed"))
    figures = slim.withColumns({
        "n_lines": F.size("_pieces").cast("long"),
        "line_chars": F.aggregate("_pieces", F.lit(0).cast("long"), lambda a, x: a + x["chars"]),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
    }).drop("_pieces", "_host")
    zero = F.lit(0).cast("long")
    return figures.join(lost, "_row", "left").withColumns({
        "n_removed_lines": F.coalesce("n_removed_lines", zero), "removed_chars": F.coalesce(F.col("removed_chars"), zero),
        "removed": F.coalesce("removed", F.array().cast("array<bigint>")),
    }).withColumn("kept", ~F.col("base_failed") & (F.col("removed_chars") <= depleted * F.col("line_chars"))).withColumnRenamed("_key", key)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The kept documents with their frequent lines taken out; columns as given."""
    verdicts = judge(docs, key, text, host, **limits).filter("kept").select("_row", F.col("removed").alias("_gone"))
    rest, back = packed(docs)
    joined = numbered(docs.select(rest, F.col(text).alias("_text"))).join(verdicts, "_row")
    lines = F.filter(F.split("_text", "\n"), lambda x: ~F.array_contains("_gone", _line_hash(_normal(x))))
    new = F.when(F.size("_gone") > 0, F.array_join(lines, "\n")).otherwise(F.col("_text")).alias(text)
    return joined.select(*(new if c == text else column for c, column in back.items()))
