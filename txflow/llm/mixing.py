"""Mixing sources to target weights by weighted fair queueing.

The mix has a budget of words. Each source's share of it follows its weight and stops at ``epochs`` times the
source's words; what is over goes to the other sources by their weights, until none is above. A source queues its documents in
a shuffled order, once for each epoch. A word's virtual finish time is the number of words of its source up
to it, divided by the source's target; a document finishes with its last word. All sources are
served in the order of these times, so at any moment of the mix each has got its share to within a document. The budget ends
the mix at virtual time 1, where every source has had its target: the document of a source that is
being served there is cut after its last whole word.

Cumulative words come from two-pass prefix sums over a range-sorted table, where a source's documents
may lie in many ranges, so a hot source is no one task's work. The order is the md5 of seed, epoch and id:
reruns and other engines give the same mix.

Defined cases: a null text has no words; documents without words are never taken; null is a source of its own, the last;
repeated rows and ids are documents of their own, equal ones in any order; sources without words have target 0;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txflow.llm.common import filled, numbered, packed, prefixed
from txflow.session import cut

WEIGHTS = (3, 1, 2)  # of the sources by code point, repeating
SHARE = 1.5  # budget over all words
EPOCHS = 2
SEED = 12
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.regexp_count(filled(text), F.lit(WORD)).cast("long")


def _by_code_point() -> list[Column]:
    return [F.col("source").isNull(), F.col("source")]


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_rank, source_size, weight, target) of a table of (source, size), written.

    The level where targets / weight stop rising is found by rounds: each sums the sources that
    are full at the present level, and what the others then get raises it.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1).cast("long"))
    ranked = prefixed(sums, _by_code_point(), "_one")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    table = cut(ranked.select("source", F.col("_before").alias("source_rank"), "source_size",
                              F.get(kinds, (F.col("_before") % len(weights)).cast("int")).alias("weight")))
    most = F.col("source_size") * F.lit(float(epochs))
    total, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level, before = share * (total or 0), 0.0, -1
    if weight:
        level = budget / weight
    while weight:
        full = most < F.lit(level) * F.col("weight")
        n, held, left = table.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == before or not left:
            break
        before, level = n, (budget - held) / left
    return table.withColumn("target", F.least(most, F.lit(level) * F.col("weight")))


def schedule(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS,
             share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document and epoch in which its source still serves: the order of the mix.

    Columns: _row, key, size, source_size, target, epoch, finish (virtual), taken (words), position (words of the mix before it).
    """
    sized = cut(numbered(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), words(text).alias("size"))))
    targets = cut(source_targets(sized, weights, share, epochs)).withColumnRenamed("source", "_source")
    known = sized.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    # An epoch is queued only if the source comes to it.
    served = F.filter(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: (e == 0) | ((e * F.col("source_size") < F.col("target")) & (F.col("size") > 0)))
    queued = known.select("_row", "key", "size", "source_rank", "source_size", "target", F.explode(served).alias("epoch"))
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("key").cast("string"), F.lit("null"))).cast("binary"))
    order = [F.col("source_rank"), F.col("epoch"), shuffled, F.col("size"), F.col("_row")]
    placed = prefixed(queued, order, "size")
    # Words before the source's own: its first row in this order has the fewest before it.
    starts = cut(placed.groupBy("source_rank").agg(F.min("_before").alias("_start"))).withColumnRenamed("source_rank", "_rank")
    placed = placed.join(starts, F.col("source_rank") == F.col("_rank")).withColumn("_upto", F.col("_before") + F.col("size") - F.col("_start"))
    line = F.floor("target")  # whole words that finish by virtual time 1
    taken = F.greatest(F.lit(0).cast("long"), F.least("size", line - (F.col("_upto") - F.col("size"))))
    timed = placed.select("_row", "key", "size", "source_rank", "source_size", "target", "epoch", taken.alias("taken"),
                          F.when(F.col("target") > 0, F.col("_upto") / F.col("target")).otherwise(0.0).alias("finish"), shuffled.alias("_shuffled"))
    mixed = prefixed(timed, [F.col("finish"), F.col("source_rank"), F.col("epoch"), F.col("_shuffled"), F.col("size"), F.col("_row")], "taken")
    return mixed.select("_row", F.col("key").alias(key), "size", "source_size", "target", "epoch", "finish", "taken",
                        F.when(F.col("taken") > 0, F.col("_before")).alias("position"))


def shares(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """(key, size, source_size, target, taken, first_position) of every document: words the mix takes of it, repeats counted."""
    entries = schedule(docs, key, text, source, **how)
    rows = entries.groupBy("_row").agg(
        *[F.first(f"`{c}`").alias(c) for c in (key, "size", "source_size", "target")], F.sum("taken").alias("taken"), F.min("position").alias("first_position"))
    return rows.drop("_row")


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, text cut where the budget ends, in ranges of ``mix_position``, with ``mix_epoch``."""
    entries = schedule(docs, key, text, source, **how).filter("taken > 0").select(
        "_row", F.col("epoch").alias("_epoch"), F.col("taken").alias("_taken"), F.col("size").alias("_size"), F.col("position").alias("_position"))
    rest, back = packed(docs, text)
    held = numbered(docs.select(rest, F.col(f"`{text}`").cast(T.StringType()).alias("_text")))
    each = F.regexp_extract_all("_text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))  # words with the white space before them
    upto = F.array_join(F.slice(each, F.lit(1), F.col("_taken").cast("int")), "")
    cut_text = F.when(F.col("_taken") == F.col("_size"), F.col("_text")).otherwise(upto).alias(text)
    mixed = held.join(entries, "_row").repartitionByRange("_position").sortWithinPartitions("_position")
    return mixed.select(*(cut_text if c == text else back[c] for c in docs.columns), F.col("_position").alias("mix_position"), F.col("_epoch").alias("mix_epoch"))
