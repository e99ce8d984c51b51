"""From raw documents to packed pieces: five stages, each a function of (spark, docs, sf_dir).

Each stage works on what the one before kept; all but the last return the columns of documents. Rows
are told apart by their place, so null and repeated ids are handled, and columns beyond those of
documents pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txflow.llm import decontaminate, language, packing, simhash, suffixes
from txflow.llm.common import held_out, packed
from txflow.session import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or with a narrow margin between languages."""
    known = language.fit(docs.filter(~held_out()))
    rest, back = packed(docs, "text")
    found = language.identify(docs.select(rest, "text"), known)
    return found.filter(language.accepted()).select(*(back.get(c, F.col(c)) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: op4's fingerprints of 3 words within 3 bits.

    That is no similarity of word shingles: few pairs with a Jaccard similarity of 0.8 are this near, see the README.
    """
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes and more that stand elsewhere too; documents of which nothing is left go.

    A document without such a passage stays as it is; n_chars follows where characters went.
    """
    left = F.length("text")
    return suffixes.cut_from(docs).withColumn("n_chars", F.when(left < F.col("n_chars"), left).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Compression, hashes and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
