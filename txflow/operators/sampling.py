"""Exact-size, repeatable samples: rows in the order of a seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txflow.operators.joining import same, with_row


def hash_order(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (all if fewer); every partition keeps its own best ``n`` before they meet."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def sample_entities(df: DataFrame, col: str, n: int, seed: int = 42) -> DataFrame:
    return sample_rows(df.select(col).distinct(), col, n, seed)


def keep_entities(df: DataFrame, entities: DataFrame, col: str) -> DataFrame:
    """Full history of the chosen entities; AQE broadcasts the id list when it is small."""
    return df.join(entities.select(col), col, "left_semi")


def _buckets(df: DataFrame, key: str, seed: int, buckets: int) -> DataFrame:
    return df.withColumns({"_h": hash_order(key, seed), "_b": F.pmod(hash_order(key, seed), F.lit(buckets))})


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """``n`` rows per stratum. Each (stratum, hash bucket) keeps ``n``, then the survivors are cut."""
    w = Window.partitionBy(stratum, "_b").orderBy("_h", key)
    first = _buckets(df, key, seed, buckets).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    final = Window.partitionBy(stratum).orderBy("_h", key)
    return first.withColumn("_rn", F.row_number().over(final)).filter(F.col("_rn") <= n).drop("_h", "_b", "_rn")


def stratified_rank(df: DataFrame, stratum: str, key: str, seed: int, buckets: int = 65_536) -> DataFrame:
    """Add ``_rank``: position of the row in the hash order of its stratum, from 1.

    The rank is the rank inside a hash range plus the sizes of the lower ranges, so a
    large stratum is ranked by many tasks; the join reuses the window's partitioning.
    """
    width = 2**64 // buckets
    h = hash_order(key, seed)
    tagged = df.withColumns({"_h": h, "_b": F.floor(h / F.lit(float(width)))})
    before = Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = tagged.groupBy(stratum, "_b").agg(F.count("*").alias("_n"))
    offsets = sizes.select(stratum, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rank = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", key)) + F.col("_off")
    return same(tagged, offsets, [stratum, "_b"], "inner").withColumn("_rank", rank).select(*df.columns, "_rank")


def stratified_split(df: DataFrame, stratum: str, key: str, frac: float = 0.5, seed: int = 42) -> DataFrame:
    """Add ``part`` ('a'/'b'): in every stratum the first floor(n * frac) rows in hash order are 'a'."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_all"))
    ranked = same(stratified_rank(df, stratum, key, seed), sizes, [stratum], "inner")
    first = F.col("_rank") <= F.floor(F.col("_all") * F.lit(float(frac)))
    return ranked.withColumn("part", F.when(first, "a").otherwise("b")).select(*df.columns, "part")


def ratio_subsample(df: DataFrame, label: str, key: str, k: int, epoch: int = 0) -> DataFrame:
    """All positives and ``k`` negatives per positive; another draw for every epoch. Rows without a label are drawn like negatives, apart from them."""
    ranked = stratified_rank(df, label, key, epoch)
    positives = df.agg(F.sum(F.col(label).cast("bigint")).alias("_p"))
    keep = F.col(label).eqNullSafe(F.lit(1)) | (F.col("_rank") <= k * F.col("_p"))
    return with_row(ranked, positives).filter(keep).select(*df.columns)
