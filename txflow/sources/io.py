"""Files, fitted artifacts and message topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from txflow.schema import MESSAGE_SCHEMA, RAW_COLUMNS, RAW_SCHEMA, check_columns


def read_raw_csv(spark: SparkSession, path: str, required: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Raw transactions, every column text and empty text kept (not NULL).

    The header is checked first; the schema then comes from it, so no inference pass runs.
    """
    header = spark.read.csv(path, header=True).columns
    check_columns(header, required)
    known = {f.name: f for f in RAW_SCHEMA}
    schema = ", ".join(f"`{h}` string" for h in header) if any(h not in known for h in header) else StructType(
        [known[h] for h in header]
    )
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False).na.fill("")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_windows(df: DataFrame, path: str) -> None:
    """(tx_id, window, label) rows; the window is an array of floats."""
    out = df.select("tx_id", F.col("window").cast("array<float>").alias("window"), F.col("label").cast("tinyint").alias("label"))
    write_table(out, path)


def write_report(report: DataFrame, path: str) -> None:
    """A report has a few rows by construction; it becomes one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def save_encoders(codes: dict[str, DataFrame], path: str) -> None:
    for col, table in codes.items():
        table.write.mode("overwrite").parquet(f"{path}/{col.replace(' ', '_')}")


def load_encoders(spark: SparkSession, path: str, cols: Sequence[str]) -> dict[str, DataFrame]:
    return {c: spark.read.parquet(f"{path}/{c.replace(' ', '_')}") for c in cols}


def profile(df: DataFrame, user: str = "user", label: str = "label") -> DataFrame:
    """(rows, users, positives) from two columns."""
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct(user).alias("users"),
        F.sum(F.col(label).cast("bigint")).alias("positives"),
    )


def parse_messages(df: DataFrame, value: str = "value", schema: StructType = MESSAGE_SCHEMA) -> DataFrame:
    """JSON text to typed columns; a missing id is derived from the message itself."""
    text = F.col(value).cast("string")
    out = df.select(F.from_json(text, schema).alias("m"), text.alias("_text")).select("m.*", "_text")
    derived = F.concat(F.lit("gen-"), F.sha2("_text", 256).substr(1, 16))
    return out.withColumn("transaction_id", F.coalesce("transaction_id", derived)).drop("_text")


def to_messages(df: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, value) with the whole row as JSON."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def read_topic(spark: SparkSession, fmt: str = "kafka", schema: str | None = None, **options) -> DataFrame:
    """A stream of messages: Kafka in production, files of JSON lines elsewhere."""
    reader = spark.readStream.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.load()


def write_topic(df: DataFrame, checkpoint: str, fmt: str = "kafka", key: str = "user_id", mode: str = "append",
                **options) -> DataStreamWriter:
    out = to_messages(df, key) if fmt == "kafka" else df
    return out.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).options(**options)


def user_history(state: DataFrame, user_id, user: str = "user") -> DataFrame:
    """One user's row of a history table; the filter reaches the Parquet scan."""
    return state.filter(F.col(user) == F.lit(user_id))


def read_state(spark: SparkSession, checkpoint: str, **options) -> DataFrame:
    """Rows of a stream's state store, for looking a user's state up."""
    return spark.read.format("statestore").options(**options).load(checkpoint)


def in_list(col: str, values: Sequence) -> Column:
    return F.col(col).isin(list(values))
