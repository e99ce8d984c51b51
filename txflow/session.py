"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_BYTES = 128 << 20
_FEW_ROWS = {"parquet.page.size": str(128 << 10), "parquet.page.size.row.check.min": "8", "parquet.page.size.row.check.max": "32"}
# Shuffle files go when a query ends, not when the driver's garbage collector finds their plan.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, shuffle_partitions: int | None = None, input_bytes: int | None = None,
                **conf) -> SparkSession:
    """A session with the settings the library expects.

    On a cluster leave ``master`` unset and give ``input_bytes``, the size of the table to
    be processed: shuffles then start with one partition per 128 MB and AQE merges the
    ones that turn out small. Spark's own default of 200 would make 500 GB partitions of 100 TB.
    """
    builder = (
        SparkSession.builder.appName("txflow")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # A join after a window keeps the window's partitioning; keys too heavy for one
        # task are sliced before, so the coarser partitioning is not a skewed one.
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
    )
    if master:
        builder = builder.master(master)
    if input_bytes:
        parts = max(200, input_bytes // SHUFFLE_BYTES)
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), str(value))
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Gives the Python workers this package, once for each context, wherever the job was started.

    ``get_session`` does it; with a session made elsewhere call it before operators that run Python.
    """
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    if package.parent.is_dir() and not getattr(sc, "_txflow_shipped", False):
        archive = Path(tempfile.mkdtemp(prefix="txflow-")) / "txflow.zip"  # the context hands it to the executors
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        sc.addPyFile(str(archive))
        sc._txflow_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, which every executor must see.

    Only a local master may go without: it gets a folder of its own under /tmp.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from there.

    Used where several branches read one result: it is computed once, each branch scans
    only its columns, and a lost executor re-reads the files instead of recomputing. The shuffle files that
    led to it are deleted. ``wide`` says that a row has kilobytes: pages then hold few rows, which halves the time of a scan.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").options(**(_FEW_ROWS if wide else {})).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
