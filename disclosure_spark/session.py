"""Session construction and the shared work folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "disclosure_spark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job relies on (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="disclosure-", dir="/tmp")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The cluster names the shared folder in ``spark.checkpoint.dir``.  Only where that is unset and
    the session runs inside one process is a temporary folder taken instead, one per process; on
    any other master its files would stay on single machines, so the setting is demanded.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared work folder once and read it back.

    Used where several later steps need the same costly result.  Files in the shared folder
    survive the loss of any executor.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Give a narrow scan at least one partition per core before costly per-row work.

    A scan of large data already has far more partitions than that and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def local_if_small(df: DataFrame, max_rows: int = 100_000) -> tuple[DataFrame, bool]:
    """Hold a summary of at most ``max_rows`` rows as a local relation; tell whether it fitted.

    At most one row beyond the bound is fetched.  A larger frame is written to the shared work
    folder instead, so that in both cases it is computed once.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return materialize(df, "large"), False
    if table.num_rows == 0:
        return df.sparkSession.createDataFrame([], df.schema), True
    return df.sparkSession.createDataFrame(table), True


def single_value(df: DataFrame) -> Column:
    """The only value of a one-row, one-column frame, computed once and used as a constant."""
    return local_if_small(df, 1)[0].scalar()


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Mark a frame for broadcast only after seeing that it has at most ``max_rows`` rows.

    Beyond the bound it comes back without a hint and Spark plans a shuffle join.
    """
    frame, fits = local_if_small(df, max_rows)
    return F.broadcast(frame) if fits else frame
