"""Results that outlive executors: checkpoints and tables in the shared folder, and broadcasts of a checked size."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is sent to all executors up to so many rows; beyond, Spark joins it by a shuffle.
SMALL_ROWS = 100_000


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a temporary one in local mode, where nothing else is set."""
    if at := spark.sparkContext.getCheckpointDir():
        return at
    if named := spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(named)
        return spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.TemporaryDirectory(prefix="scholia-checkpoint-", ignore_cleanup_errors=True)
    atexit.register(own.cleanup)
    spark.sparkContext.setCheckpointDir(own.name)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{folder(spark)}/{kind}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_folder() named, once its rows are not read any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet into the shared folder and read again. They stay until free(), or until the session's driver ends."""
    spark = df.sparkSession
    path = new_folder(spark, "stored")
    df.write.parquet(path)
    _forget_later(spark, path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stored_at = path
    return kept


def free(*tables: DataFrame) -> None:
    """Deletes what stored() wrote of these tables, after their last reader has ended."""
    for t in tables:
        discard(t.sparkSession, t._stored_at)


def _forget_later(spark: SparkSession, path: str) -> None:
    def forget() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            discard(spark, path)

    atexit.register(forget)


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    return len(df.limit(rows + 1).select(F.lit(1)).groupBy().count().where(F.col("count") > rows).take(1)) == 0


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The table, marked for a broadcast only if it has at most so many rows."""
    return F.broadcast(df) if is_small(df, rows) else df
