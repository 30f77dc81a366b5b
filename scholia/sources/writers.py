"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; each job adds files of its own, so writers do not meet."""
    rows.write.mode("append").json(path)


def append(rows: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """One append is one transaction of a batch: its files appear once the job commits."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def swap(rows: DataFrame, path: str) -> None:
    """Writes the next state of a table beside the present one, in a folder of its own; the caller points readers at it."""
    rows.write.mode("errorifexists").parquet(path)


def ranked_csv(rows: DataFrame, path: str, order: str, limit: int) -> None:
    """A ranked export of at most `limit` rows as one CSV file."""
    rows.orderBy(F.desc(order)).limit(limit).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
