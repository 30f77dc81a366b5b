"""Structured Streaming over event files: windows, late data, deduplication, counters with reset, open and closed events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from scholia.durable import exists, new_folder

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def events(spark: SparkSession, directory: str, name: str = "events.parquet", files_per_batch: int = 1000) -> DataFrame:
    """The event files of a directory as a stream; new files are new batches. Times are UTC."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(directory)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windows(stream: DataFrame, key: str, size: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Counts and sums per window and key; rows later than `late` behind the newest are dropped, and closed windows leave the state."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(38,6)")).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, key: str, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Sessions of each key: rows without a pause of `gap`."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def distinct(stream: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def last_values(stream: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value of each key."""
    return stream.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def closed(stream_a: DataFrame, stream_b: DataFrame, key: str, within: str, late: str = "2 days", how: str = "inner") -> DataFrame:
    """Opened rows with the rows that close them: same key, at most `within` later. State older than that is dropped on both sides.

    With how="leftOuter" an opened row that nothing closed comes out as well, once, with a null: when the watermark says nothing can any more.
    """
    a = stream_a.select(F.col(key).alias("k"), F.col("ts").alias("opened"), F.col("event_id").alias("open_id")).withWatermark("opened", late)
    b = stream_b.select(F.col(key).alias("k2"), F.col("ts").alias("ended"), F.col("event_id").alias("close_id")).withWatermark("ended", late)
    return a.join(b, F.expr(f"k = k2 AND ended >= opened AND ended <= opened + INTERVAL {within}"), how).select("k", "open_id", "close_id")


COUNTER = "user_id BIGINT, skips INT, answers INT, auto_skips INT"


def skip_counters(stream: DataFrame, skip: str, answer: str, most: int = 3) -> DataFrame:
    """For each user the skips in a row, the answers, and how often `most` skips in a row were reached, which begins the row anew.

    State is three numbers per user. Rows of a batch are taken in order of event_id.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        skips, answers, auto = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for kind in rows["event_type"]:
            if kind == answer:
                skips, answers = 0, answers + 1
            elif kind == skip:
                skips += 1
                if skips == most:
                    skips, auto = 0, auto + 1
        state.update((skips, answers, auto))
        yield pd.DataFrame({"user_id": [key[0]], "skips": [skips], "answers": [answers], "auto_skips": [auto]})

    return stream.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(step, COUNTER, "skips INT, answers INT, auto_skips INT", "update", GroupStateTimeout.NoTimeout)


def resumed(stream: DataFrame, at: str, keys: list[str], mode: str = "update", after: Callable[[int], None] | None = None) -> DataFrame:
    """Runs a stream over what is new since the last run at this folder, to the end of what is there now; the result of all runs.

    The folder's checkpoint says what has been read, and what state was left. Each batch is written under its number, so a batch that a
    stopped run had not committed is run again in its place: no row comes twice and none is lost. The result has for each key the row of
    its last batch (all rows, if appended). `after` is called with the number of each batch that has been written.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        if after:
            after(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/out") if exists(spark, f"{at}/out") else spark.createDataFrame([], schema)
    if mode == "append":
        return rows.drop("_batch")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))).where("_r = 1").drop("_r", "_batch")


def settled(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there now, from the start, and returns its result."""
    return resumed(stream, new_folder(stream.sparkSession, "stream"), keys, mode)


def in_parts(rows: DataFrame, parts: int) -> Iterator[str]:
    """Writes rows to a folder part by part, in the order of their time; gives the folder after each part."""
    spark, at = rows.sparkSession, new_folder(rows.sparkSession, "parts")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    for i in range(parts):
        low = i == 0 or F.col("ts") >= F.lit(first + (last - first) * i / parts)
        high = i == parts - 1 or F.col("ts") < F.lit(first + (last - first) * (i + 1) / parts)
        rows.where(F.lit(low) & F.lit(high)).write.mode("append").parquet(at)
        yield at


def discovered(spark: SparkSession, root: str, at: str, format: str, schema: str, pattern: str = "*") -> DataFrame:
    """What the files hold that came since the last run at this folder: the stream's offsets say which they are, not a join with all known.

    With format binaryFile the files' path, size and time, without their contents. Empty files are left out.
    """
    ran: list[int] = []
    stream = spark.readStream.format(format).schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    stream = stream.drop("content") if format == "binaryFile" else stream.withColumn("_path", F.col("_metadata.file_path"))
    rows = resumed(stream, at, [], "append", ran.append)
    new = [f"{at}/out/batch={n}" for n in ran]
    return spark.read.schema(rows.schema).parquet(*new) if new else rows.limit(0)


#: The schema that binaryFile asks for.
FILE = "path STRING NOT NULL, modificationTime TIMESTAMP NOT NULL, length BIGINT NOT NULL, content BINARY"
