"""Tables of Parquet files in folders by a hash of the key: changes read and rewrite the folders they touch, and no others.

A key's rows are always in the same folder, so an upsert needs only the folders of its changes. What they become is written to the
shared folder first and then put in their place by Spark's dynamic partition overwrite; files of other folders stay as they are.
Rows with a null key have a folder as well. Readers that began before keep their list of files, so change a table from one job at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.durable import discard, free, stored
from scholia.operators import merging

BUCKET = "_bucket"


@dataclass
class KeyedTable:
    """A table at a path. `folders` is fixed when it is created; about as many as keep a folder at some hundred megabytes."""

    spark: SparkSession
    path: str
    schema: str
    key: list[str]
    folders: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.folders)).cast("int")

    def create(self, rows: DataFrame) -> None:
        rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(self.path)

    def _files(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {BUCKET} INT").parquet(self.path)

    def rows(self) -> DataFrame:
        return self._files().drop(BUCKET)

    def touched(self, changes: DataFrame) -> list[int]:
        """The folders of the changes' keys: at most `folders` numbers."""
        return sorted(r[0] for r in changes.select(self._bucket()).distinct().collect())

    def _rewrite(self, folders: list[int], becomes) -> None:
        """Puts what becomes of the rows of some folders in their place. Folders that are left without rows are emptied."""
        present = self._files().where(F.col(BUCKET).isin(folders)).drop(BUCKET)
        after = stored(becomes(present).withColumn(BUCKET, self._bucket()))
        rows = after.repartition(BUCKET)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        kept = {r[0] for r in after.select(BUCKET).distinct().collect()}
        free(after)
        for n in set(folders) - kept:
            discard(self.spark, f"{self.path}/{BUCKET}={n}")

    def upsert(self, changes: DataFrame, order: str, keep_old: list[str] = ()) -> list[int]:
        """Inserts or replaces rows by key, the last by `order`; columns of `keep_old` keep their value where the new one is null. Returns the folders."""
        changes = stored(changes)
        if folders := self.touched(changes):
            self._rewrite(folders, lambda present: merging.upsert(present, changes, self.key, order, keep_old))
        free(changes)
        return folders

    def delete(self, keys: DataFrame) -> list[int]:
        keys = stored(keys.select(*self.key).distinct())
        if folders := self.touched(keys):
            same = lambda present: merging._same(present, keys, self.key)
            self._rewrite(folders, lambda present: present.join(keys, same(present), "left_anti"))
        free(keys)
        return folders
