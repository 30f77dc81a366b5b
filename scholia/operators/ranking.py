"""Ranking within groups, balanced sampling, keep-first, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, group: str | list[str], order: list[Column], top: int, rank: str = "rank") -> DataFrame:
    """The first `top` rows of each group. `order` must end in a unique column, so the choice is the same each time.

    Spark limits each input partition's groups before the shuffle, so a group of any size sends at most `top` rows per task.
    """
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= top)


def keep_first(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def latest(rows: DataFrame, key: str, version: str, tie: str) -> DataFrame:
    """The row of each key's greatest version; the greatest `tie` among equals. A map-side combined aggregate, not a window."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version, tie)).alias("_x")).select(key, "_x.*")


def balanced_sample(rows: DataFrame, category: str, source: str, order: str, cap: int) -> DataFrame:
    """Up to `cap` rows of each category, taken from its sources in turn: each source's first, then each one's second, and so on.

    The turn is a row number within category and source; sources take turns in the order of their first row.
    """
    own = Window.partitionBy(category, source).orderBy(order)
    first = rows.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= cap).withColumn("_first", F.min(order).over(Window.partitionBy(category, source)))
    place = F.row_number().over(Window.partitionBy(category).orderBy("turn", "_first", order))
    return first.withColumn("place", place).where(F.col("place") <= cap).drop("_first")


def argmax_or_null(rows: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """The label of each key's greatest score; null if several labels share it."""
    top = rows.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc(score)))).where("_r = 1")
    return top.groupBy(key).agg(F.max(score).alias(score), F.when(F.count("*") == 1, F.min(label)).alias(label))


def best_with_margin(rows: DataFrame, key: str, label: str, score: str, least: float = 0.4, margin: float = 0.2) -> DataFrame:
    """Each key's best label, if its score is high enough and far enough above the runner-up's."""
    w = Window.partitionBy(key).orderBy(F.desc(score), label)
    ranked = rows.withColumns({"_r": F.row_number().over(w), "_next": F.lead(score).over(w)}).where("_r = 1")
    good = (F.col(score) >= least) & (F.col(score) - F.coalesce("_next", F.lit(0.0)) >= margin)
    return ranked.select(key, score, F.when(good, F.col(label)).alias(label))


def page(rows: DataFrame, key: str, cursor: int | str | None, size: int) -> DataFrame:
    """The rows after a cursor, in order of a unique key; `more` tells whether another page follows."""
    after = rows if cursor is None else rows.where(F.col(key) > F.lit(cursor))
    some = after.orderBy(key).limit(size + 1)
    w = Window.orderBy(key)  # over one page
    return some.withColumns({"_r": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy())}).where(F.col("_r") <= size).withColumn("more", F.col("_n") > size).drop("_r", "_n")


def forward_fill(rows: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """Each row with the last value at or before it within its group that is not null."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
