"""Table changes as DataFrames: what an insert, upsert, update or delete leaves behind.

Parquet tables are immutable; each function takes the present rows and the change and returns the rows to be written. Keys are
compared null-safely where a key may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & a[k].eqNullSafe(b[k])
    return out


def new_rows(present: DataFrame, rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """The rows whose key is not present yet, each key once (by `order`, if rows repeat keys): insert or ignore."""
    if order:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")
    known = present.select(*key).distinct()
    return rows.join(known, _same(rows, known, key), "left_anti")


def upsert(present: DataFrame, rows: DataFrame, key: list[str], order: str, keep_old: list[str] = ()) -> DataFrame:
    """Insert or replace: for each key the last row by `order` wins over the present one. Columns of `keep_old` fall back to the
    present value where the new one is null. One aggregate over the union; the winner is found by map-side combined max_by."""
    rest = [c for c in present.columns if c not in key]
    both = present.withColumn("_new", F.lit(0)).unionByName(rows.select(*present.columns).withColumn("_new", F.lit(1)))
    rank = F.struct("_new", order)
    last = both.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("_x"), F.max_by(F.struct(*rest), F.when(F.col("_new") == 0, F.col(order))).alias("_old"))
    return last.select(*key, *(F.coalesce(F.col(f"_x.{c}"), F.col(f"_old.{c}")).alias(c) if c in keep_old else F.col(f"_x.{c}").alias(c) for c in rest)).select(*present.columns)


def update(present: DataFrame, changes: DataFrame, key: str, columns: list[str], allowed: set[str] | None = None) -> DataFrame:
    """Sets the allowed columns of rows that have a change, where the change is not null; `matched` tells which rows had one."""
    if allowed is not None and (bad := set(columns) - allowed):
        raise ValueError(f"columns may not be updated: {sorted(bad)}")
    c = changes.select(F.col(key).alias("_key"), *(F.col(x).alias(f"_{x}") for x in columns), F.lit(True).alias("_hit"))
    rows = present.join(c, present[key] == F.col("_key"), "left")
    new = [F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in present.columns]
    return rows.select(*new, F.coalesce("_hit", F.lit(False)).alias("matched"))


def audit(present: DataFrame, updated: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each value that an update changed: key, column, before, after."""
    after = updated.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    rows = present.join(after, present[key] == F.col("_key"))
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("before"), F.col(f"_{c}").cast("string").alias("after")) for c in columns))
    return rows.select(key, F.explode(parts).alias("x")).select(key, "x.*").where("NOT (before <=> after)")


def replace_pattern(rows: DataFrame, column: str, pattern: str, by: str) -> DataFrame:
    """Rows whose column matches, with the whole new value in `after`; write it, or look at a limited preview first."""
    return rows.where(F.col(column).rlike(pattern)).withColumn("after", F.regexp_replace(column, pattern, by))


def delete_where(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """What is left once the rows of these keys are gone."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def reset_from(stages: DataFrame, order: list[str], stage: str, name: str = "stage_name") -> DataFrame:
    """Stages from the given one on are pending again, without times."""
    later = F.array_position(F.array(*map(F.lit, order)), F.col(name)) >= order.index(stage) + 1
    clear = {c: F.when(later, None).otherwise(F.col(c)) for c in ("started_at", "ended_at") if c in stages.columns}
    return stages.withColumn("status", F.when(later, "pending").otherwise(F.col("status"))).withColumns(clear)


def journal_state(journal: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """The last state of each submission of a two-phase journal."""
    return journal.groupBy(key).agg(F.max_by(state, F.struct(ts, state)).alias(state), F.max(ts).alias(ts))


def purge(journal: DataFrame, ts: str, state: str, now: Column, hours: int = 24) -> DataFrame:
    """Without what has been written for over `hours`; pending entries stay, however old."""
    return journal.where((F.col(state) != "written") | (F.col(ts) >= now - F.expr(f"INTERVAL {hours} HOURS")) | F.col(ts).isNull())
