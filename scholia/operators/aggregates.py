"""Grouped counts, summaries and bounded lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def technique_frequency(facts: DataFrame, category: str, value: str, paper: str, workflow: str, top: int = 20, at_least: int = 2) -> DataFrame:
    """The most frequent values: facts, papers and workflows of each (category, value), most facts first."""
    counts = facts.groupBy(category, value).agg(F.count("*").alias("count"), F.countDistinct(paper).alias("papers"), F.countDistinct(workflow).alias("workflows"))
    return counts.where(F.col("count") >= at_least).orderBy(F.desc("count"), category, value).limit(top)


def knowledge_summary(facts: DataFrame, category: str, value: str, paper: str, top: int = 10) -> DataFrame:
    """For each category its facts, papers and most frequent values, as value (count) in order of count, then value."""
    totals = facts.groupBy(category).agg(F.count("*").alias("facts"), F.countDistinct(paper).alias("papers"))
    counts = facts.groupBy(category, value).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(category).orderBy(F.desc("n"), value))).where(F.col("rank") <= top)
    listed = ranked.groupBy(category).agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col(value).cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("text")))).alias("l"))
    return totals.join(listed, category, "left").select(category, "facts", "papers", F.array_join(F.transform("l", lambda x: x["text"]), ", ").alias("top_values"))


def conditional_counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows there are and how many meet each condition, in one pass."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def status_counts(rows: DataFrame, key: str, status: str, values: tuple[str, ...]) -> DataFrame:
    """For each key its rows by status, in one pass; zero where a status does not occur."""
    return rows.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values))


def counts_of(parents: DataFrame, children: DataFrame, key: str, child_key: str, status: str, values: tuple[str, ...]) -> DataFrame:
    """Each parent with its children's counts by status; parents without children count zero."""
    counts = status_counts(children, child_key, status, values)
    joined = parents.join(counts.withColumnRenamed(child_key, "_key"), F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.fillna(0, ["total", *(f"n_{v.lower()}" for v in values)])


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0.0 where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(0.0)).otherwise(a / b)


def buckets(rows: DataFrame, value: str, edges: list[float], label: str = "bucket") -> DataFrame:
    """Counts of rows by bucket: below the first edge, from each edge to the next, from the last on; null for null."""
    name = F.when(F.col(value).isNull(), F.lit("null"))
    for low, high in zip([None, *edges], [*edges, None]):
        inside = (F.lit(True) if low is None else F.col(value) >= low) & (F.lit(True) if high is None else F.col(value) < high)
        name = name.when(inside, F.lit(f"{'' if low is None else low}..{'' if high is None else high}"))
    return rows.groupBy(name.alias(label)).agg(F.count("*").alias("count"))


def tag_index(rows: DataFrame, key: str, value: str, cap: int = 3) -> DataFrame:
    """For each key its distinct values in order, the first `cap` of them listed, and how many more there are."""
    distinct = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("v"))
    more = F.size("v") - cap
    listed = F.array_join(F.slice("v", 1, cap), ", ")
    return distinct.select(key, F.size("v").cast("long").alias("n_values"), F.concat(listed, F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(F.lit(""))).alias("tags"))


def clusters(rows: DataFrame, cluster: str, paper: str, order: str, per_cluster: int = 3, top: int = 4) -> DataFrame:
    """The largest clusters, by papers, and each one's first papers; a paper counts once, by its first row."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(cluster, paper).orderBy(order))).where("_r = 1")
    sizes = first.groupBy(cluster).agg(F.count("*").alias("size")).orderBy(F.desc("size"), cluster).limit(top)
    ranked = first.join(F.broadcast(sizes), cluster).withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy(paper)))
    return ranked.where(F.col("rank") <= per_cluster).select(cluster, "size", "rank", paper)


def merged_sections(rows: DataFrame, keys: list[str], order: str, text: str, limit: int = 50_000) -> DataFrame:
    """One row per key with the texts of its rows, in order, joined by an empty line and cut to `limit` characters.

    Only the rows that reach into the first `limit` characters are gathered; a window streams over the others.
    """
    before = Window.partitionBy(*keys).orderBy(order, text).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    placed = rows.withColumn("_at", F.coalesce(F.sum(F.length(text) + 2).over(before), F.lit(0))).withColumn("_rows", F.count("*").over(every))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    joined = F.array_join(F.transform(parts, lambda x: x[text]), "\n\n")
    return placed.where(F.col("_at") < limit + 2).groupBy(*keys).agg(F.max("_rows").alias("parts"), F.substring(joined, 1, limit).alias("content"))


def token_batches(rows: DataFrame, group: str, order: str, tokens: str, budget: int = 2500) -> DataFrame:
    """Packs each group's rows, in order, into batches of at most `budget` tokens; a larger row has a batch of its own.

    The running sum starts anew with each batch, so no window expresses it. The rows arrive sorted and are streamed with a state of
    two numbers: nothing is gathered, whatever a group's size. Ties in `order` are told apart by tokens.
    """
    rows = rows.select(group, order, F.col(tokens).cast("long").alias(tokens))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", batch int"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, batch = object(), 0, 0
        for b in batches:
            out = []
            for g, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if g != current:
                    current, total, batch = g, 0, 1
                if total > 0 and total + (t or 0) > budget:
                    total, batch = 0, batch + 1
                total += t or 0
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], [*b.schema.names, "batch"])

    return rows.repartition(group).sortWithinPartitions(group, order, tokens).mapInArrow(pack, schema)


def next_number(rows: DataFrame, key: str, number: str) -> DataFrame:
    """For each key the number that follows its greatest; 1 if it has none."""
    return rows.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def weighted_score(scores: dict[str, float]) -> Column:
    """The weighted sum of score columns; null scores count 0."""
    total = F.lit(0.0)
    for name, weight in scores.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * weight
    return total


def daily_lines(events: DataFrame, ts: str, agent: str, text: str, order: str, first: int = 3) -> DataFrame:
    """The report of each day: for each agent its events, and the first of them in order, as lines."""
    day = F.to_date(ts)
    counts = events.groupBy(day.alias("day"), agent).agg(F.count("*").alias("events"))
    head = events.select(day.alias("day"), agent, F.col(order).alias("o"), F.col(text).alias("t")).withColumn("r", F.row_number().over(Window.partitionBy("day", agent).orderBy("o", "t")))
    lines = F.array_sort(F.collect_list(F.struct("r", "t")))
    listed = head.where(F.col("r") <= first).groupBy("day", agent).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "; ").alias("first_lines"))
    same = counts["day"].eqNullSafe(listed["day"]) & counts[agent].eqNullSafe(listed[agent])
    return counts.join(listed, same).select(counts["day"], counts[agent], "events", "first_lines")
