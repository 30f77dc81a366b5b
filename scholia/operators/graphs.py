"""Dependency graphs and linear stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.durable import free, new_folder, stored

DONE = ("approved", "integrated")


def ready(nodes: DataFrame, key: str, status: str, depends: str, strict: bool = True) -> DataFrame:
    """The pending nodes all of whose dependencies are done. A dependency that does not exist blocks its node, unless not strict."""
    waiting = nodes.where(F.col(status) == "pending")
    edges = waiting.select(key, F.explode(F.array_distinct(depends)).alias("_d"))
    known = nodes.select(F.col(key).alias("_d"), F.col(status).isin(*DONE).alias("_done"))
    blocked = edges.join(known, "_d", "left").where(~F.coalesce("_done", F.lit(not strict))).select(key).distinct()
    return waiting.join(blocked, key, "left_anti")


def progress(nodes: DataFrame, key: str, status: str, depends: str) -> DataFrame:
    """One row: nodes, done, ready, whether all is complete, and whether nothing can go on (deadlock)."""
    totals = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col(status).isin(*DONE)).alias("done"), F.count_if(F.col(status) == "running").alias("running"))
    n = ready(nodes, key, status, depends).agg(F.count("*").alias("ready"))
    return totals.crossJoin(F.broadcast(n)).withColumn("complete", F.col("nodes") == F.col("done")).withColumn("deadlock", ~F.col("complete") & (F.col("ready") == 0) & (F.col("running") == 0)).drop("running")


#: More than any path is long; what goes round a cycle is cut there.
FAR = 1 << 50


def levels(nodes: DataFrame, key: str, depends: str) -> DataFrame:
    """key, level: the round in which each node can run, from 1. Nodes on or behind a cycle or a missing node get none.

    A node's level is the greatest of a constant and of its open edges' levels plus their lengths. Each round takes the edges to nodes that
    have a level into the constant, and edges to a node with a single open edge pass over that node: they lead where its edge leads,
    by the sum of both lengths. So paths double: a chain or tree of n nodes takes log n rounds, and no graph more than it has levels. A
    round is written to the shared folder, two small tables, so plans stay short and a lost executor costs one round.
    """
    return levels_and_rounds(nodes, key, depends)[0]


def levels_and_rounds(nodes: DataFrame, key: str, depends: str) -> tuple[DataFrame, int]:
    spark = nodes.sparkSession
    at = new_folder(spark, "levels")
    edges = nodes.select(F.col(key).alias("node"), F.explode(F.array_distinct(depends)).alias("on")).distinct()
    edges = stored(edges.select("node", "on", F.lit(1).cast("long").alias("length"), F.lit(1).cast("long").alias("least")))
    now = stored(nodes.select(F.col(key).alias("node")).distinct().join(edges.select("node"), "node", "left_anti").withColumn("level", F.lit(1).cast("long")))
    kind = now.schema["node"].dataType.simpleString()
    rounds, of = 0, Window.partitionBy("node")
    while not now.isEmpty():
        now.withColumn("level", F.col("level").cast("int")).write.mode("append").parquet(at)
        rounds += 1
        met = edges.join(now.select(F.col("node").alias("on"), "level"), "on", "left")
        met = met.withColumn("least", F.max(F.greatest("least", F.coalesce(F.col("level") + F.col("length"), F.lit(0)))).over(of)).withColumn("open", F.count_if(F.col("level").isNull()).over(of))
        met = stored(met)
        free(edges, now)
        now = stored(met.where("open = 0").select("node", F.col("least").alias("level")).distinct())
        open_ = met.where("level IS NULL")
        single = open_.where("open = 1 AND node <> on").select(F.col("node").alias("on"), F.col("on").alias("_on"), F.col("length").alias("_length"), F.col("least").alias("_least"))
        passed = F.col("_length").isNotNull()
        jumped = open_.join(single, "on", "left").select(
            "node",
            F.when(passed, F.col("_on")).otherwise(F.col("on")).alias("on"),
            F.least(F.col("length") + F.coalesce("_length", F.lit(0)), F.lit(FAR)).alias("length"),
            F.least(F.greatest("least", F.col("_least") + F.col("length")), F.lit(FAR)).alias("least"),
        )
        edges = stored(jumped.groupBy("node", "on").agg(F.max("length").alias("length"), F.max("least").alias("least")))
        free(met)
    free(edges, now)
    found = spark.read.schema(f"node {kind}, level int").parquet(at) if rounds else spark.createDataFrame([], f"node {kind}, level int")
    return found.withColumnRenamed("node", key), rounds


def next_stage(stage: Column, stages: tuple[str, ...]) -> Column:
    """The stage after one; complete after the last, the first for null, null for an unknown one."""
    order = F.array(*map(F.lit, stages))
    at = F.array_position(order, stage)
    return F.when(stage.isNull(), stages[0]).when(at == len(stages), "complete").when(at > 0, F.get(order, at.cast("int")))


def best_draft(drafts: DataFrame, key: str, version: str, draft: str, score: str, good: float = 7.5, most: int = 4) -> DataFrame:
    """Each section's best draft among its first `most` versions (the earliest of equals), and whether it is good enough."""
    rows = drafts.where(F.col(version) <= most)
    best = rows.groupBy(key).agg(F.max_by(F.struct(version, draft, score), F.struct(score, -F.col(version))).alias("b"), F.count("*").alias("versions"))
    return best.select(key, "versions", f"b.{version}", f"b.{score}", (F.col(f"b.{score}") >= good).alias("accepted"))
