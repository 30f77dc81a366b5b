"""Values that occur together in a paper: pairs, gaps between categories, comparison of workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.durable import broadcast_if_small, cut


def pair_counts(facts: DataFrame, paper: str, value: str, at_least: int = 1) -> DataFrame:
    """a, b, count: papers in which both values occur, a < b.

    Facts are made distinct first, so the self-join meets each value of a paper once; pairs are counted before they are shuffled.
    """
    one = facts.select(F.col(paper).alias("p"), F.col(value).alias("a")).where("p IS NOT NULL AND a IS NOT NULL").distinct()
    pairs = one.join(one.withColumnRenamed("a", "b"), "p").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("count")).where(F.col("count") >= at_least)


def trend_report(facts: DataFrame, paper: str, value: str, workflow: str, title: str, at_least: int = 3, top: int = 50, samples: int = 3) -> DataFrame:
    """The pairs of values most often found in one paper, with the workflows they span and the first few titles."""
    one = facts.select(F.col(paper).alias("p"), F.col(value).alias("a"), F.col(workflow).alias("w"), F.col(title).alias("t")).distinct()
    other = one.select("p", F.col("a").alias("b")).distinct()
    pairs = one.join(other, "p").where("a < b")
    counts = pairs.groupBy("a", "b").agg(F.countDistinct("p").alias("papers"), F.countDistinct("w").alias("workflows"))
    best = counts.where(F.col("papers") >= at_least).orderBy(F.desc("papers"), "a", "b").limit(top)
    best = cut(best)
    # the few best pairs are looked up in the facts anew, so that all pairs are made once
    titles = one.select("p", "a", "t").join(F.broadcast(best.select("a", "b")), "a").join(other, ["p", "b"]).select("a", "b", "t").distinct()
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("t"))
    listed = titles.withColumn("r", rank).where(F.col("r") <= samples).groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("t")), ", ").alias("titles"))
    return best.join(listed, ["a", "b"])


def find_gaps(left: DataFrame, right: DataFrame, paper: str, a: str, b: str, threshold: int = 2, cap: int = 30) -> DataFrame:
    """Pairs of a value of `left` and one of `right` that share at most `threshold` papers: the matrix's gaps.

    Each gap tells its papers, whether it is unexplored or underexplored, and the other a with most papers for the same b (most, then
    least name). All cells of the matrix are made: the two value lists must be short, as categories' known values are.
    """
    l, r = left.select(F.col(paper).alias("p"), F.col(a).alias("a")).distinct(), right.select(F.col(paper).alias("p"), F.col(b).alias("b")).distinct()
    counts = l.join(r, "p").groupBy("a", "b").agg(F.count("*").alias("papers"))
    cells = l.select("a").distinct().crossJoin(broadcast_if_small(r.select("b").distinct())).join(counts, ["a", "b"], "left").fillna(0, ["papers"])
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("papers"), "a"))
    best = cells.withColumn("r", rank).where("r <= 2").groupBy("b").agg(F.min(F.when(F.col("r") == 1, F.col("a"))).alias("a1"), F.min(F.when(F.col("r") == 2, F.col("a"))).alias("a2"))
    gaps = cells.where(F.col("papers") <= threshold).join(broadcast_if_small(best), "b")
    kind = F.when(F.col("papers") == 0, "unexplored").otherwise("underexplored")
    return gaps.select("a", "b", "papers", kind.alias("kind"), F.when(F.col("a") == F.col("a1"), F.col("a2")).otherwise(F.col("a1")).alias("nearest")).orderBy("papers", "a", "b").limit(cap)


def workflow_comparison(values: DataFrame, workflow: str, value: str, cap: int = 20) -> DataFrame:
    """kind, workflow, value: values shared by all workflows (workflow null), and each workflow's own, the first `cap` of them.

    One aggregate says in how many workflows a value occurs, and in which if it is one alone; no set is gathered.
    """
    n = values.select(workflow).where(F.col(workflow).isNotNull()).distinct().agg(F.count("*").alias("n"))
    of = values.where(F.col(workflow).isNotNull() & F.col(value).isNotNull()).groupBy(value).agg(F.countDistinct(workflow).alias("k"), F.min(workflow).alias("w")).crossJoin(F.broadcast(n))
    kind = F.when((F.col("k") == F.col("n")) & (F.col("n") > 1), "shared").when(F.col("k") == 1, "unique")
    found = of.withColumn("kind", kind).where("kind IS NOT NULL").select("kind", F.when(F.col("kind") == "unique", F.col("w")).alias("workflow"), F.col(value).alias("value"))
    rank = F.row_number().over(Window.partitionBy("kind", "workflow").orderBy("value"))
    return found.withColumn("r", rank).where(F.col("r") <= cap).drop("r")
