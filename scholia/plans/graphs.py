"""Dependency graphs over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import STAGES, load
from scholia.operators import graphs as G
from scholia.registry import query


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as sections: each depends on a half and a third of its number."""
    k = F.col("p_partkey")
    part = load(spark, sf, "part").select(k.alias("node"), F.array_distinct(F.filter(F.array(F.floor(k / 2), F.floor(k / 3)), lambda x: x > 0)).alias("depends"))
    return part.withColumn("status", F.when(F.col("node") % 5 != 0, "approved").otherwise("pending"))


_NODES = """n AS (SELECT p_partkey AS node, list_distinct(list_filter([p_partkey // 2, p_partkey // 3], lambda x: x > 0)) AS depends, CASE WHEN p_partkey % 5 <> 0 THEN 'approved' ELSE 'pending' END AS status FROM part),
e AS (SELECT node, unnest(depends) AS dep FROM n)"""


@query("ready_sections", f"""WITH {_NODES} SELECT node FROM n WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM e LEFT JOIN n m ON m.node = e.dep WHERE e.node = n.node AND coalesce(m.status, 'missing') NOT IN ('approved', 'integrated'))""")
def ready_sections(spark: SparkSession, sf: str) -> DataFrame:
    return G.ready(_nodes(spark, sf), "node", "status", "depends").select("node")


@query("graph_progress", f"""WITH {_NODES}, r AS (SELECT count(*) AS ready FROM n WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM e LEFT JOIN n m ON m.node = e.dep WHERE e.node = n.node AND coalesce(m.status, 'missing') NOT IN ('approved', 'integrated')))
SELECT count(*) AS nodes, count(*) FILTER (status = 'approved') AS done, any_value(ready) AS ready, count(*) = count(*) FILTER (status = 'approved') AS complete, any_value(ready) = 0 AND count(*) <> count(*) FILTER (status = 'approved') AS deadlock FROM n, r""")
def graph_progress(spark: SparkSession, sf: str) -> DataFrame:
    return G.progress(_nodes(spark, sf), "node", "status", "depends")


@query("graph_levels", f"""WITH RECURSIVE {_NODES}, l AS (SELECT node, 1 AS level FROM n WHERE node NOT IN (SELECT dep FROM e WHERE false) AND NOT EXISTS (SELECT 1 FROM e WHERE e.node = n.node) UNION SELECT e.node, l.level + 1 FROM e JOIN l ON e.dep = l.node)
SELECT node, max(level) AS level FROM l GROUP BY node""")
def graph_levels(spark: SparkSession, sf: str) -> DataFrame:
    return G.levels(_nodes(spark, sf), "node", "depends")


@query("best_drafts", """WITH d AS (SELECT l_orderkey AS section, l_linenumber AS version, max(l_quantity / 5) AS score FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL)
SELECT section, count(*) AS versions, arg_max(version, score * 100 - version) AS version, max(score) AS score, max(score) >= 7.5 AS accepted FROM d GROUP BY section""")
def best_drafts(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("section"), F.col("l_linenumber").alias("version")).agg(F.max(F.col("l_quantity") / 5).alias("score")).withColumn("draft", F.lit(""))
    return G.best_draft(rows, "section", "version", "draft", "score")
