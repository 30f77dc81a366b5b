"""Co-occurrence over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.operators import cooccurrence as C
from scholia.plans.aggregates import FACTS_SQL, facts
from scholia.registry import query


@query("pair_counts", f"""WITH {FACTS_SQL}, d AS (SELECT DISTINCT paper, value FROM facts)
SELECT x.value AS a, y.value AS b, count(*) AS count FROM d x JOIN d y USING (paper) WHERE x.value < y.value GROUP BY ALL HAVING count(*) >= 3""")
def pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.pair_counts(facts(spark, sf), "paper", "value", 3)


@query("trend_report", f"""WITH {FACTS_SQL}, d AS (SELECT DISTINCT paper, value, status, 'order ' || paper AS title FROM facts),
p AS (SELECT x.value AS a, y.value AS b, paper, x.status AS w, x.title FROM d x JOIN (SELECT DISTINCT paper, value FROM d) y USING (paper) WHERE x.value < y.value),
c AS (SELECT a, b, count(DISTINCT paper) AS papers, count(DISTINCT w) AS workflows FROM p GROUP BY a, b HAVING count(DISTINCT paper) >= 3 ORDER BY papers DESC, a, b LIMIT 50),
t AS (SELECT a, b, title, row_number() OVER (PARTITION BY a, b ORDER BY title) AS r FROM (SELECT DISTINCT a, b, title FROM p SEMI JOIN c USING (a, b)))
SELECT a, b, papers, workflows, string_agg(title, ', ' ORDER BY title) AS titles FROM c JOIN t USING (a, b) WHERE r <= 3 GROUP BY ALL""")
def trend_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf).withColumn("title", F.concat(F.lit("order "), F.col("paper").cast("string")))
    return C.trend_report(rows, "paper", "value", "status", "title")


@query("find_gaps", """WITH x AS (SELECT p_partkey AS paper, p_brand || ' ' || p_type AS a, 'size ' || p_size AS b FROM part), c AS (SELECT a, b, count(DISTINCT paper) AS papers FROM x GROUP BY a, b),
m AS (SELECT a, b, coalesce(papers, 0) AS papers FROM (SELECT DISTINCT a FROM x) CROSS JOIN (SELECT DISTINCT b FROM x) LEFT JOIN c USING (a, b)),
r AS (SELECT a, b, row_number() OVER (PARTITION BY b ORDER BY papers DESC, a) AS i FROM m), n AS (SELECT b, min(a) FILTER (i = 1) AS a1, min(a) FILTER (i = 2) AS a2 FROM r GROUP BY b)
SELECT a, b, papers, CASE WHEN papers = 0 THEN 'unexplored' ELSE 'underexplored' END AS kind, CASE WHEN a = a1 THEN a2 ELSE a1 END AS nearest
FROM m JOIN n USING (b) WHERE papers <= 2 ORDER BY papers, a, b LIMIT 30""")
def find_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("kind"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("size"))
    return C.find_gaps(rows, rows, "p_partkey", "kind", "size")


@query("workflow_comparison", """WITH v AS (SELECT DISTINCT c_mktsegment AS w, n_name || ' ' || CAST(floor(c_acctbal / 1000) AS INTEGER) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT value, count(DISTINCT w) AS k, min(w) AS w FROM v GROUP BY value), n AS (SELECT count(DISTINCT w) AS n FROM v),
f AS (SELECT CASE WHEN k = n AND n > 1 THEN 'shared' WHEN k = 1 THEN 'unique' END AS kind, CASE WHEN NOT (k = n AND n > 1) AND k = 1 THEN w END AS workflow, value FROM k, n)
SELECT kind, workflow, value FROM f WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind, workflow ORDER BY value) <= 20""")
def workflow_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "customer").join(F.broadcast(load(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = rows.select("c_mktsegment", F.concat_ws(" ", "n_name", F.floor(F.col("c_acctbal") / 1000).cast("int").cast("string")).alias("value"))
    return C.workflow_comparison(rows, "c_mktsegment", "value")


@query("value_sets", """SELECT n_name AS value, count(DISTINCT c_mktsegment) AS workflows, count(DISTINCT c_mktsegment) = (SELECT count(DISTINCT c_mktsegment) FROM customer) AS in_all FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def value_sets(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    rows = c.join(F.broadcast(load(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("value")).agg(F.countDistinct("c_mktsegment").alias("workflows"))
    n = c.agg(F.countDistinct("c_mktsegment").alias("n"))
    return rows.crossJoin(F.broadcast(n)).select("value", "workflows", (F.col("workflows") == F.col("n")).alias("in_all"))
