"""Counts and summaries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.operators import aggregates as A
from scholia.registry import query

FACTS_SQL = """facts AS (SELECT l_orderkey AS paper, split_part(p_type, ' ', 1) AS category, p_brand AS value, o_orderpriority AS workflow, o_orderstatus AS status, l_shipdate AS shipped, l_suppkey AS supp
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as facts: the part's brand is a value of its kind's category, the order the paper, its priority the workflow."""
    items = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    parts = load(spark, sf, "part").select("p_partkey", "p_brand", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("category"))
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("l_orderkey").alias("paper"), "category", F.col("p_brand").alias("value"), F.col("o_orderpriority").alias("workflow"), F.col("o_orderstatus").alias("status"), F.col("l_shipdate").alias("shipped"), F.col("l_suppkey").alias("supp"))


@query("technique_frequency", f"""WITH {FACTS_SQL} SELECT category, value, count(*) AS count, count(DISTINCT paper) AS papers, count(DISTINCT workflow) AS workflows
FROM facts GROUP BY category, value HAVING count(*) >= 2 ORDER BY count(*) DESC, category, value LIMIT 20""")
def technique_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return A.technique_frequency(facts(spark, sf), "category", "value", "paper", "workflow")


@query("technique_frequency_scope", f"""WITH {FACTS_SQL} SELECT count(*) AS facts, count(DISTINCT paper) AS papers, count(DISTINCT workflow) AS workflows, count(DISTINCT category) AS categories FROM facts""")
def technique_frequency_scope(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).agg(F.count("*").alias("facts"), F.countDistinct("paper").alias("papers"), F.countDistinct("workflow").alias("workflows"), F.countDistinct("category").alias("categories"))


@query("knowledge_summary", """WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rank FROM c),
l AS (SELECT event_type, string_agg(user_id || ' (' || n || ')', ', ' ORDER BY rank) AS top_values FROM r WHERE rank <= 10 GROUP BY event_type),
t AS (SELECT event_type, count(*) AS facts, count(DISTINCT CAST(ts AS DATE)) AS papers FROM events GROUP BY event_type)
SELECT event_type, facts, papers, top_values FROM t JOIN l USING (event_type)""")
def knowledge_summary(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    return A.knowledge_summary(events, "event_type", "user_id", "day")


@query("database_stats", """WITH o AS (SELECT count(*) AS orders, count(DISTINCT o_custkey) AS ordering, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders),
l AS (SELECT count(*) AS items, count(DISTINCT l_partkey) AS parts FROM lineitem), c AS (SELECT count(*) AS customers FROM customer)
SELECT orders, ordering, finished, items, parts, customers, CASE WHEN orders = 0 THEN 0.0 ELSE finished / orders END AS finished_rate, CASE WHEN orders = 0 THEN 0.0 ELSE items / orders END AS density FROM o, l, c""")
def database_stats(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("ordering"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    i = load(spark, sf, "lineitem").agg(F.count("*").alias("items"), F.countDistinct("l_partkey").alias("parts"))
    c = load(spark, sf, "customer").agg(F.count("*").alias("customers"))
    one = o.crossJoin(F.broadcast(i)).crossJoin(F.broadcast(c))  # one row each
    return one.withColumn("finished_rate", A.ratio(F.col("finished"), F.col("orders"))).withColumn("density", A.ratio(F.col("items"), F.col("orders")))


@query("workflow_status", """SELECT n_nationkey, n_name, count(o_orderkey) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey, n_name""")
def workflow_status(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").join(load(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return A.counts_of(load(spark, sf, "nation").select("n_nationkey", "n_name"), orders, "n_nationkey", "c_nationkey", "o_orderstatus", ("F", "O", "P"))


@query("registry_stats", """SELECT count(*) AS total, count(*) FILTER (c_acctbal < 0) AS in_debt, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_nationkey IS NULL) AS homeless, count(DISTINCT c_nationkey) AS nations FROM customer""")
def registry_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    counts = A.conditional_counts(c, in_debt=F.col("c_acctbal") < 0, building=F.col("c_mktsegment") == "BUILDING", homeless=F.col("c_nationkey").isNull())
    return counts.crossJoin(F.broadcast(c.agg(F.countDistinct("c_nationkey").alias("nations"))))


@query("dft_summary", """SELECT l_returnflag AS calc_type, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS completed, count(*) FILTER (l_linestatus = 'O') AS open,
CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) / count(l_quantity) AS mean_wall FROM lineitem GROUP BY l_returnflag""")
def dft_summary(spark: SparkSession, sf: str) -> DataFrame:
    items = load(spark, sf, "lineitem")
    mean = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count("l_quantity")
    return items.groupBy(F.col("l_returnflag").alias("calc_type")).agg(F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("completed"), F.count_if(F.col("l_linestatus") == "O").alias("open"), mean.alias("mean_wall"))


@query("section_status", """SELECT CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS approved, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS pending FROM orders""")
def section_status(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over no rows are null, as in SQL (see the tests)."""
    of = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, 1).otherwise(0))
    return load(spark, sf, "orders").agg(of("F").alias("approved"), of("O").alias("pending"))


@query("context_summary", """SELECT lang, count(*) AS facts, count(DISTINCT source) AS papers, min(doc_id) AS first_id FROM documents GROUP BY lang""")
def context_summary(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("facts"), F.countDistinct("source").alias("papers"), F.min("doc_id").alias("first_id"))


@query("knowledge_distribution", """SELECT source, count(*) AS facts FROM documents SEMI JOIN labels USING (doc_id) GROUP BY source""")
def knowledge_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("facts"))


@query("conditional_buckets", """SELECT CASE WHEN o_totalprice IS NULL THEN 'null' WHEN o_totalprice < 1000 THEN '..1000' WHEN o_totalprice < 50000 THEN '1000..50000' WHEN o_totalprice < 200000 THEN '50000..200000' ELSE '200000..' END AS bucket, count(*) AS count FROM orders GROUP BY ALL""")
def conditional_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return A.buckets(load(spark, sf, "orders"), "o_totalprice", [1000, 50000, 200000])


@query("tag_index", """WITH v AS (SELECT l_suppkey, list_sort(list(DISTINCT p_brand)) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey)
SELECT l_suppkey, CAST(len(v) AS BIGINT) AS n_values, array_to_string(v[1:3], ', ') || CASE WHEN len(v) > 3 THEN ' (+' || (len(v) - 3) || ' more)' ELSE '' END AS tags FROM v""")
def tag_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").select("l_suppkey", "l_partkey").join(load(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return A.tag_index(rows, "l_suppkey", "p_brand")


@query("evidence_clusters", f"""WITH {FACTS_SQL}, d AS (SELECT DISTINCT value, paper FROM facts), s AS (SELECT value, count(*) AS size FROM d GROUP BY value ORDER BY size DESC, value LIMIT 4)
SELECT value, size, rank, paper FROM (SELECT value, size, paper, CAST(row_number() OVER (PARTITION BY value ORDER BY paper) AS INTEGER) AS rank FROM d JOIN s USING (value)) WHERE rank <= 3""")
def evidence_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return A.clusters(facts(spark, sf), "value", "paper", "shipped")


@query("merged_sections", """SELECT conv_id, role, count(*) AS parts, substr(string_agg(text, chr(10) || chr(10) ORDER BY turn, text), 1, 50000) AS content FROM conversations GROUP BY conv_id, role""")
def merged_sections(spark: SparkSession, sf: str) -> DataFrame:
    return A.merged_sections(load(spark, sf, "conversations"), ["conv_id", "role"], "turn", "text")


@query("token_budget_batches", """WITH RECURSIVE d AS (SELECT source, doc_id, length(text) // 4 AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT source, doc_id, tokens, i, tokens AS sum, 1 AS batch FROM d WHERE i = 1
  UNION ALL SELECT d.source, d.doc_id, d.tokens, d.i, CASE WHEN r.sum > 0 AND r.sum + d.tokens > 2500 THEN d.tokens ELSE r.sum + d.tokens END, CASE WHEN r.sum > 0 AND r.sum + d.tokens > 2500 THEN r.batch + 1 ELSE r.batch END
  FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source AND d.i = r.i + 1)
SELECT source, doc_id, CAST(tokens AS BIGINT) AS tokens, batch FROM r""")
def token_budget_batches(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("source", "doc_id", F.floor(F.length("text") / 4).alias("tokens"))
    return A.token_batches(docs, "source", "doc_id", "tokens")


@query("next_sequence", """SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def next_sequence(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "customer").select("c_custkey").join(load(spark, sf, "orders").select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return A.next_number(rows, "c_custkey", "o_orderkey")


@query("rubric_scores", """SELECT p_partkey, CAST(p_size AS DOUBLE) * 0.5 + coalesce(CAST(length(p_name) AS DOUBLE), 0.0) * 0.25 AS score,
CASE WHEN p_size < 5 THEN 'rework' WHEN p_size < 7 AND length(p_name) > 3 THEN 'review' ELSE 'coherent' END AS flag FROM part""")
def rubric_scores(spark: SparkSession, sf: str) -> DataFrame:
    parts = load(spark, sf, "part").withColumns({"a": F.col("p_size").cast("double"), "b": F.length("p_name").cast("double")})
    flag = F.when(F.col("p_size") < 5, "rework").when((F.col("p_size") < 7) & (F.length("p_name") > 3), "review").otherwise("coherent")
    return parts.select("p_partkey", A.weighted_score({"a": 0.5, "b": 0.25}).alias("score"), flag.alias("flag"))


@query("daily_report", """WITH r AS (SELECT CAST(ts AS DATE) AS day, event_type, event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY CAST(ts AS DATE), event_type) AS events, user_id FROM events)
SELECT CAST(day AS VARCHAR) AS day, event_type, events, string_agg('user ' || user_id, '; ' ORDER BY event_id) AS first_lines FROM r WHERE i <= 3 GROUP BY day, event_type, events""")
def daily_report(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").withColumn("line", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    return A.daily_lines(events, "ts", "event_type", "line", "event_id").withColumn("day", F.col("day").cast("string"))


@query("distinct_json_values", """SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def distinct_json_values(spark: SparkSession, sf: str) -> DataFrame:
    parsed = load(spark, sf, "events").select(F.explode(F.array(F.from_json("props", "k BIGINT")["k"])).alias("k"))
    return parsed.where("k IS NOT NULL").distinct()


@query("vector_counts", """SELECT label, count(*) AS vectors, CAST(min(len(embedding)) AS INTEGER) AS dimensions FROM embeddings GROUP BY label""")
def vector_counts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"), F.min(F.size("embedding")).alias("dimensions"))
