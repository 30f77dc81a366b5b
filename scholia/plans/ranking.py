"""Ranking, sampling and sequence operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.operators import ranking as R
from scholia.registry import query


@query("topn_per_workflow", """SELECT c_mktsegment, o_orderkey, o_totalprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r <= 20""")
def topn_per_workflow(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(load(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return R.top_per_group(rows, "c_mktsegment", [F.desc("o_totalprice"), F.asc("o_orderkey")], 20).select("c_mktsegment", "o_orderkey", "o_totalprice", "rank")


@query("top_values_per_category", """SELECT event_type, user_id, n, CAST(r AS INTEGER) AS rank FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY event_type, user_id) WHERE r <= 10""")
def top_values_per_category(spark: SparkSession, sf: str) -> DataFrame:
    counts = load(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return R.top_per_group(counts, "event_type", [F.desc("n"), F.asc("user_id")], 10)


@query("context_load_balanced", """WITH t AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY lang, source) AS f FROM documents)
SELECT lang, source, doc_id, CAST(turn AS INTEGER) AS turn, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, f, doc_id) AS place FROM t) WHERE place <= 50""")
def context_load_balanced(spark: SparkSession, sf: str) -> DataFrame:
    return R.balanced_sample(load(spark, sf, "documents").select("lang", "source", "doc_id"), "lang", "source", "doc_id", 50)


@query("latest_version", """SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) = 1""")
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest(load(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("keep_first_text", """SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang, lower(trim(text)) ORDER BY doc_id) = 1""")
def keep_first_text(spark: SparkSession, sf: str) -> DataFrame:
    """Keep-first by (category, folded value). The key is a 128-bit digest of the folded text, so texts are not shuffled."""
    folded = F.lower(F.trim("text"))
    docs = load(spark, sf, "documents").select("doc_id", "lang", F.md5(folded).alias("d"))
    return docs.groupBy("lang", "d").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "lang")


@query("priority_ranking", """SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey LIMIT 20""")
def priority_ranking(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return load(spark, sf, "orders").orderBy(rank, "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority")


@query("work_queue", """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 25""")
def work_queue(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderpriority"), "o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("argmax_without_ties", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM c)
SELECT user_id, max(n) AS n, CASE WHEN count(*) = 1 THEN min(event_type) END AS event_type FROM m WHERE r = 1 GROUP BY user_id""")
def argmax_without_ties(spark: SparkSession, sf: str) -> DataFrame:
    return R.argmax_or_null(load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "user_id", "event_type", "n")


@query("best_with_margin", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS score FROM c),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nx FROM s WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, event_type))
SELECT user_id, score, CASE WHEN score >= 0.2 AND score - coalesce(nx, 0) >= 0.05 THEN event_type END AS event_type FROM r WHERE r = 1""")
def best_with_margin(spark: SparkSession, sf: str) -> DataFrame:
    counts = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    shares = counts.withColumn("score", F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).drop("n")
    return R.best_with_margin(shares, "user_id", "event_type", "score", 0.2, 0.05)


@query("keyset_page", """WITH p AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 26) SELECT c_custkey, c_name, (SELECT count(*) FROM p) > 25 AS more FROM p ORDER BY c_custkey LIMIT 25""")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return R.page(load(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 40, 25)


@query("section_fill", """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations""")
def section_fill(spark: SparkSession, sf: str) -> DataFrame:
    return R.forward_fill(load(spark, sf, "conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")), "heading").select("conv_id", "turn", "role", "heading")


@query("reading_order", """SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars // 500, n_chars % 7, doc_id) AS INTEGER) AS place FROM documents""")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """Regions in page order (page, then down, then across), here of a source's documents."""
    w = Window.partitionBy("source").orderBy(F.floor(F.col("n_chars") / 500), F.col("n_chars") % 7, "doc_id")
    return load(spark, sf, "documents").select("doc_id", "source", F.row_number().over(w).alias("place"))


@query("url_candidates", """WITH n AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '') AS u FROM pages) SELECT u AS url, min(page_id) AS first_page, count(*) AS pages FROM n GROUP BY u ORDER BY min(page_id) LIMIT 50""")
def url_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised addresses, each with its candidate of least priority."""
    u = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/[^/]*$", "")
    return load(spark, sf, "pages").groupBy(u.alias("url")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("pages")).orderBy("first_page").limit(50)
