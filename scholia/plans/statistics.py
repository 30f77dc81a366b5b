"""Statistics over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.functions import text as T
from scholia.operators import statistics as S
from scholia.registry import query


@query("numeric_stats", " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS count, count(*) - count({c}) AS missing, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS stdev FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def numeric_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.numeric_stats(load(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query("value_stats", """WITH c AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL) SELECT 'o_orderpriority' AS field, value, n, CAST((SELECT sum(n) FROM c) AS BIGINT) AS total_tags, (SELECT count(*) FROM c) AS unique FROM c ORDER BY n DESC, value LIMIT 10""")
def value_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.value_stats(load(spark, sf, "orders"), "o_orderpriority")


@query("column_stats", """SELECT 'c_name' AS field, 'title' AS type, count(*) FILTER (c_name <> '') AS count, count(*) FILTER (c_name IS NULL OR c_name = '') AS missing, NULL AS low, NULL AS high, NULL::DOUBLE AS detail FROM customer
UNION ALL SELECT 'c_nationkey', 'number', count(c_nationkey), count(*) - count(c_nationkey), CAST(min(c_nationkey) AS VARCHAR), CAST(max(c_nationkey) AS VARCHAR), round(avg(c_nationkey), 6) FROM customer
UNION ALL SELECT 'debt', 'checkbox', count(c_acctbal), count(*) - count(c_acctbal), NULL, NULL, CAST(count(*) FILTER (c_acctbal < 0) AS DOUBLE) FROM customer
UNION ALL SELECT 'c_mktsegment', 'select', count(c_mktsegment), count(*) - count(c_mktsegment), NULL, NULL, NULL FROM customer""")
def column_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "customer").withColumn("debt", F.col("c_acctbal") < 0)
    out = S.column_stats(rows, {"c_name": "title", "c_nationkey": "number", "debt": "checkbox", "c_mktsegment": "select"})
    return out.withColumn("detail", F.round("detail", 6))


_PAIRS = (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))


@query("pairwise_corr", "WITH r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS field_a, '{b}' AS field_b, corr({a}, {b}) AS r, count(*) AS sample_size FROM lineitem" for a, b in _PAIRS) + ") SELECT field_a, field_b, round(r, 3) + 0.0 AS pearson_r, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END || CASE WHEN r >= 0 THEN ' positive' ELSE ' negative' END AS strength, sample_size FROM r")
def pairwise_corr(spark: SparkSession, sf: str) -> DataFrame:
    return S.correlations(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("trend_direction", """WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
h AS (SELECT user_id, count(*) AS n, avg(value) FILTER (i <= n // 2) AS a, avg(value) FILTER (i > n // 2) AS b, stddev_samp(value) AS s FROM p GROUP BY user_id)
SELECT user_id, n, CASE WHEN n < 4 THEN 'insufficient data' WHEN b - a > s * 0.25 THEN 'increasing' WHEN b - a < -s * 0.25 THEN 'decreasing' ELSE 'stable' END AS trend FROM h""")
def trend_direction(spark: SparkSession, sf: str) -> DataFrame:
    return S.trend(load(spark, sf, "events"), "user_id", "event_id", "value")


@query("consistency", """WITH s AS (SELECT user_id, count(*) AS entries, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000 AS days FROM events GROUP BY user_id), g AS (SELECT *, CASE WHEN entries > 1 THEN days / (entries - 1) END AS gap FROM s),
c AS (SELECT *, CASE WHEN entries > 1 THEN least(100.0, greatest(0.0, 100.0 * (1.0 - (gap - 1.0) / 6.0))) ELSE 0.0 END AS score FROM g)
SELECT user_id, entries, round(gap, 2) AS gap_days, round(score) AS score, CASE WHEN entries < 2 THEN 'insufficient data' WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'moderate' ELSE 'irregular' END AS label FROM c""")
def consistency(spark: SparkSession, sf: str) -> DataFrame:
    return S.consistency(load(spark, sf, "events"), "user_id", "ts")


@query("event_gaps", """SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000 AS gap_s FROM events""")
def event_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return S.gaps(load(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").drop("ts")


@query("parameter_distribution", """WITH n AS (SELECT event_type, user_id, CAST(regexp_extract(props, '([0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) AS number FROM events WHERE regexp_matches(props, '[0-9]'))
SELECT event_type, count(*) AS values, count(DISTINCT user_id) AS papers, avg(number) AS mean, min(number) AS low, max(number) AS high FROM n GROUP BY event_type""")
def parameter_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("event_type", "user_id", T.quantity(F.col("props"))["number"].alias("number"))
    return S.parameter_distribution(rows, "event_type", "number", "user_id")


@query("dominant_units", """WITH r AS (SELECT l_returnflag AS category, l_quantity AS number, CASE WHEN l_linenumber % 3 = 0 THEN 'nm' WHEN l_linenumber % 3 = 1 THEN 'eV' ELSE 'K' END AS unit, l_orderkey AS paper FROM lineitem),
u AS (SELECT category, unit, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, unit) AS i FROM r GROUP BY category, unit), o AS (SELECT r.* FROM r JOIN u USING (category, unit) WHERE i = 1),
t AS (SELECT category, count(*) AS count, count(DISTINCT paper) AS papers FROM r GROUP BY category), e AS (SELECT category, min(unit) AS unit, min(number) AS low, max(number) AS high FROM o GROUP BY category),
m AS (SELECT category, number AS mode FROM (SELECT category, number, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, number) AS i FROM o GROUP BY category, number) WHERE i = 1)
SELECT category, count, papers, unit, low, high, mode, high - low AS range FROM t JOIN e USING (category) JOIN m USING (category)""")
def dominant_units(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_linenumber") % 3
    rows = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("number"), F.when(k == 0, "nm").when(k == 1, "eV").otherwise("K").alias("unit"), F.col("l_orderkey").alias("paper"))
    return S.by_dominant_unit(rows, "category", "number", "unit", "paper")


_STOP = ", ".join(f"'{w}'" for w in "this that with have been from they were their there what when where which will would could should then than also some into about your just like more very".split())


@query("top_keywords", f"""SELECT word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) >= 4 AND word NOT IN ({_STOP}) GROUP BY word ORDER BY count DESC, word LIMIT 10""")
def top_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return S.top_keywords(load(spark, sf, "documents"), T.keywords(F.col("text")))
