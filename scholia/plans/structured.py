"""Structured outputs, from small literal inputs and the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.functions import structured as S
from scholia.registry import query


@query("json_props", """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY event_type""")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k BIGINT")["k"]
    return load(spark, sf, "events").select("event_type", k.alias("k")).where("k IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("html_title", """SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(url, 'https?://([^/]+)', 1) AS host FROM pages""")
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("url", "https?://([^/]+)", 1).alias("host"))


@query("spectra", """WITH p AS (SELECT user_id, value, event_id % 50 AS x FROM events WHERE value >= 0) SELECT user_id, count(*) AS points, CAST(min(x) AS DOUBLE) AS low, CAST(max(x) AS DOUBLE) AS high FROM p GROUP BY user_id""")
def spectra(spark: SparkSession, sf: str) -> DataFrame:
    arrays = load(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.struct((F.col("event_id") % 50).alias("x"), "value")).alias("p"))
    s = arrays.select("user_id", S.clean_spectrum(F.col("p.x"), F.col("p.value")).alias("s"))
    return s.where(F.size("s") > 0).select("user_id", F.size("s").cast("long").alias("points"), F.col("s")[0]["x"].alias("low"), F.element_at("s", -1)["x"].alias("high"))


@query("doping_levels", """SELECT l_orderkey, count(*) AS atoms, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) AS concentration, greatest(8, CAST(floor(count(*) * 4 * 1.2) AS INTEGER)) AS bands FROM lineitem GROUP BY l_orderkey""")
def doping_levels(spark: SparkSession, sf: str) -> DataFrame:
    counts = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("atoms"), F.count_if(F.col("l_returnflag") == "R").alias("d"))
    return counts.select("l_orderkey", "atoms", (F.col("d").cast("double") / F.col("atoms")).alias("concentration"), S.default_bands(F.col("atoms")).alias("bands"))
