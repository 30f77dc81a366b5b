"""Connectors over records made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.durable import new_folder
from scholia.functions import structured as S
from scholia.registry import query
from scholia.sources import instruments as I
from scholia.sources import readers as R


@query("connector_union", """SELECT doc_id AS id, lang AS title, NULL AS url, 'documents' AS connector FROM documents UNION ALL SELECT page_id, NULL, url, 'pages' FROM pages UNION ALL SELECT item_id, text, NULL, 'benchmark' FROM benchmark""")
def connector_union(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.lit("documents").alias("connector"))
    p = load(spark, sf, "pages").select(F.col("page_id").alias("id"), "url", F.lit("pages").alias("connector"))
    b = load(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"), F.lit("benchmark").alias("connector"))
    return R.connectors(d, p, b).select("id", "title", "url", "connector")


@query("numeric_lines", """SELECT event_id, CAST(user_id AS DOUBLE) AS x, value AS y FROM events WHERE event_id % 3 <> 0""")
def numeric_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines made of events, every third a comment, read as a table of numbers."""
    e = load(spark, sf, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("# "), F.col("event_type"))).otherwise(F.concat_ws("\t", F.col("user_id").cast("string"), F.col("value").cast("string")))
    rows = e.select("event_id", line.alias("value"))
    cells = F.split("value", "\t")
    return rows.where(~F.col("value").startswith("#")).select("event_id", cells[0].try_cast("double").alias("x"), cells[1].try_cast("double").alias("y"))


@query("ascii_tables", """SELECT CAST(user_id AS DOUBLE) AS x, value AS y FROM events WHERE event_id % 4 <> 0 AND value IS NOT NULL""")
def ascii_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as lines of numbers between tabs, commas or blanks, with comments and other text among them, and the files read."""
    k, at = F.col("event_id") % 4, new_folder(spark, "tables")
    mark = F.when(k == 1, F.lit("\t")).when(k == 2, F.lit(" , ")).otherwise(F.lit("   "))
    line = F.when(k == 0, F.concat(F.when(F.col("event_id") % 8 == 0, F.lit("# ")).otherwise(F.lit("at ")), F.col("event_type"))).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), mark, F.col("value").cast("string")))
    load(spark, sf, "events").where("value IS NOT NULL").select(line.alias("value")).write.text(at)
    return R.ascii_table(spark, at).select("x", "y")


@query("delimiters", r"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN ',' WHEN 1 THEN chr(9) ELSE ' ' END AS delimiter FROM events""")
def delimiters(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    cells = F.array(F.col("user_id").cast("string"), F.col("event_type"), F.lit("x"))
    text = F.when(k == 0, F.concat(F.array_join(cells, ","), F.lit("\t"))).when(k == 1, F.concat(F.array_join(cells, "\t"), F.lit(","))).otherwise(F.array_join(cells, "  "))
    return load(spark, sf, "events").select("event_id", S.delimiter(text).alias("delimiter"))


@query("instrument_files", """WITH e AS (SELECT vec_id // 200 AS page, floor(abs(CAST(embedding[1] AS DOUBLE)) * 10000) AS y FROM embeddings) SELECT page, 'emsa' AS kind, count(*) AS points, (count(*) - 1) * 0.005 AS last, CAST(sum(y) AS BIGINT) AS total FROM e GROUP BY page""")
def instrument_files(spark: SparkSession, sf: str) -> DataFrame:
    """Spectra of up to 200 channels, made of vectors, written as files of an instrument, told by their first bytes and read back."""
    at = new_folder(spark, "spectra")
    y = F.floor(F.abs(F.col("embedding")[0].cast("double")) * 10000).cast("string")
    pages = load(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 200).alias("page"), F.struct("vec_id", y.alias("y")).alias("p")).groupBy("page").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["y"]).alias("y"))
    pages.select("page", F.concat(F.lit("#FORMAT : EMSA\n#EVCHANNEL : 5.0\n#SPECTRUM\n"), F.array_join("y", "\n"), F.lit("\n#ENDOFDATA")).alias("value")).write.partitionBy("page").text(at)
    found = I.spectra(spark, at, "*.txt").withColumn("page", F.regexp_extract("file", r"page=(\d+)", 1).cast("long"))
    total = F.aggregate("intensity", F.lit(0.0), lambda a, v: a + v).cast("long")
    return found.select("page", "kind", F.size("intensity").cast("long").alias("points"), F.element_at("axis", -1).alias("last"), total.alias("total"))
