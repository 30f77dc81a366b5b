"""Documents, regions and typed pages over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.functions import documents as D
from scholia.registry import query


@query("assembled_documents", """SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || coalesce(nullif(trim(CASE WHEN turn % 2 = 0 THEN NULL ELSE text END), ''), nullif(trim(text), ''), ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id""")
def assembled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The final text of odd turns, else the draft."""
    rows = load(spark, sf, "conversations").withColumn("final", F.when(F.col("turn") % 2 != 0, F.col("text")))
    return D.assemble(rows, "conv_id", "turn", "role", "final", "text")


@query("flattened_pages", """SELECT event_id, event_type AS kind, value AS amount, value > 50 AS large FROM events""")
def flattened_pages(spark: SparkSession, sf: str) -> DataFrame:
    large = F.when(F.col("value").isNotNull(), (F.col("value") > 50).cast("string"))
    pages = load(spark, sf, "events").select("event_id", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("amount"), F.col("value").cast("string"), F.lit("large"), large).alias("properties"))
    return D.flatten(pages, "properties", {"kind": "select", "amount": "number", "large": "checkbox"})


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("n_chars")
    d = lambda c, name: c.cast("double").alias(name)
    return load(spark, sf, "documents").select("doc_id", F.struct(d(i % 400, "x0"), d(i * 37 % 700, "y0"), d(i % 400 + n % 300, "x1"), d(i * 37 % 700 + n % 170, "y1")).alias("box"))


_BOXES = "b AS (SELECT doc_id, doc_id % 400 AS x0, doc_id * 37 % 700 AS y0, doc_id % 400 + n_chars % 300 AS x1, doc_id * 37 % 700 + n_chars % 170 AS y1 FROM documents)"


@query("kept_regions", f"""WITH {_BOXES} SELECT doc_id FROM b WHERE NOT (x1 <= x0 OR y1 <= y0 OR (x1 - x0) * (y1 - y0) < 0.02 * 700 * 800 OR greatest(x1 - x0, y1 - y0) > 7 * least(x1 - x0, y1 - y0) OR y1 < 0.07 * 800 OR y0 > 0.93 * 800)""")
def kept_regions(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes(spark, sf).where(~D.is_garbage_region(F.col("box"), F.lit(700.0), F.lit(800.0))).select("doc_id")


@query("boxes_in_points", f"""WITH {_BOXES} SELECT doc_id, x0 * 72.0 / 144.0 AS x0, y1 * 72.0 / 144.0 AS y1 FROM b""")
def boxes_in_points(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes(spark, sf).select("doc_id", D.scaled(F.col("box"), 144.0).alias("b")).select("doc_id", "b.x0", "b.y1")


@query("status_changes", """WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, user_id, event_type FROM l WHERE r = 1 OR b IS DISTINCT FROM event_type""")
def status_changes(spark: SparkSession, sf: str) -> DataFrame:
    return D.changes(load(spark, sf, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type")


@query("backfilled_scores", """WITH s AS (SELECT d.doc_id, CASE WHEN b.h IS NULL THEN NULL ELSE least(1.0, n_chars / 5000.0) END AS score FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, 1 AS h FROM labels) b USING (doc_id))
SELECT CASE WHEN score IS NULL THEN 'null' WHEN score < 0.2 THEN '..0.2' WHEN score < 0.6 THEN '0.2..0.6' ELSE '0.6..' END AS bucket, count(*) AS count FROM s GROUP BY ALL""")
def backfilled_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The distribution of a score that only some rows can be given."""
    from scholia.operators.aggregates import buckets

    known = load(spark, sf, "labels").select("doc_id", F.lit(1).alias("h")).distinct()
    rows = load(spark, sf, "documents").select("doc_id", "n_chars").join(known, "doc_id", "left")
    return buckets(rows.withColumn("score", F.when(F.col("h").isNotNull(), F.least(F.lit(1.0), F.col("n_chars") / 5000.0))), "score", [0.2, 0.6])
