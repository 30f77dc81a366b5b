"""Vector search over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.operators import vectors as V
from scholia.registry import query

_TOP = "SELECT query, vec_id, round(1 / (1 + d), 5) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS r FROM x) WHERE r <= 10"


def _scored(found: DataFrame) -> DataFrame:
    return found.select("query", "vec_id", F.round(V.similarity(F.col("distance")), 5).alias("score"), "rank")


@query("vector_topk", f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), x AS (SELECT q.vec_id AS query, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v q, v WHERE q.vec_id % 20 = 0) {_TOP}""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings")
    return _scored(V.top_k(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10))


@query("vector_topk_filtered", f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), x AS (SELECT q.vec_id AS query, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v q, v WHERE q.vec_id % 20 = 0 AND v.label = 3) {_TOP}""")
def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings")
    return _scored(V.top_k(e.where("label = 3"), e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10))


@query("vector_norms", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(e[1] / (sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-10), 6) AS first, len(e) AS dimensions FROM v""")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    n = V.normalized(F.col("embedding"))
    return load(spark, sf, "embeddings").select("vec_id", F.round(n[0], 6).alias("first"), F.size("embedding").cast("long").alias("dimensions"))


_SECTIONS = [("methods", [0, 1, 2]), ("results", [2, 3, 4, 5]), ("discussion", [5, 9])]


@query("section_evidence", f"""WITH s(section, label) AS (VALUES {", ".join(f"('{s}', {c})" for s, cs in _SECTIONS for c in cs)}), v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings)
SELECT section, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, vec_id) AS rank FROM s JOIN v USING (label)) WHERE rank <= 8""")
def section_evidence(spark: SparkSession, sf: str) -> DataFrame:
    hits = load(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("score"))
    sections = spark.createDataFrame(_SECTIONS, "section STRING, categories ARRAY<INT>")
    return V.evidence(sections, hits, "section", "label", "score", "vec_id")
