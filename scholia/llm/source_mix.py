"""Mixing sources to target weights, with DataFrame operations alone.

Sources share all words by weight; no source is asked for more than MAX_RATE times what it has, and the excess is reshared
among the others by weight until none is above its limit. A document is then taken floor(rate) times and once more if a
draw, seeded by its id, falls below the rate's fraction, so reruns and retried tasks agree.

A null text has size 0; null and empty sources are sources like any other (null comes last). Without any words all targets
are 0 and nothing is taken. A repeated row is drawn like its twin: both are taken equally often. A null id is drawn by the
text instead. Only doc_id, text and source are read; ``mix`` carries
all other columns along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.llm.common import SPACED_WORD, cut, table

WEIGHTS = (1, 2, 3)
MAX_RATE = 3
SEED = "mix-1"
#: The table of rates is broadcast up to so many sources and bytes of their names; beyond, it is joined by a shuffle.
BROADCAST_SOURCES, BROADCAST_BYTES = 50_000, 4 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number from [0, 1) that depends on the seed and the document alone: 52 bits of a digest."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(2**52)


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """source, source_size, target: one row per source.

    Sorted by limit / weight, the sources that meet their limits come first; the first that does not sets the level at
    which all after it share the rest. The windows run over one row per source, not over documents.
    """
    sizes = docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    rows = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * max_rate).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level).withColumn("open", F.col("ratio") > F.col("level"))
    rows = rows.withColumn("level", F.min(F.when(F.col("open"), F.struct("ratio", "level"))).over(whole)["level"])
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level"))
    return rows.select("source", "source_size", target.alias("target"))


def _small(rates: DataFrame) -> bool:
    n, size = rates.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    return n <= BROADCAST_SOURCES and size <= BROADCAST_BYTES


def _rated(docs: DataFrame, seed: str) -> DataFrame:
    """row (the input's columns), doc_id, size, source_size, target, copies."""
    rates = cut(targets(docs))
    rates = (F.broadcast(rates) if _small(rates) else rates).withColumnRenamed("source", "of")
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), "doc_id", "source", words(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    rows = rows.join(rates, F.col("source").eqNullSafe(F.col("of")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.withColumn("copies", F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long"))


def assign(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: one row per input row."""
    rows = _rated(docs.select("doc_id", "text", "source"), seed)
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus: the input's rows and columns, each row as often as it is taken."""
    rows = _rated(docs, seed).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


RATES_SQL = r"""
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, cap / w AS ratio FROM w),
v AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT arg_min(level, ratio) AS level FROM v WHERE ratio > level),
t AS (SELECT source, source_size, CASE WHEN f.level IS NULL OR ratio <= f.level THEN CAST(cap AS DOUBLE) ELSE w * f.level END AS target FROM v LEFT JOIN f ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
c AS (SELECT d.*, r.source_size, r.target, CAST(floor(rate) AS BIGINT) + CASE WHEN CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13) AS BIGINT) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
"""
SIZE_SQL = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"
OP9_SQL = f"WITH d AS (SELECT doc_id, text, source, {SIZE_SQL} AS size FROM documents),\n{RATES_SQL}\nSELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM c"

QUERIES = {"op9_source_mix": op9_source_mix}
SQL = {"op9_source_mix": OP9_SQL}
