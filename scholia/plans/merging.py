"""Inserts, upserts, updates and journals over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.durable import new_folder
from scholia.operators import merging as M
from scholia.operators.tables import KeyedTable
from scholia.registry import query


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Present accounts by user, and later events as changes."""
    e = load(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return e.where("event_id % 3 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"), F.max_by("value", "event_id").alias("value")), e.where("event_id % 3 <> 0 AND user_id % 2 = 0")


_SPLIT = """p AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_id % 3 = 0 GROUP BY user_id),
c AS (SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 3 <> 0 AND user_id % 2 = 0)"""


@query("insert_or_ignore", f"""WITH {_SPLIT} SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM (SELECT * FROM c WHERE event_id % 2 = 0) WHERE user_id NOT IN (SELECT user_id FROM p WHERE user_id % 4 = 0) GROUP BY user_id""")
def insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    present, changes = _split(spark, sf)
    return M.new_rows(present.where("user_id % 4 = 0"), changes.where("event_id % 2 = 0"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("upsert_latest", f"""WITH {_SPLIT}, l AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM c GROUP BY user_id)
SELECT coalesce(l.user_id, p.user_id) AS user_id, coalesce(l.event_id, p.event_id) AS event_id, coalesce(l.event_type, p.event_type) AS event_type, coalesce(l.value, p.value) AS value FROM p FULL JOIN l ON p.user_id = l.user_id""")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    present, changes = _split(spark, sf)
    return M.upsert(present, changes, ["user_id"], "event_id")


@query("upsert_coalesce", f"""WITH {_SPLIT}, l AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM c GROUP BY user_id)
SELECT coalesce(l.user_id, p.user_id) AS user_id, coalesce(l.event_id, p.event_id) AS event_id, coalesce(l.event_type, p.event_type) AS event_type, p.value FROM p FULL JOIN l ON p.user_id = l.user_id""")
def upsert_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    present, changes = _split(spark, sf)
    return M.upsert(present, changes.withColumn("value", F.lit(None).cast("double")), ["user_id"], "event_id", keep_old=["value"])


_ACCOUNTS = "user_id BIGINT, event_id BIGINT, event_type STRING, value DOUBLE"


@query("upsert_in_place", f"""WITH {_SPLIT}, l AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM c GROUP BY user_id)
SELECT coalesce(l.user_id, p.user_id) AS user_id, coalesce(l.event_id, p.event_id) AS event_id, coalesce(l.event_type, p.event_type) AS event_type, coalesce(l.value, p.value) AS value FROM p FULL JOIN l ON p.user_id = l.user_id""")
def upsert_in_place(spark: SparkSession, sf: str) -> DataFrame:
    """The upsert of a table of files, of which only the folders with changed keys are read and rewritten."""
    present, changes = _split(spark, sf)
    accounts = KeyedTable(spark, new_folder(spark, "accounts"), _ACCOUNTS, ["user_id"], 16)
    accounts.create(present)
    accounts.upsert(changes, "event_id")
    return accounts.rows()


@query("upsert_in_place_coalesce", f"""WITH {_SPLIT}, l AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM c GROUP BY user_id)
SELECT coalesce(l.user_id, p.user_id) AS user_id, coalesce(l.event_id, p.event_id) AS event_id, coalesce(l.event_type, p.event_type) AS event_type, p.value FROM p FULL JOIN l ON p.user_id = l.user_id WHERE coalesce(l.user_id, p.user_id) % 5 <> 0""")
def upsert_in_place_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    """The same with values that stay where the change has none, and a deletion after it."""
    present, changes = _split(spark, sf)
    accounts = KeyedTable(spark, new_folder(spark, "accounts"), _ACCOUNTS, ["user_id"], 16)
    accounts.create(present)
    accounts.upsert(changes.withColumn("value", F.lit(None).cast("double")), "event_id", ["value"])
    accounts.delete(accounts.rows().where("user_id % 5 = 0"))
    return accounts.rows()


@query("update_by_key", """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'MERGED' ELSE c_mktsegment END AS c_mktsegment, c_custkey % 10 = 0 AS matched FROM customer""")
def update_by_key(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    changes = c.where("c_custkey % 10 = 0").select("c_custkey", F.lit("MERGED").alias("c_mktsegment"))
    return M.update(c, changes, "c_custkey", ["c_mktsegment"], {"c_mktsegment"})


@query("update_audit", """SELECT c_custkey, 'c_mktsegment' AS column, c_mktsegment AS before, 'MERGED' AS after FROM customer WHERE c_custkey % 10 = 0 AND c_mktsegment <> 'MERGED'""")
def update_audit(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    changed = M.update(c, c.where("c_custkey % 10 = 0").select("c_custkey", F.lit("MERGED").alias("c_mktsegment")), "c_custkey", ["c_mktsegment"])
    return M.audit(c, changed, "c_custkey", ["c_mktsegment"])


@query("bulk_replace_preview", """SELECT c_custkey, c_name, regexp_replace(c_name, '0+', '#', 'g') AS after FROM customer WHERE regexp_matches(c_name, '0+') ORDER BY c_custkey LIMIT 20""")
def bulk_replace_preview(spark: SparkSession, sf: str) -> DataFrame:
    return M.replace_pattern(load(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "0+", "#").orderBy("c_custkey").limit(20)


@query("delete_semi", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def delete_semi(spark: SparkSession, sf: str) -> DataFrame:
    gone = load(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return M.delete_where(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("status_reset", """SELECT o_orderkey, CASE WHEN o_orderpriority >= '3' THEN 'pending' ELSE o_orderstatus END AS status FROM orders""")
def status_reset(spark: SparkSession, sf: str) -> DataFrame:
    stages = load(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("stage_name"), F.col("o_orderstatus").alias("status"))
    return M.reset_from(stages, ["1", "2", "3", "4", "5"], "3").select("o_orderkey", "status")


@query("write_journal", """WITH s AS (SELECT user_id, arg_max(CASE WHEN event_type = 'purchase' THEN 'written' ELSE 'pending' END, event_id) AS state, max(ts) AS ts FROM events GROUP BY user_id)
SELECT user_id, state FROM s WHERE state <> 'written' OR ts >= TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 24 HOUR""")
def write_journal(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    journal = e.groupBy("user_id").agg(F.max_by(F.when(F.col("event_type") == "purchase", "written").otherwise("pending"), "event_id").alias("state"), F.max("ts").alias("ts"))
    return M.purge(journal, "ts", "state", F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")).select("user_id", "state")


@query("ranked_export", """SELECT doc_id, source, upper(lang) AS lang, n_chars, round(least(1.0, n_chars / 10000.0), 4) AS score FROM documents ORDER BY least(1.0, n_chars / 10000.0) DESC, doc_id LIMIT 100""")
def ranked_export(spark: SparkSession, sf: str) -> DataFrame:
    score = F.least(F.lit(1.0), F.col("n_chars") / 10000.0)
    rows = load(spark, sf, "documents").select("doc_id", "source", F.upper("lang").alias("lang"), "n_chars", score.alias("_s")).orderBy(F.desc("_s"), "doc_id").limit(100)
    return rows.select("doc_id", "source", "lang", "n_chars", F.round("_s", 4).alias("score"))
