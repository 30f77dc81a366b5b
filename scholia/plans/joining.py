"""Joins and filters over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.functions import text as T
from scholia.operators import joining as J
from scholia.registry import query


@query("facts_of_workflow", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000""")
def facts_of_workflow(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000").select("o_orderkey")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query("two_category_pairs", """WITH a AS (SELECT DISTINCT l_orderkey AS p, p_brand AS a FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type LIKE 'ECONOMY%'),
b AS (SELECT DISTINCT l_orderkey AS p, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type LIKE 'PROMO%') SELECT a, b, count(*) AS papers FROM a JOIN b USING (p) GROUP BY a, b""")
def two_category_pairs(spark: SparkSession, sf: str) -> DataFrame:
    items, parts = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), load(spark, sf, "part")
    of = lambda kind, name: items.join(parts.where(F.col("p_type").startswith(kind)), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("p"), F.col("p_brand").alias(name)).distinct()
    return of("ECONOMY", "a").join(of("PROMO", "b"), "p").groupBy("a", "b").agg(F.count("*").alias("papers"))


@query("left_with_condition", """SELECT c_custkey, count(o_orderkey) AS open_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey""")
def left_with_condition(spark: SparkSession, sf: str) -> DataFrame:
    open_ = load(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("open_orders"))
    return load(spark, sf, "customer").select("c_custkey").join(open_, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("open_orders", F.lit(0)).alias("open_orders"))


@query("semi_exists", """SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)""")
def semi_exists(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", "c_name").join(load(spark, sf, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("in_subquery", """SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def in_subquery(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").select("l_suppkey", "l_partkey").join(load(spark, sf, "supplier").where("s_acctbal < 0").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"))


@query("anti_checkpoint", """SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def anti_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", "source").join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("lookup_counts", """SELECT n_name, coalesce(s.c, 0) AS suppliers, coalesce(c.c, 0) AS customers FROM nation LEFT JOIN (SELECT s_nationkey AS k, count(*) AS c FROM supplier GROUP BY ALL) s ON n_nationkey = s.k LEFT JOIN (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY ALL) c ON n_nationkey = c.k""")
def lookup_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    c = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    rows = load(spark, sf, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select("n_name", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("suppliers", "customers")))


@query("global_dedup_check", """WITH k AS (SELECT doc_id AS i, lower(trim(text)) AS t, source || ':' || n_chars AS doi FROM documents), a AS (SELECT doi, min(i) AS i FROM k GROUP BY doi), b AS (SELECT t, min(i) AS i FROM k GROUP BY t)
SELECT doc_id, coalesce(a.i, b.i) AS match FROM documents LEFT JOIN a ON source || ':' || n_chars = a.doi LEFT JOIN b ON lower(trim(text)) = b.t""")
def global_dedup_check(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", F.concat_ws(":", "source", F.col("n_chars").cast("string")).alias("doi"), F.md5(F.lower(F.trim("text"))).alias("title"))
    return J.lookup_or(docs, docs, "doi", "title", "doc_id").select("doc_id", "match")


_BOX_SQL = """r AS (SELECT doc_id AS id, source AS page, doc_id % 400 AS x0, (doc_id * 37) % 700 AS y0, doc_id % 400 + 50 + n_chars % 150 AS x1, (doc_id * 37) % 700 + 20 AS y1, lang FROM documents)"""


@query("nearest_caption", f"""WITH {_BOX_SQL}, p AS (SELECT c.page, c.id AS caption, b.id AS box, greatest(0, c.y0 - b.y1, b.y0 - c.y1) AS gap FROM r c JOIN r b ON c.page = b.page AND c.lang = 'de' AND b.lang = 'fr'
WHERE greatest(0, least(c.x1, b.x1) - greatest(c.x0, b.x0)) >= 0.2 * least(c.x1 - c.x0, b.x1 - b.x0))
SELECT page, caption, box, CAST(gap AS DOUBLE) AS gap FROM p WHERE gap <= 80 QUALIFY row_number() OVER (PARTITION BY page, caption ORDER BY gap, box) = 1""")
def nearest_caption(spark: SparkSession, sf: str) -> DataFrame:
    d = lambda c: c.cast("double")
    i, n = F.col("doc_id"), F.col("n_chars")
    boxes = load(spark, sf, "documents").select(i.alias("id"), F.col("source").alias("page"), d(i % 400).alias("x0"), d(i * 37 % 700).alias("y0"), d(i % 400 + 50 + n % 150).alias("x1"), d(i * 37 % 700 + 20).alias("y1"), "lang")
    return J.nearest_box(boxes.where("lang = 'de'"), boxes.where("lang = 'fr'"), ["page"])


@query("section_by_context", """WITH n AS (SELECT p_brand AS name, min(p_partkey) AS o, lower(substr(p_brand, 1, 8)) AS k FROM part GROUP BY p_brand)
SELECT o_orderkey, arg_min(n.name, n.o) AS name FROM (SELECT o_orderkey, 'see brand#' || (o_orderkey % 60) || ' here' AS context FROM orders) LEFT JOIN n ON contains(lower(context), k) GROUP BY o_orderkey""")
def section_by_context(spark: SparkSession, sf: str) -> DataFrame:
    names = load(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("o"))
    rows = load(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("see brand#"), (F.col("o_orderkey") % 60).cast("string"), F.lit(" here")).alias("context"))
    return J.first_containing(rows, "context", names, "name", "o", 8)


@query("region_references", """SELECT a.doc_id, b.lang AS caption FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id - 1 AND b.source = a.source""")
def region_references(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "source", "lang")
    other = docs.select((F.col("doc_id") + 1).alias("_of"), F.col("source").alias("_s"), F.col("lang").alias("caption"))
    return docs.join(other, (F.col("doc_id") == F.col("_of")) & (F.col("source") == F.col("_s")), "left").select("doc_id", "caption")


@query("relation_edges", """SELECT n_name AS subject, 'in' AS relation, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'has', n_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def relation_edges(spark: SparkSession, sf: str) -> DataFrame:
    both = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.explode(F.array(*(F.struct(F.col(a).alias("subject"), F.lit(r).alias("relation"), F.col(b).alias("object")) for a, r, b in (("n_name", "in", "r_name"), ("r_name", "has", "n_name"))))).alias("e")).select("e.*")


@query("slot_overwrite", """WITH l AS (SELECT user_id, arg_max(value, event_id) AS v FROM events GROUP BY user_id) SELECT user_id, CASE WHEN v BETWEEN 1 AND 100 THEN v END AS value, CASE WHEN v BETWEEN 1 AND 100 THEN 1.0 ELSE 0.0 END AS confidence FROM l""")
def slot_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """The last value of each slot; out of range it is null, at confidence 0."""
    last = load(spark, sf, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("v"))
    good = F.col("v").between(1, 100)
    return last.select("user_id", F.when(good, F.col("v")).alias("value"), F.when(good, 1.0).otherwise(0.0).alias("confidence"))


@query("fuzzy_dedup")
def fuzzy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy near-title removal over all documents; the title is a text's first line, whole."""
    docs = load(spark, sf, "documents").select("doc_id", "source", "lang", F.substring_index("text", "\n", 1).alias("title"))
    return J.fuzzy_keep_first(docs, None, "doc_id", "title").drop("title")


@query("suspect_documents", """WITH s AS (SELECT d.doc_id, list_filter([CASE WHEN l.doc_id IS NULL THEN 'missing_label' END, CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'no_content' END, CASE WHEN length(trim(text)) BETWEEN 1 AND 79 THEN 'short_text' END, CASE WHEN lang IS NULL THEN 'missing_lang' END], lambda x: x IS NOT NULL) AS issues
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) SELECT doc_id, array_to_string(issues, ',') AS issues FROM s WHERE len(issues) > 0""")
def suspect_documents(spark: SparkSession, sf: str) -> DataFrame:
    labels = load(spark, sf, "labels").select("doc_id", F.lit(True).alias("known")).distinct()
    rows = load(spark, sf, "documents").select("doc_id", "lang", F.length(F.trim("text")).alias("n")).join(labels, "doc_id", "left")
    issues = T.issues(missing_label=F.col("known").isNull(), no_content=F.coalesce(F.col("n"), F.lit(0)) == 0, short_text=F.col("n").between(1, 79), missing_lang=F.col("lang").isNull())
    return rows.withColumn("i", issues).where(F.size("i") > 0).select("doc_id", F.array_join("i", ",").alias("issues"))


_TOPIC = ("tion", "thing", "license")


@query("find_by_topic", f"""WITH h AS (SELECT page_id, contains(lower(url), 'license') OR contains(lower(url), 'thing') AS u, {" OR ".join(f"contains(lower(html), '{k}')" for k in _TOPIC)} AS t FROM pages)
SELECT page_id, CASE WHEN u THEN 'url' ELSE 'html' END AS found_in FROM h WHERE u OR t ORDER BY CASE WHEN u THEN 0 ELSE 1 END, page_id LIMIT 100""")
def find_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "pages").select("page_id", T.any_keyword(F.col("url"), ("license", "thing")).alias("u"), T.any_keyword(F.col("html"), _TOPIC).alias("t"))
    return rows.where("u OR t").select("page_id", F.when(F.col("u"), "url").otherwise("html").alias("found_in")).orderBy(F.when(F.col("found_in") == "url", 0).otherwise(1), "page_id").limit(100)


@query("filters", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus NOT IN ('P') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AND o_totalprice >= 1000 ORDER BY o_orderkey""")
def filters(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.where_all(load(spark, sf, "orders"), {"o_custkey": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89], "o_shippriority": None}, at_least={"o_totalprice": 1000})
    return rows.where("o_orderpriority IS NOT NULL AND o_orderstatus NOT IN ('P') AND o_orderdate >= TIMESTAMP_NTZ '1996-01-01'").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("long_texts", """SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS preview, 'finding' AS category FROM documents WHERE length(trim(text)) > 50""")
def long_texts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").where(F.length(F.trim("text")) > 50).select("doc_id", T.preview(F.col("text"), 80).alias("preview"), F.lit("finding").alias("category"))


@query("draft_previews", """SELECT conv_id, turn, substr(text, 1, 200) AS preview FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) = 1""")
def draft_previews(spark: SparkSession, sf: str) -> DataFrame:
    from scholia.operators.ranking import keep_first

    rows = load(spark, sf, "conversations").where(F.col("role").isin("user", "assistant"))
    return keep_first(rows, [F.col("conv_id")], [F.desc("turn"), F.asc("role")]).select("conv_id", "turn", F.substring("text", 1, 200).alias("preview"))
