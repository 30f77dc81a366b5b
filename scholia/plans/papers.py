"""Papers' sections, values of facts, steps of plans, and files written and read again, each beside equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.durable import new_folder
from scholia.functions import lexicons as L
from scholia.functions import papers as P
from scholia.functions import structured as S
from scholia.functions import text as T
from scholia.registry import query
from scholia.sources import readers, writers

_PAPER_SQL = r"""CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'Title' || chr(10) || ' ABSTRACT ' || chr(10) || text || chr(10) || 'Results and Discussion' || chr(10) || lang || chr(10) || 'Conclusion' || chr(10) || 'Outlook' || chr(10) || source
WHEN 2 THEN 'Introduction' || chr(10) || lang || chr(10) || 'Methods' || chr(10) || text || chr(10) || 'introduction' || chr(10) || source ELSE 'references here' || chr(10) || text || chr(10) || 'References and notes' || chr(10) || lang END"""


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with headers among their lines, as papers' raw texts have them."""
    line = lambda *parts: F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    text, lang, source, k = F.col("text"), F.col("lang"), F.col("source"), F.col("doc_id") % 4
    raw = F.when(k == 0, text).when(k == 1, line("Title", " ABSTRACT ", text, "Results and Discussion", lang, "Conclusion", "Outlook", source))
    raw = raw.when(k == 2, line("Introduction", lang, "Methods", text, "introduction", source)).otherwise(line("references here", text, "References and notes", lang))
    return load(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL").select("doc_id", raw.alias("raw"))


_RAW_SQL = rf"""p AS (SELECT doc_id, {_PAPER_SQL} AS raw FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL),
l AS (SELECT doc_id, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM p),
h AS (SELECT *, regexp_full_match(regexp_replace(line, '^\s+|\s+$', '', 'g'), '(?i)(?:{P.HEADERS})') AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM h),
n AS (SELECT doc_id, part, coalesce(max(lower(replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), ' ', '_'))) FILTER (head), 'body') AS name, count(*) FILTER (NOT head) AS lines,
  regexp_replace(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), '^\s+|\s+$', '', 'g') AS content FROM s GROUP BY doc_id, part),
k AS (SELECT * FROM n WHERE lines > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY part DESC) = 1),
r AS (SELECT doc_id, name, CASE WHEN name = 'body' AND count(*) OVER (PARTITION BY doc_id) = 1 THEN raw ELSE content END AS content FROM k JOIN p USING (doc_id))"""


@query("raw_sections", f"WITH {_RAW_SQL} SELECT doc_id, name, md5(content) AS content FROM r")
def raw_sections(spark: SparkSession, sf: str) -> DataFrame:
    return _papers(spark, sf).select("doc_id", F.inline(P.raw_sections(F.col("raw")))).select("doc_id", "name", F.md5("content").alias("content"))


@query("paper_types", f"""WITH {_RAW_SQL}, t AS (SELECT doc_id, bool_or(regexp_matches(name, '^(i|ii|iii|iv|v|vi|vii|viii)_|summary_and_outlook|future_direction|perspective|outlook')) AS review FROM r GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS chosen FROM r JOIN t USING (doc_id) WHERE name NOT IN ({", ".join(f"'{x}'" for x in P.SKIPPED)}) AND (review OR name NOT IN ('introduction', 'i_introduction')) AND regexp_matches(content, '\\S') GROUP BY doc_id)
SELECT doc_id, CASE WHEN review THEN 'REVIEW' ELSE 'EXPERIMENTAL' END AS kind, coalesce(chosen, '') AS chosen FROM t LEFT JOIN c USING (doc_id)""")
def paper_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = _papers(spark, sf).select("doc_id", P.raw_sections(F.col("raw")).alias("s"))
    names = lambda c: F.transform(c, lambda s: s["name"])
    kind = F.when(P.is_review(names(F.col("s"))), "REVIEW").otherwise("EXPERIMENTAL")
    return rows.select("doc_id", kind.alias("kind"), F.array_join(F.array_sort(names(P.selected_sections(F.col("s")))), ",").alias("chosen"))


@query("keyword_sections", rf"""WITH p AS (SELECT doc_id, {_PAPER_SQL} AS raw FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL),
m AS (SELECT doc_id, string_split(regexp_replace(raw, '(^|\n)({'|'.join(P.HEADINGS)})\b', chr(1) || '\2' || chr(1), 'gi'), chr(1)) AS parts FROM p),
s AS (SELECT doc_id, unnest(range(2, len(parts), 2)) AS i, parts FROM m),
n AS (SELECT doc_id, i, lower(parts[i]) AS name, regexp_replace(parts[i + 1], '^\s+|\s+$', '', 'g') AS content FROM s)
SELECT doc_id, name, md5(content) AS content FROM n WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY i DESC) = 1""")
def keyword_sections(spark: SparkSession, sf: str) -> DataFrame:
    return _papers(spark, sf).select("doc_id", F.inline(P.keyword_sections(F.col("raw")))).select("doc_id", "name", F.md5("content").alias("content"))


@query("numbers_with_units", r"""WITH n AS (SELECT doc_id, regexp_extract_all(text, '(\d+(?:\.\d+)?)\s*(?:[A-Za-z%°]+)', 1) AS n FROM documents) SELECT doc_id, CAST(len(n) AS BIGINT) AS n, array_to_string(n, ' ') AS numbers FROM n WHERE len(n) > 0""")
def numbers_with_units(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"(\d+(?:\.\d+)?)\s*(?:[A-Za-z%°]+)"), F.lit(1)).alias("texts"), T.numbers_with_unit(F.col("text")).alias("n"))
    return rows.where(F.size("n") > 0).select("doc_id", F.size("n").cast("long").alias("n"), F.array_join("texts", " ").alias("numbers"))


@query("folder_names", r"""SELECT page_id, substr(regexp_replace(trim(regexp_replace(url, '[^\w\s-]', '', 'g')), '[\s-]+', '_', 'g'), 1, 80) AS folder FROM pages""")
def folder_names(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", T.folder_name(F.col("url")).alias("folder"))


@query("latex_texts", r"""SELECT doc_id, md5(replace(replace(replace(regexp_replace(replace(text, '\', chr(1)), '([&%$#_{}])', '\\\1', 'g'), '~', '\textasciitilde{}'), '^', '\textasciicircum{}'), chr(1), '\textbackslash{}')) AS latex FROM documents""")
def latex_texts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.md5(T.latex(F.col("text"))).alias("latex"))


@query("mentions", r"""SELECT doc_id, 'license' AS subject, 'mentioned_in' AS relation, substr(text, 1, 100) AS object FROM documents WHERE contains(lower(text), 'license')""")
def mentions(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("doc_id", T.mentions(F.col("text"), F.lit("license")).alias("m"))
    return rows.where("m IS NOT NULL").select("doc_id", "m.*")


@query("subtypes", r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '\b(?:license|licence)\b') THEN 'legal' END, CASE WHEN regexp_matches(lower(text), '\b(?:password|token|secret)\b') THEN 'secret' END], lambda x: x IS NOT NULL), ',') AS kinds FROM documents""")
def subtypes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.array_join(T.subtypes(F.col("text"), {"legal": "license|licence", "secret": "password|token|secret"}), ",").alias("kinds"))


@query("equation_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, line, length(regexp_replace(line, '[^=+\-*/^_∑∫√≤≥≈×]', '', 'g')) AS n, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l)
SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '[=≈≤≥]') AND n >= 2 AND n * 2 >= words) AS equations FROM s GROUP BY doc_id""")
def equation_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(T.equation_score(F.col("line"))).alias("equations"))


_HINTS = (("the ", "results"), ("und", "methods"), ("les ", "discussion"))


@query("section_hints", f"""SELECT doc_id, coalesce({", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{v}' END" for k, v in _HINTS)}) AS hint FROM documents""")
def section_hints(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", T.first_label(F.col("text"), _HINTS).alias("hint"))


@query("abstract_labels", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([{", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{v}' END" for k, v in L.CHARACTERIZATION)}], lambda x: x IS NOT NULL))), '|') AS labels FROM documents""")
def abstract_labels(spark: SparkSession, sf: str) -> DataFrame:
    """All labels of a text, in any order of the lexicon."""
    return load(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(T.all_labels(F.col("text"), L.CHARACTERIZATION)), "|").alias("labels"))


@query("similar_answers", r"""WITH d AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '\w+')) AS x, list_distinct(regexp_extract_all(lower(before), '\w+')) AS y FROM d WHERE before IS NOT NULL AND text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN text = before OR (len(x) = 0 AND len(y) = 0) THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END AS similarity FROM w""")
def similar_answers(spark: SparkSession, sf: str) -> DataFrame:
    """How alike each turn is to the one before it, by common words."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = load(spark, sf, "conversations").withColumn("before", before).where("before IS NOT NULL AND text IS NOT NULL")
    return rows.select("conv_id", "turn", T.similar_texts(F.col("text"), F.col("before")).alias("similarity"))


@query("similar_prices", """SELECT o_orderkey, greatest(0.0, 1 - abs(o_totalprice - 150000) / greatest(abs(o_totalprice), 150000.0, 1.0)) AS similarity FROM orders""")
def similar_prices(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", T.similar_numbers(F.col("o_totalprice"), F.lit(150000.0)).alias("similarity"))


# Files


@query("jsonl_round_trip", """SELECT event_id, user_id, event_type, value FROM events""")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended as JSON lines in two batches, and read again."""
    events, at = load(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), new_folder(spark, "events")
    for half in (0, 1):
        writers.append_jsonl(events.where(F.col("event_id") % 2 == half), at)
    return readers.jsonl(spark, at, ", ".join(f"{n} {t}" for n, t in events.dtypes))


@query("json_array_round_trip", """SELECT n_nationkey, n_name FROM nation""")
def json_array_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The nations as one array in one file, as small services give them, and read again."""
    at = new_folder(spark, "nations")
    one = load(spark, sf, "nation").select(F.struct("n_nationkey", "n_name").alias("n")).agg(F.to_json(F.collect_list("n")).alias("value"))  # 25 nations
    one.write.text(at)
    schema = load(spark, sf, "nation").select("n_nationkey", "n_name").schema
    return readers.json_array(spark, at, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))


@query("append_and_swap", """SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus""")
def append_and_swap(spark: SparkSession, sf: str) -> DataFrame:
    """Orders appended by status in two transactions, and their counts written beside them as the next state of a table."""
    orders, at = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), new_folder(spark, "orders")
    for part in ("o_orderkey % 2 = 0", "o_orderkey % 2 <> 0"):
        writers.append(orders.where(part), at, ["o_orderstatus"])
    counts = spark.read.schema("o_orderkey BIGINT, o_orderstatus STRING").parquet(at).groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    writers.swap(counts, f"{at}-next")
    return spark.read.parquet(f"{at}-next")
