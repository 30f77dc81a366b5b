"""Text rules over the documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.functions import lexicons as L
from scholia.functions import text as T
from scholia.operators import joining as J
from scholia.registry import query

_CLEAN_SQL = "text"
for _p, _b, _o in T.CLEANUP:
    _CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '{_p}', '{_b}', 'g{_o}')"
_CLEAN_SQL = f"trim(replace({_CLEAN_SQL}, '- ', ''))"


@query("clean_text", f"SELECT doc_id, md5({_CLEAN_SQL}) AS cleaned, length({_CLEAN_SQL}) AS n FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = T.clean_scientific_text(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", cleaned.alias("c")).select("doc_id", F.md5("c").alias("cleaned"), F.length("c").cast("long").alias("n"))


@query("chunk_text", r"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, text, n, 0 AS start, 1 AS i, CASE WHEN n <= 3500 THEN n END AS stop FROM d
  UNION ALL SELECT doc_id, text, n, e - 200, i + 1, CASE WHEN e - 200 + 3500 >= n THEN n END FROM (
    SELECT *, start + CASE WHEN strpos(reverse(substr(text, start + 3201, 300)), ' .') = 0 THEN 3500 ELSE 3500 - strpos(reverse(substr(text, start + 3201, 300)), ' .') END AS e FROM c WHERE stop IS NULL)),
p AS (SELECT doc_id, i, start, CASE WHEN stop IS NOT NULL THEN substr(text, start + 1) ELSE regexp_replace(substr(text, start + 1, CASE WHEN strpos(reverse(substr(text, start + 3201, 300)), ' .') = 0 THEN 3500 ELSE 3500 - strpos(reverse(substr(text, start + 3201, 300)), ' .') END), '^\s+|\s+$', '', 'g') END AS chunk FROM c),
k AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS nr FROM p WHERE regexp_matches(chunk, '\S'))
SELECT doc_id, CAST(nr AS INTEGER) AS chunk, CAST(length(chunk) AS INTEGER) AS n, md5(chunk) AS digest FROM k""")
def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "text")).select("doc_id", "chunk", F.length("text").alias("n"), F.md5("text").alias("digest"))


_NOISE_SQL = " OR ".join(f"contains(lower(s), '{p}')" for p in L.NOISE_PHRASES)


@query("noise_sentences", rf"""WITH s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents),
w AS (SELECT doc_id, s, list_filter(string_split_regex(s, '\s+'), lambda x: x <> '') AS w, length(s) - length(replace(s, ',', '')) AS commas FROM s WHERE length(trim(s)) > 0),
m AS (SELECT doc_id, {_NOISE_SQL} OR (regexp_matches(s, '{T.ADDRESS[0]}') AND regexp_matches(s, '{T.ADDRESS[1]}')) OR regexp_matches(s, '{T.AUTHORS}')
  OR (len(w) < 20 AND commas >= 3 AND len(list_filter(w, lambda x: regexp_matches(x, '\d'))) >= 2 AND len(list_filter(w, lambda x: regexp_matches(x, '^\p{{L}}{{2,}}$'))) <= len(w) * 0.7)
  OR (length(trim(s)) < 40 AND regexp_matches(s, '\d') AND regexp_matches(s, '[,()]')) AS noise FROM w)
SELECT doc_id, count(*) AS sentences, count(*) FILTER (noise) AS noise FROM m GROUP BY doc_id""")
def noise_sentences(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(T.is_noise_sentence(F.col("s"))).alias("noise"))


@query("sentence_facts")
def sentence_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of all sentences by category; the documents' prose is invented, so there are few."""
    s = load(spark, sf, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    s = s.withColumn("low", F.lower("s"))
    return s.select("doc_id", F.inline(T.sentence_facts(F.col("s"), F.col("low")))).groupBy("category", "value").agg(F.count("*").alias("facts"), F.countDistinct("doc_id").alias("papers"))


_LABELS_SQL = ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{v}' END" for k, v in L.CHARACTERIZATION)


@query("lexicon_labels", f"""SELECT doc_id, coalesce({_LABELS_SQL}) AS label FROM documents""")
def lexicon_labels(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", T.first_label(F.col("text"), L.CHARACTERIZATION).alias("label"))


@query("jaccard_relevance", """WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM benchmark),
d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
c AS (SELECT doc_id, item_id, count(*) AS c, any_value(n) AS n, any_value(m) AS m FROM (SELECT doc_id, len(w) AS n, unnest(w) AS x FROM d) JOIN (SELECT item_id, len(t) AS m, unnest(t) AS x FROM q) USING (x) GROUP BY doc_id, item_id),
b AS (SELECT doc_id, item_id, c / (n + m - c) AS jaccard FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c / (n + m - c) DESC, item_id) = 1)
SELECT doc_id, item_id, coalesce(jaccard, 0.0) AS jaccard FROM documents LEFT JOIN b USING (doc_id)""")
def jaccard_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """For each document the benchmark item with the most similar set of words."""
    terms = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return J.best_overlap(load(spark, sf, "documents"), "doc_id", terms, load(spark, sf, "benchmark"), "item_id", terms)


@query("relevance_scores", """WITH d AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS t, lower(text) AS a FROM documents),
s AS (SELECT doc_id, CASE WHEN contains(t, 'tion') THEN 1.0 WHEN contains(a, 'tion') THEN 0.8 ELSE 0.0 END AS m, CASE WHEN contains(a, 'license') THEN 1.0 WHEN contains(a, 'released') THEN 0.6 ELSE 0.0 END AS y,
least(1.0, 0.15 * least(3, CASE WHEN contains(t, 'the ') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'and ') THEN 1 ELSE 0 END) + 0.08 * least(5, CASE WHEN NOT contains(t, 'the ') AND contains(a, 'the ') THEN 1 ELSE 0 END + CASE WHEN NOT contains(t, 'and ') AND contains(a, 'and ') THEN 1 ELSE 0 END)) AS o FROM d)
SELECT doc_id, round(m * 0.4 + o * 0.25 + y * 0.2, 4) AS score FROM s WHERE m * 0.4 + o * 0.25 + y * 0.2 >= 0.12""")
def relevance_scores(spark: SparkSession, sf: str) -> DataFrame:
    title, text = F.substring_index("text", "\n", 1), F.col("text")
    scores = {"material": T.material_score(title, text, ["tion"]), "objective": T.objective_score(title, text, ["the ", "and "]), "synthesis": T.synthesis_score(text, ["license"], ["released"]), "characterization": F.lit(0.0), "application": F.lit(0.0)}
    return load(spark, sf, "documents").select("doc_id", T.final_score(scores).alias("score")).where(F.col("score") >= T.LEAST_SCORE)


@query("text_measures", r"""SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, CAST(length(text) // 4 AS BIGINT) AS tokens, TRY_CAST(nullif(regexp_extract(text, '\b((?:19|20)\d{2})\b', 1), '') AS INTEGER) AS year FROM documents""")
def text_measures(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"), T.token_estimate(F.col("text")).alias("tokens"), T.year(F.col("text")).alias("year"))


@query("plain_urls", r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_replace(trim(url), '[?#].*$', '') END AS url FROM pages""")
def plain_urls(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", T.plain_url(F.col("url")).alias("url"))


@query("paper_digests", """SELECT source, doc_id // 200 AS page, string_agg('Paper ' || doc_id || ': ' || substr(text, 1, 300), chr(10) ORDER BY doc_id) AS digest FROM documents GROUP BY ALL""")
def paper_digests(spark: SparkSession, sf: str) -> DataFrame:
    """All documents of each source with an abstract of 300 characters, in pages by ranges of ids, so a page is bounded whatever its source holds."""
    line = F.concat(F.lit("Paper "), F.col("doc_id").cast("string"), F.lit(": "), F.substring("text", 1, 300))
    rows = load(spark, sf, "documents").select("source", F.floor(F.col("doc_id") / 200).alias("page"), "doc_id", line.alias("l"))
    listed = F.array_sort(F.collect_list(F.struct("doc_id", "l")))
    return rows.groupBy("source", "page").agg(F.array_join(F.transform(listed, lambda x: x["l"]), "\n").alias("digest"))


@query("inverted_abstracts", """SELECT doc_id, array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), ' ') AS abstract FROM documents WHERE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) > 0""")
def inverted_abstracts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts rebuilt from maps of words to places."""
    w = load(spark, sf, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("p", "w"))
    index = w.groupBy("doc_id", "w").agg(F.collect_list("p").alias("places")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "places"))).alias("index"))
    return index.select("doc_id", T.from_inverted_index(F.col("index")).alias("abstract"))
