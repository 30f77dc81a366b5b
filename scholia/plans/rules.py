"""Text rules over the words, headings and sentences of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.functions import intents as I
from scholia.functions import lexicons as L
from scholia.functions import papers as P
from scholia.functions import text as T
from scholia.plans.records import _pick, pick
from scholia.registry import query


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _theme_sql(name: str) -> str:
    def holds(words: tuple[str, ...]) -> str:
        return " AND ".join(f"contains({name}, '{w}')" for w in words)

    cases = " ".join(f"WHEN {' OR '.join(f'({holds(w)})' for w in alternatives)} THEN '{label}'" for label, *alternatives in P.THEMES)
    return f"CASE {cases} ELSE '{P.THEME_DEFAULT}' END"


@query("themes", rf"""SELECT doc_id, {_theme_sql("lower(text)")} AS theme, TRY_CAST(nullif(regexp_extract(text, '\b(19[89]\d|20[012]\d)\b', 1), '') AS INTEGER) AS year FROM documents""")
def themes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", P.theme(F.col("text")).alias("theme"), P.publication_year(F.col("text")).alias("year"))


@query("section_keys", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(split_part(text, chr(10), 1))), '^[\d.\s]+', ''), '[^a-z0-9\s]', '', 'g'), '\s+', '_', 'g') AS key FROM documents""")
def section_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The first lines of documents as keys of sections."""
    return load(spark, sf, "documents").select("doc_id", T.section_key(F.substring_index("text", "\n", 1)).alias("key"))


_NAMES = tuple(dict.fromkeys([*(k for k, _ in L.SECTION_NAMES), *(f"{k}of_things" for k, _ in L.SECTION_PREFIXES), *(f"on_{k}_again" for k, _ in L.SECTION_PARTS), *L.NOISE_SECTIONS, *(f"{p}x" for p in L.NOISE_PREFIXES), *(f"x{s}" for s in L.NOISE_SUFFIXES), "theory", "one_two_three_four_five_six_seven_eight_nine"]))
_SECTION_SQL = "CASE " + " ".join([*(f"WHEN name = '{k}' THEN '{v}'" for k, v in L.SECTION_NAMES), *(f"WHEN starts_with(name, '{k}') THEN '{v}'" for k, v in L.SECTION_PREFIXES), *(f"WHEN contains(name, '{k}') THEN '{v}'" for k, v in L.SECTION_PARTS)]) + f" WHEN len(string_split(name, '_')) > 8 AND NOT list_has_any(string_split(name, '_'), [{_quoted(L.SECTION_WORDS)}]) THEN 'preamble' ELSE name END"
_NOISE_SECTION_SQL = " OR ".join([f"name IN ({_quoted(L.NOISE_SECTIONS)})", *(f"starts_with(name, '{p}')" for p in L.NOISE_PREFIXES), *(f"ends_with(name, '{s}')" for s in L.NOISE_SUFFIXES)])


@query("section_names", f"""WITH n AS (SELECT l_orderkey, {_pick("l_partkey", *_NAMES)} || CASE WHEN l_suppkey % 3 = 0 THEN '_' || l_linenumber ELSE '' END AS name FROM lineitem) SELECT l_orderkey, name, {_SECTION_SQL} AS canonical, {_NOISE_SECTION_SQL} AS noise FROM n""")
def section_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of sections as they stand in headings, some with a number behind."""
    name = F.concat(pick(F.col("l_partkey"), *_NAMES), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("_"), F.col("l_linenumber").cast("string"))).otherwise(F.lit("")))
    return load(spark, sf, "lineitem").select("l_orderkey", name.alias("name")).select("l_orderkey", "name", T.section_name(F.col("name")).alias("canonical"), T.is_noise_section(F.col("name")).alias("noise"))


_BUDGET, _KEYWORDS = 400, ("the ", "und ")


@query("best_sentences", rf"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 0 AND ({" OR ".join(f"contains(lower(s), '{k}')" for k in _KEYWORDS)})) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_reduce(s, lambda a, x: CASE WHEN length(CASE WHEN a = '' THEN x ELSE a || ' ' || x END) <= {_BUDGET} THEN CASE WHEN a = '' THEN x ELSE a || ' ' || x END ELSE a END, '') AS best FROM s""")
def best_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.best_sentences(F.col("text"), _KEYWORDS, _BUDGET).alias("best"))


_TERMS = ("the", "license", "und")


@query("valid_values", rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS value FROM documents)
SELECT value, length(value) BETWEEN 3 AND 120 AND lower(value) NOT IN ({_quoted(L.VALUE_BLOCKLIST)}) AND (regexp_matches(value, '^[A-Z]{{3,5}}$') OR regexp_matches(value, '^[A-Za-z]{{1,3}}_[A-Za-z]{{1,3}}$') OR list_has_any(list_transform(regexp_extract_all(value, '\w+'), lambda x: lower(x)), [{_quoted(_TERMS)}])
  OR (regexp_matches(value, '(?:[A-Z][a-z]?\d*){{2,}}') AND regexp_matches(value, '[a-z]|\d')) OR regexp_matches(value, '\d')) AS valid FROM w""")
def valid_values(spark: SparkSession, sf: str) -> DataFrame:
    """All different words of the documents as values of facts."""
    words = load(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("value")).distinct()
    return words.select("value", T.is_valid_value(F.col("value"), F.array(*map(F.lit, _TERMS))).alias("valid"))


_CATEGORIES = ("material", "optical_property", "electrical_property", "annealing_condition", "doping_parameter", "defect_type", "other")
_FORMS = ("%d nm", "%d.5 eV", "%d ns", "%d °C", "%d at.%%", "see table %d", "Zn%d", "not specified", " ", "quantum dot", "XPS spectra %d", "ZnSeTe123", "might be %d K", "%d cm⁻¹", "fesm")


def _valid_sql() -> str:
    label = f"lower(v) IN ({_quoted(L.TECHNIQUE_LABELS)})"
    begins = " OR ".join(f"starts_with(lower(v), '{t}')" for t in L.TECHNIQUE_LABELS)
    matches = lambda of, pattern: f"regexp_matches({of}, '{pattern}')"
    short = f"({matches('v', '^[A-Za-z]{2,4}\\d{1,3}$')} AND length(v) <= 7 AND NOT {matches('v', '[a-z][A-Z]')})"
    material = f"length(v) <= 40 AND lower(v) NOT IN ({_quoted([*L.GARBLED_MATERIALS, *L.GENERIC_MATERIALS])}) AND NOT {short} AND NOT {matches('v', '^(?:[A-Z][a-z]?\\d{0,2}){2,6}\\d{3}$')} AND NOT {matches('lower(v)', T.NO_MATERIAL)}"
    of = {
        "material": material, "optical_property": f"NOT {label} AND NOT ({begins}) AND {matches('plain', T.OPTICAL)}", "electrical_property": f"NOT {label} AND {matches('plain', T.ELECTRICAL)}",
        "annealing_condition": f"{matches('plain', T.ANNEALING)} AND length(v) <= 80 AND NOT {matches('lower(v)', T.NO_ANNEALING)}", "doping_parameter": matches("plain", T.DOPING), "defect_type": f"length(v) <= 60 AND NOT {matches('lower(v)', T.NO_DEFECT)}",
    }
    return "v <> '' AND CASE category " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in of.items()) + " ELSE true END"


@query("valid_facts", f"""WITH f AS (SELECT p_partkey, {_pick("p_partkey", *_CATEGORIES)} AS category, trim(replace(replace({_pick("p_partkey // 7", *_FORMS)}, '%d', CAST(p_size AS VARCHAR)), '%%', '%')) AS v FROM part), g AS (SELECT *, translate(v, '⁰¹²³⁴⁵⁶⁷⁸⁹⁻', '0123456789-') AS plain FROM f)
SELECT p_partkey, category, v AS value, {_valid_sql()} AS valid FROM g""")
def valid_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's size as a value of a fact, in many forms, fit for its category or not."""
    k = F.col("p_partkey")
    value = F.replace(F.replace(pick(F.floor(k / 7), *_FORMS), F.lit("%d"), F.col("p_size").cast("string")), F.lit("%%"), F.lit("%"))
    rows = load(spark, sf, "part").select("p_partkey", pick(k, *_CATEGORIES).alias("category"), F.trim(value).alias("value"))
    return rows.select("*", T.is_valid_fact(F.col("category"), F.col("value")).alias("valid"))


_TOKENS = tuple(dict.fromkeys([*L.CHARACTERIZATION_ACRONYMS, *L.SYNTHESIS_ACRONYMS, *(a for a, _ in L.RENAMED_ACRONYMS), *(f"x-{s}" for s in L.SYNTHESIS_SUFFIXES), *L.SYNTHESIS_SUFFIXES, "fe-sem", "hr_tem", "hello"]))
_RENAMED = f"list_extract([{_quoted(b for _, b in L.RENAMED_ACRONYMS)}], list_position([{_quoted(a for a, _ in L.RENAMED_ACRONYMS)}], t))"


@query("acronyms", rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_-]+')) AS token FROM documents UNION SELECT DISTINCT {_pick("p_partkey", *_TOKENS)} FROM part),
u AS (SELECT token, regexp_replace(upper(token), '[-_]', '', 'g') AS t FROM w), l AS (SELECT *, coalesce({_RENAMED}, t) AS label FROM u),
c AS (SELECT token, label, CASE WHEN t IN ({_quoted(L.CHARACTERIZATION_ACRONYMS)}) THEN 'characterization' WHEN t IN ({_quoted(L.SYNTHESIS_ACRONYMS)}) THEN 'synthesis_method' WHEN {" OR ".join(f"(ends_with(t, '{s}') AND length(t) > {len(s)})" for s in L.SYNTHESIS_SUFFIXES)} THEN 'suffix' END AS c FROM l)
SELECT token, CASE WHEN c = 'suffix' THEN 'synthesis_method' ELSE c END AS category, CASE WHEN c = 'suffix' THEN token ELSE label END AS label FROM c WHERE c IS NOT NULL""")
def acronyms(spark: SparkSession, sf: str) -> DataFrame:
    """The acronyms of methods among all different words of the documents and the names that parts are given."""
    words = load(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_-]+"), F.lit(0))).alias("token"))
    named = load(spark, sf, "part").select(pick(F.col("p_partkey"), *_TOKENS).alias("token"))
    rows = words.unionByName(named).distinct().select("token", T.acronym(F.col("token")).alias("a"))
    return rows.where("a IS NOT NULL").select("token", "a.category", "a.label")


def _sql_string(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_RULES = " ".join(f"WHEN regexp_matches(low, {_sql_string(I.pattern(kind, words))}) THEN {n}" for n, (_, kind, words, _) in enumerate(I.COMMANDS))
_WORD_NUMBER = f"coalesce(list_extract([{_quoted(map(str, I.NUMBERS.values()))}], list_position([{_quoted(I.NUMBERS)}], regexp_replace(w, '[.,!?;:]+$', ''))) || regexp_extract(w, '[.,!?;:]+$'), w)"


@query("intents", f"""WITH c AS (SELECT conv_id, turn, role, lower(text) AS low FROM conversations WHERE text IS NOT NULL),
d AS (SELECT *, CASE {_RULES} END AS n, array_to_string(list_transform(string_split(trim(regexp_replace(low, '{I.BLANKS}+', ' ', 'g')), ' '), lambda w: {_WORD_NUMBER}), ' ') AS plain FROM c),
e AS (SELECT *, nullif(regexp_extract(plain, '{I.anchored("is")}', 1), '') AS by_name, nullif(regexp_extract(plain, '{I.FIRST}', 1), '') AS alone FROM d)
SELECT conv_id, turn, role, coalesce(list_extract([{_quoted(r[3] for r in I.COMMANDS)}], n + 1), 'unknown') AS command, list_extract([{_quoted(r[0] for r in I.COMMANDS)}], n + 1) AS rule, CAST(coalesce(replace(by_name, ',', '.'), alone) AS DOUBLE) AS number,
CASE WHEN by_name IS NOT NULL THEN 'anchored' WHEN alone IS NOT NULL THEN 'first' END AS number_rule, CASE WHEN regexp_matches(low, {_sql_string(I.negated("is"))}) THEN false WHEN regexp_matches(low, {_sql_string(I.pattern("word", ("is",)))}) THEN true END AS named,
regexp_matches(regexp_replace(regexp_replace(low, '^{I.BLANKS}+|{I.BLANKS}+$', '', 'g'), '[.,!?]+$', ''), {_sql_string(I.skip_pattern())}) AS skipped FROM e""")
def intents(spark: SparkSession, sf: str) -> DataFrame:
    """What each turn asks for, and which rule says so; the field is one that invented prose names."""
    text = F.col("text")
    rows = load(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "role", I.command(text).alias("c"), I.number(text, "is").alias("n"), I.boolean(text, "is").alias("named"), I.skips(text).alias("skipped"))
    return rows.select("conv_id", "turn", "role", "c.command", "c.rule", F.col("n.value").alias("number"), F.col("n.rule").alias("number_rule"), "named", "skipped")
