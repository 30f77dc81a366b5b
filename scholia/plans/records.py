"""Structured outputs, replies and records, written from the test tables' rows as texts and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import STAGES, load, violations
from scholia.functions import lexicons as L
from scholia.functions import papers as P
from scholia.functions import structured as S
from scholia.functions import text as T
from scholia.operators import graphs as G
from scholia.operators import joining as J
from scholia.registry import query
from scholia.sources import readers as R


def pick(number: Column, *values: str | None) -> Column:
    """The value whose place is the number modulo their count."""
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.pmod(number, F.lit(len(values))).cast("int"))


def _pick(number: str, *values: str | None) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{quoted}], CAST({number} % {len(values)} AS INTEGER) + 1)"


_STAGES = (*STAGES, "S9", None)
_NEXT = (*STAGES[1:], "complete", None, STAGES[0])


@query("next_stages", f"""SELECT o_orderkey, {_pick("o_orderkey", *_STAGES)} AS stage, {_pick("o_orderkey", *_NEXT)} AS next FROM orders""")
def next_stages(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", pick(F.col("o_orderkey"), *_STAGES).alias("stage")).withColumn("next", G.next_stage(F.col("stage"), STAGES))


_STATUSES = ("created", "running", "flying", None, "failed")


@query("constraint_violations", f"""WITH w AS (SELECT o_orderkey AS id, {_pick("o_orderkey", *_STAGES)} AS stage, {_pick("o_custkey", *_STATUSES)} AS status FROM orders)
SELECT id, concat_ws(',', CASE WHEN stage = 'S9' THEN 'current_stage' END, CASE WHEN status IS NULL OR status = 'flying' THEN 'status' END) AS violated FROM w WHERE stage IS NOT DISTINCT FROM 'S9' OR status IS NULL OR status = 'flying'""")
def constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), pick(F.col("o_orderkey"), *_STAGES).alias("current_stage"), pick(F.col("o_custkey"), *_STATUSES).alias("status"))
    return violations(rows, "workflow").select("id", F.array_join("violated", ",").alias("violated"))


@query("schema_drift", """WITH e AS (SELECT lower(c_name) AS n, c_mktsegment AS k FROM customer WHERE c_custkey % 5 <> 0), f AS (SELECT lower(c_name) AS n, CASE WHEN c_custkey % 3 = 0 THEN 'text' ELSE c_mktsegment END AS k FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(e.n, f.n) AS name, CASE WHEN f.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' ELSE 'changed' END AS status FROM e FULL JOIN f ON e.n = f.n WHERE e.k IS DISTINCT FROM f.k""")
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    expected = c.where("c_custkey % 5 <> 0").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    found = c.where("c_custkey % 7 <> 0").select(F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "text").otherwise(F.col("c_mktsegment")).alias("kind"))
    return J.schema_drift(expected, found, "name", "kind")


@query("resolve_fields", """WITH f AS (SELECT 'n' || n_nationkey AS a, lower(n_name) AS l, n_name, n_nationkey AS o FROM nation),
w AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'N' || c_nationkey WHEN 1 THEN CAST(c_nationkey AS VARCHAR) WHEN 2 THEN 'the ' || n_name || ' field' ELSE c_name END AS word FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT word, CASE WHEN lower(word) = a THEN 0 WHEN word = CAST(o AS VARCHAR) THEN 1 WHEN contains(lower(word), l) OR contains(l, lower(word)) THEN 2 END AS r, o, n_name FROM w, f)
SELECT word, arg_min(n_name, r * 1000 + o) FILTER (r IS NOT NULL) AS field FROM h GROUP BY word""")
def resolve_fields(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("place"))
    c = load(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("place"))
    k = F.col("c_custkey") % 4
    word = F.when(k == 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).when(k == 1, F.col("c_nationkey").cast("string")).when(k == 2, F.concat(F.lit("the "), F.col("name"), F.lit(" field"))).otherwise(F.col("c_name"))
    return J.resolve_field(c.select(word.alias("word")), n, "word", "alias", "name", "place")


@query("percent_columns", """WITH t AS (SELECT CAST(count(*) FILTER (c_custkey < 100) AS DOUBLE) AS low, CAST(sum(c_custkey % 2) AS DOUBLE) AS half FROM customer)
SELECT 'low' AS "column", low AS total, low BETWEEN 90 AND 110 AS is_percent FROM t UNION ALL SELECT 'half', half, half BETWEEN 90 AND 110 FROM t UNION ALL SELECT 'name', NULL, false""")
def percent_columns(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = load(spark, sf, "customer").select(F.when(k < 100, "1").otherwise("0").alias("low"), (k % 2).cast("string").alias("half"), F.col("c_name").alias("name"))
    return S.percent_columns(rows, ["low", "half", "name"])


@query("atom_feed", """SELECT coalesce(lang, '-') AS title, md5(coalesce(text, '')) AS summary, CAST(doc_id AS VARCHAR) AS id FROM documents""")
def atom_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds of up to 50 documents each, with a namespace, and their entries read back."""
    entry = F.concat(F.lit("<entry><id>"), F.col("doc_id").cast("string"), F.lit("</id><title>"), F.coalesce("lang", F.lit("-")), F.lit("</title><summary>"), F.md5(F.coalesce("text", F.lit(""))), F.lit("</summary></entry>"))
    feeds = load(spark, sf, "documents").select(F.floor(F.col("doc_id") / 50).alias("page"), entry.alias("e")).groupBy("page").agg(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join(F.collect_list("e"), ""), F.lit("</feed>")).alias("xml"))
    return R.arxiv(feeds, "xml")


# Outputs of simulations


def _line(format: str, *columns: Column) -> Column:
    return F.format_string(format, *columns)


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    """An output text for each order: of runs that end well, converge without an end, fail, stop, are empty or say nothing."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    k = (o % 7 + 1).cast("double") / 1000
    run = F.concat(
        F.lit("     calculation = 'scf'\n     iteration #  1     ecut=    60.00 Ry\n     total energy              =    -1.50000000 Ry\n"),
        _line("     highest occupied, lowest unoccupied level (ev):  %9.4f %9.4f\n", (c % 1000).cast("double") / 100, (c % 1000 + o % 300).cast("double") / 100),
        _line("!    total energy              =    %.8f Ry\n", -F.col("o_totalprice")),
        _line("     convergence has been achieved in %3d iterations\n", c % 50 + 1),
        _line("     Forces acting on atoms (cartesian axes, Ry/au):\n     atom    1 type  1   force =     %.8f    %.8f    0.00000000\n", k * 3, k * 4),
        F.when(o % 6 == 3, _line("     PWSCF        :   10m54.02s CPU   %dm%d.00s WALL\n   JOB DONE.\n", o % 60, c % 59 + 1)).otherwise(F.lit("")),
    )
    text = F.when(o % 6 == 0, _line("Error in routine cdiaghg (%d):", c)).when(o % 6 == 1, F.lit("")).when(o % 6 == 2, F.lit("stopping ...")).when(o % 6 == 4, F.lit("nothing")).otherwise(run)
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), text.alias("text"))


@query("pw_outputs", """SELECT o_orderkey AS job, o_orderkey % 6 IN (3, 5) AS converged, CASE WHEN o_orderkey % 6 IN (3, 5) THEN -o_totalprice END AS total_energy_ry, CASE WHEN o_orderkey % 6 IN (3, 5) THEN (o_custkey % 1000) / 100.0 END AS homo_ev,
CASE WHEN o_orderkey % 6 IN (3, 5) THEN (o_orderkey % 300) / 100.0 END AS gap_ev, CASE WHEN o_orderkey % 6 IN (3, 5) THEN CAST(o_custkey % 50 + 1 AS INTEGER) END AS scf_iterations, CASE WHEN o_orderkey % 6 IN (3, 5) THEN (o_orderkey % 7 + 1) * 5 / 1000.0 END AS max_force,
CASE WHEN o_orderkey % 6 = 3 THEN CAST((o_orderkey % 60) * 60 + o_custkey % 59 + 1 AS DOUBLE) END AS wall_time_s FROM orders""")
def pw_outputs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _outputs(spark, sf).select("job", S.pw(F.col("text")).alias("p"))
    return rows.select("job", "p.converged", "p.total_energy_ry", "p.homo_ev", F.round("p.gap_ev", 4).alias("gap_ev"), "p.scf_iterations", F.round("p.max_force_ry_au", 6).alias("max_force"), "p.wall_time_s")


@query("job_success", """SELECT o_orderkey AS job, o_orderkey % 6 IN (3, 5) AS ok, CASE o_orderkey % 6 WHEN 0 THEN 'QE error: cdiaghg (' || o_custkey || '):' WHEN 1 THEN 'empty output' WHEN 2 THEN 'QE stopped abnormally' WHEN 3 THEN 'JOB DONE found' WHEN 4 THEN 'JOB DONE not found' ELSE 'SCF converged' END AS reason FROM orders""")
def job_success(spark: SparkSession, sf: str) -> DataFrame:
    return _outputs(spark, sf).select("job", S.success(F.col("text")).alias("s")).select("job", "s.*")


_ITEM = """SELECT l_orderkey, l_linenumber / 8.0 AS qx, l_quantity AS a, l_discount AS b FROM lineitem"""


@query("phonon_modes", f"""WITH i AS ({_ITEM}) SELECT l_orderkey, qx, 1 AS mode, -a AS cm1, false AS bad FROM i UNION ALL SELECT l_orderkey, qx, 2, CASE WHEN a <= 40 THEN a + 0.5 END, a > 40 FROM i UNION ALL SELECT l_orderkey, 0.0, 1, a, false FROM i""")
def phonon_modes(spark: SparkSession, sf: str) -> DataFrame:
    a, qx = F.col("l_quantity"), F.col("l_linenumber") / 8.0
    stars = F.when(a > 40, F.lit("**********")).otherwise(_line("%10.2f", a + 0.5))
    text = F.concat(
        _line("     q = (  %.9f   0.000000000   0.000000000 )\n     freq (    1) =  %.6f [THz] =  %.2f [cm-1]\n", qx, -a / 33, -a), _line("     freq (    2) = %.6f [THz] =%s [cm-1]\n", a / 33, stars),
        _line("     q = (    0.000000000   0.000000000   0.000000000 )\n     freq (    1) =       1.000000 [THz] =  %.2f [cm-1]\n", a),
    )
    blocks = load(spark, sf, "lineitem").select("l_orderkey", F.explode(S.phonons(text)).alias("b"))
    return blocks.select("l_orderkey", F.col("b.q")[0].alias("qx"), F.posexplode("b.modes").alias("i", "m")).select("l_orderkey", "qx", (F.col("i") + 1).alias("mode"), "m.cm1", "m.bad")


@query("band_structures", f"""WITH i AS ({_ITEM}) SELECT l_orderkey, 0.0 AS kx, 1 AS band, -a AS energy FROM i UNION ALL SELECT l_orderkey, 0.0, 2, b FROM i UNION ALL SELECT l_orderkey, qx, 1, -a - 1 FROM i UNION ALL SELECT l_orderkey, qx, 2, b + 1 FROM i""")
def band_structures(spark: SparkSession, sf: str) -> DataFrame:
    a, b, qx = F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber") / 8.0
    text = _line(" &plot nbnd=   2, nks=     2 /\n   0.000000  0.000000  0.000000\n  %.3f    %.3f\n   %.6f  0.000000  0.000000\n  %.3f    %.3f\n", -a, b, qx, -a - 1, b + 1)
    points = load(spark, sf, "lineitem").select("l_orderkey", F.explode(S.bands(text)["points"]).alias("p"))
    return points.select("l_orderkey", F.col("p.k")[0].alias("kx"), F.posexplode("p.values").alias("i", "energy")).select("l_orderkey", "kx", (F.col("i") + 1).alias("band"), "energy")


@query("densities_of_states", f"""WITH i AS ({_ITEM}) SELECT l_orderkey, -a AS energy, b AS dos, qx AS integral FROM i UNION ALL SELECT l_orderkey, a, qx, NULL FROM i""")
def densities_of_states(spark: SparkSession, sf: str) -> DataFrame:
    a, b, qx = F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber") / 8.0
    text = _line("# E (eV)   dos(E)     Int dos(E) EFermi =    6.4 eV\n %.3f  %.4E  %.4E\n   %.3f  %.4E\n\n", -a, b, qx, a, qx)
    return load(spark, sf, "lineitem").select("l_orderkey", F.inline(S.dos(text))).select("l_orderkey", "energy", "dos", F.get("partial", F.lit(0)).alias("integral"))


@query("neb_paths", """SELECT o_orderkey, o_orderkey % 2 = 0 AS converged, CASE WHEN o_orderkey % 3 > 0 THEN (o_custkey % 90) / 100.0 END AS activation_ev, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 3 END AS images, CASE WHEN o_orderkey % 4 > 0 THEN round((o_custkey % 90) / 100.0, 6) END AS reaction_ev FROM orders""")
def neb_paths(spark: SparkSession, sf: str) -> DataFrame:
    o, e = F.col("o_orderkey"), (F.col("o_custkey") % 90).cast("double") / 100
    text = F.concat(F.lit("image:  1   -10.00 eV\n"), F.when(o % 4 > 0, _line("image:  2   -9.90 eV\nimage:  3   %.2f eV\n", e - 10)).otherwise(F.lit("")), F.when(o % 3 > 0, _line("activation energy (->) = 0.6 (%.2f eV)\n", e)).otherwise(F.lit("")), F.when(o % 2 == 0, F.lit("neb: convergence achieved in 12 iterations\n")).otherwise(F.lit("")))
    return load(spark, sf, "orders").select("o_orderkey", S.neb(text).alias("n")).select("o_orderkey", "n.converged", "n.activation_ev", F.size("n.path").alias("images"), "n.reaction_ev")


@query("meshes", """SELECT l_orderkey, l_linenumber * 2 || ',' || CAST(l_quantity AS INTEGER) * 2 || ',2' AS dense FROM lineitem""")
def meshes(spark: SparkSession, sf: str) -> DataFrame:
    mesh = F.array(F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.lit(1))
    return load(spark, sf, "lineitem").select("l_orderkey", F.array_join(S.dense_mesh(mesh).cast("array<string>"), ",").alias("dense"))


_ELEMENTS, _FUNCTIONALS, _TYPES, _SPECIES = ("Zn", "Se", "O", "Ga", "Cd"), ("pz", "pbe", "pbesol"), ("us", "paw"), ("zn", "Se", "Xx", "O", "CD", "Yy")


@query("pseudopotential_ranks", f"""WITH f AS (SELECT lower({_pick("s_suppkey", *_ELEMENTS)}) AS e, {_pick("s_suppkey // 5", *_FUNCTIONALS)} AS functional, {_pick("s_suppkey // 3", *_TYPES)} AS type, s_name AS name FROM supplier),
r AS (SELECT e, name, row_number() OVER (PARTITION BY e ORDER BY functional <> 'pbe', type <> 'us', name) AS r FROM f), s AS (SELECT DISTINCT {_pick("p_partkey", *_SPECIES)} AS symbol FROM part)
SELECT symbol, max(name) FILTER (r = 1) AS recommended, string_agg(name, '|' ORDER BY r) FILTER (r BETWEEN 2 AND 5) AS alternatives, count(name) = 0 AS missing FROM s LEFT JOIN r ON lower(symbol) = e GROUP BY symbol""")
def pseudopotential_ranks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    files = load(spark, sf, "supplier").select(pick(k, *_ELEMENTS).alias("element"), pick(F.floor(k / 5), *_FUNCTIONALS).alias("functional"), pick(F.floor(k / 3), *_TYPES).alias("type"), F.col("s_name").alias("name"))
    species = load(spark, sf, "part").select(pick(F.col("p_partkey"), *_SPECIES).alias("symbol")).distinct()
    ranked = R.ranked_pseudopotentials(files, species)
    return ranked.select("symbol", "recommended", F.nullif(F.array_join("alternatives", "|"), F.lit("")).alias("alternatives"), "missing")


# Replies, plans and routes


@query("reply_items", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'material' ELSE 'defect' END AS category, CASE WHEN doc_id % 4 = 0 THEN coalesce(lang, '') || ' [' || coalesce(source, '') || ']' ELSE coalesce(source, '') END AS value FROM documents WHERE doc_id % 4 IN (0, 1) AND (doc_id % 4 = 0 OR trim(coalesce(source, '')) <> '')""")
def reply_items(spark: SparkSession, sf: str) -> DataFrame:
    """Lists in replies, with brackets in their strings, other categories, fences, and replies without a list."""
    k, lang, source = F.col("doc_id") % 4, F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    item = lambda category, value: F.struct(F.lit(category).alias("category"), value.alias("value"))
    material = F.to_json(F.array(item(" Material", F.concat(F.lit(" "), lang, F.lit(" ["), source, F.lit("]"))), item("colour", lang), item("defect", F.lit("  "))))
    text = F.when(k == 0, F.concat(F.lit("Sure [1]ly: [ "), material, F.lit(" done"))).when(k == 1, F.concat(F.lit("```json\n"), F.to_json(F.array(item("defect", source))), F.lit("\n```"))).when(k == 2, F.lit("no list [here")).otherwise(F.lit(None))
    text = F.when(k == 0, F.concat(F.lit("Sure: "), material, F.lit(" done"))).otherwise(text)
    items = F.from_json(S.first_json_array(text), "array<struct<category:string,value:string>>")
    return load(spark, sf, "documents").select("doc_id", F.inline(S.valid_items(items, ("material", "defect"))))


@query("reply_objects", r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN coalesce(lang, '') WHEN 2 THEN 'a\q' || coalesce(lang, '') END AS a, CASE WHEN doc_id % 3 <> 1 THEN doc_id END AS b FROM documents""")
def reply_objects(spark: SparkSession, sf: str) -> DataFrame:
    k, lang, number = F.col("doc_id") % 3, F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit('```json\n{"a": "'), lang, F.lit('", "b": '), number, F.lit("}\n```"))).when(k == 1, F.lit("no object")).otherwise(F.concat(F.lit(r'so: {"a": "a\q'), lang, F.lit('", "b": '), number, F.lit("}")))
    return load(spark, sf, "documents").select("doc_id", S.json_object(S.sanitize_escapes(text), "a STRING, b BIGINT").alias("o")).select("doc_id", "o.a", "o.b")


_TOOLS = ("one", "two", "drop")


@query("plan_steps", f"""WITH s AS (SELECT o_orderkey AS step, o_custkey, {_pick("o_orderkey", *_TOOLS)} AS tool, CASE o_orderkey % 4 WHEN 0 THEN '$id' WHEN 1 THEN '$none' WHEN 2 THEN 'x' END AS a, CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderkey % 5 = 0 END AS skip FROM orders)
SELECT step, CASE WHEN tool = 'drop' THEN 'disallowed tool: drop' WHEN coalesce(skip, false) THEN NULL WHEN tool = 'one' AND a IS NULL THEN 'missing: a' WHEN tool = 'two' AND a IS NULL THEN 'missing: a, b' WHEN tool = 'two' THEN 'missing: b' END AS fault,
CASE a WHEN '$id' THEN CAST(o_custkey AS VARCHAR) WHEN '$none' THEN NULL ELSE a END AS a, CAST(step AS VARCHAR) AS listed FROM s""")
def plan_steps(spark: SparkSession, sf: str) -> DataFrame:
    k, own = F.col("o_orderkey"), F.create_map(F.lit("c"), F.lit("x"))
    a = pick(k, "$id", "$none", "x", None)
    params = F.when(a.isNull(), own).otherwise(F.map_concat(own, F.create_map(F.lit("a"), F.coalesce(a, F.lit("")))))
    skip = F.when(k % 5 == 1, F.lit(None).cast("boolean")).otherwise(k % 5 == 0)
    steps = load(spark, sf, "orders").select(k.alias("step"), F.col("o_custkey").cast("string").alias("id"), pick(k, *_TOOLS).alias("tool"), params.alias("params"), skip.alias("skip"))
    values = P.resolved(F.col("params"), F.create_map(F.lit("id"), F.col("id")))
    listed = P.resolved_list(F.array(F.lit("$id"), F.lit("$step")), F.create_map(F.lit("step"), F.col("step").cast("string")))
    return steps.select("step", P.step_fault(F.col("tool"), F.col("params"), F.col("skip"), {"one": ["a"], "two": ["a", "b"]}).alias("fault"), F.try_element_at(values, F.lit("a")).alias("a"), listed[1].alias("listed"))


_DETECTED, _GUESSED = (*S.TECHNIQUES, "Unknown", "Uncertain", "TEM"), (*S.TECHNIQUES, "TEM", None)
_PARSERS = ", ".join(f"'{t}'" for t in S.TECHNIQUES)


@query("routes", f"""WITH d AS (SELECT o_orderkey, {_pick("o_orderkey", *_DETECTED)} AS t, {_pick("o_custkey", *_GUESSED)} AS g FROM orders), e AS (SELECT *, CASE WHEN t = 'Uncertain' THEN g ELSE t END AS x FROM d),
p AS (SELECT *, CASE WHEN x IN ({_PARSERS}) THEN x END AS parser FROM e) SELECT o_orderkey, parser, CASE WHEN t = 'Unknown' THEN 'no technique above the threshold' WHEN parser IS NULL THEN 'no parser for ' || coalesce(x, '') WHEN t = 'Uncertain' THEN 'uncertain' END AS error FROM p""")
def routes(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select("o_orderkey", pick(F.col("o_orderkey"), *_DETECTED).alias("t"), pick(F.col("o_custkey"), *_GUESSED).alias("g"))
    return rows.select("o_orderkey", P.routed(F.col("t"), F.col("g"), tuple(S.TECHNIQUES)).alias("r")).select("o_orderkey", "r.*")


_EXTENSIONS = (".xrdml", ".wdf", ".xy", ".SP", ".emsa", ".txt", ".spx")


def _score(t: dict) -> str:
    parts = [f"CASE WHEN lower(e) = '{e}' THEN {s} ELSE 0 END" for e, s in t["extensions"].items()]
    parts += [f"CASE WHEN contains(w, '{w}') THEN {s} ELSE 0 END" for ws, s in ((t["strong"], 0.2), (t["weak"], 0.05)) for w in ws]
    return f"round(least(1.0, {' + '.join(parts)} + CASE WHEN low >= {t['axis'][0]} AND high <= {t['axis'][1]} THEN 0.25 ELSE 0 END), 4)"


@query("detect_techniques", f"""WITH d AS (SELECT doc_id, {_pick("doc_id", *_EXTENSIONS)} AS e, lower(coalesce(text, '')) AS w, CAST(doc_id % 400 AS DOUBLE) AS low, CAST(doc_id % 400 + n_chars % 3000 AS DOUBLE) AS high FROM documents),
s AS (SELECT doc_id, [{", ".join(_score(t) for t in S.TECHNIQUES.values())}] AS s FROM d), b AS (SELECT doc_id, s, list_max(s) AS m FROM s)
SELECT doc_id, CASE WHEN m >= 0.6 THEN list_extract([{_PARSERS}], list_position(s, m)) WHEN m > 0 THEN 'Uncertain' ELSE 'Unknown' END AS technique, CAST(m AS DOUBLE) AS confidence FROM b""")
def detect_techniques(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as texts of instrument files, with an extension and an axis of their own."""
    k = F.col("doc_id")
    low = (k % 400).cast("double")
    scores = S.technique_scores(pick(k, *_EXTENSIONS), F.col("text"), low, low + (F.col("n_chars") % 3000).cast("double"))
    return load(spark, sf, "documents").select("doc_id", S.technique(scores).alias("t")).select("doc_id", "t.*")


_UNITS = ("nm", "°C", "celsius", "at.%", "")
_UNIT_OF = dict(L.UNITS)  # where none follows, the number's fraction is what stands behind its digits


@query("quantities", f"""SELECT l_orderkey, CASE WHEN l_partkey % 6 <> 5 THEN l_quantity + 0.5 END AS number, CASE WHEN l_partkey % 6 <> 5 THEN {_pick("l_suppkey", *(_UNIT_OF.get(u.lower(), u) or ".5" for u in _UNITS))} END AS unit FROM lineitem""")
def quantities(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("l_partkey") % 6 == 5, F.lit("none")).otherwise(F.concat(F.lit("about "), _line("%.1f", F.col("l_quantity") + 0.5), F.lit(" "), pick(F.col("l_suppkey"), *_UNITS)))
    return load(spark, sf, "lineitem").select("l_orderkey", T.quantity(value).alias("q")).select("l_orderkey", "q.number", "q.unit")


@query("coerced_values", f"""SELECT l_orderkey, CASE l_partkey % 5 WHEN 0 THEN CAST(l_quantity % 13 AS DOUBLE) WHEN 1 THEN CAST(l_suppkey * 1000 AS DOUBLE) END AS number, CASE l_partkey % 5 WHEN 2 THEN true WHEN 3 THEN false END AS checkbox,
CASE l_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN len(string_split(format('{{:,}}', l_suppkey * 1000), ',')) WHEN 4 THEN 3 ELSE 1 END AS parts FROM lineitem""")
def coerced_values(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_partkey") % 5
    text = F.when(k == 0, F.concat(F.lit("it is "), pick(F.col("l_quantity").cast("long"), *T._NUMBER_WORDS))).when(k == 1, F.concat(F.format_number(F.col("l_suppkey") * 1000, 0), F.lit(" kg"))).when(k == 2, F.lit(" Yes")).when(k == 3, F.lit("off")).otherwise(F.lit("red, green and blue"))
    return load(spark, sf, "lineitem").select("l_orderkey", T.to_number(text).alias("number"), T.to_boolean(text).alias("checkbox"), F.size(T.to_list(text)).alias("parts"))


@query("parameter_values", """WITH o AS (SELECT o_orderkey, 300 + o_custkey % 500 AS n, printf('%.2f', (100 + o_orderkey % 300) / 100.0) AS x, 400 + o_custkey % 500 AS m, o_orderkey % 50 + 1 AS t FROM orders)
SELECT o_orderkey, 'annealing_condition' AS category, n || ' °C' AS value FROM o UNION ALL SELECT o_orderkey, 'optical_property', x || ' eV' FROM o UNION ALL SELECT o_orderkey, 'optical_property', 'PL ' || m || ' nm' FROM o UNION ALL SELECT o_orderkey, 'electrical_property', t || ' ns' FROM o""")
def parameter_values(spark: SparkSession, sf: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    text = _line("Annealed at %d °C. The band gap was %.2f eV, with emission at %d nm and a lifetime of %d ns.", 300 + c % 500, (100 + o % 300).cast("double") / 100, 400 + c % 500, o % 50 + 1)
    return load(spark, sf, "orders").select("o_orderkey", F.inline(T.parameters(text)))


@query("record_faults", """SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 11 = 0 THEN 'name: missing' END, CASE WHEN c_custkey % 3 = 1 THEN 'score: not a number' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 20 > 10 THEN 'score: out of bounds' END) AS faults FROM customer""")
def record_faults(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = load(spark, sf, "customer").select(k, F.when(k % 11 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("name"), F.when(k % 3 == 0, (k % 20).cast("string")).when(k % 3 == 1, F.lit("many")).alias("score"))
    return rows.select("c_custkey", F.array_join(T.record_faults({"name": "title", "score": "number"}, {"score": (0, 10)}), ",").alias("faults"))


@query("dates", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END WHEN 3 THEN d WHEN 4 THEN d WHEN 5 THEN DATE '2020-01-01' WHEN 6 THEN DATE '2019-12-31' END AS date FROM o""")
def dates(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates in several notations; month before day is read so only where it can't be the other way round."""
    k, d = F.col("o_orderkey") % 8, F.col("o_orderdate")
    text = F.when(k == 5, F.lit("today")).when(k == 6, F.lit(" Yesterday")).when(k == 7, F.lit("soon"))
    for n, f in enumerate(("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "d-M-yyyy", "yyyyMMdd")):
        text = text.when(k == n, F.date_format(d, f))
    return load(spark, sf, "orders").select("o_orderkey", T.to_date(text, F.to_date(F.lit("2020-01-01"))).alias("date"))


@query("query_plans", """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS m, [p_type] AS a, [p_brand, upper(split_part(p_name, ' ', 1)), p_type] AS t FROM part),
q AS (SELECT p_partkey, 1 AS kind, i, 1 AS j, k, m[i] || ' ' || a[1] || ' ' || t[k] AS query FROM p, range(1, 3) x(i), range(1, 4) y(k) UNION ALL SELECT p_partkey, 2, i, 1, 0, m[i] || ' ' || a[1] FROM p, range(1, 3) x(i) UNION ALL SELECT p_partkey, 3, i, 0, k, m[i] || ' ' || t[k] FROM p, range(1, 3) x(i), range(1, 4) y(k)),
g AS (SELECT * FROM q WHERE len(list_distinct(string_split(lower(query), ' '))) = len(string_split(query, ' ')) QUALIFY row_number() OVER (PARTITION BY p_partkey, lower(query) ORDER BY kind, i, j, k) = 1)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY kind, i, j, k) - 1 AS place, query FROM g QUALIFY place < 6""")
def query_plans(spark: SparkSession, sf: str) -> DataFrame:
    name = F.split("p_name", " ")
    made = T.query_plan(name, F.array("p_type"), F.array(F.col("p_brand"), F.upper(name[0]), F.col("p_type")), 6)
    return load(spark, sf, "part").select("p_partkey", F.posexplode(made).alias("place", "query"))
