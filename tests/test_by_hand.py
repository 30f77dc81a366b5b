"""Functions over a few rows that are easy to read, beside what they must give."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import STAGES, violations
from scholia.functions import lexicons as L
from scholia.functions import papers as P
from scholia.functions import structured as S
from scholia.functions import text as T
from scholia.operators import graphs as G
from scholia.operators import joining as J
from scholia.sources import readers
from scholia.sources import readers as R
from tests.conftest import rows_of, rows_of_sql

CASES: dict[str, tuple] = {}


def query(name: str, sql: str):
    return lambda f: CASES.setdefault(name, (f, sql))


@query("next_stages", """SELECT * FROM (VALUES ('S1', 'S2'), ('S2_75', 'S3'), ('S5_5', 'complete'), ('S9', NULL), (NULL, 'S1')) t(stage, next)""")
def next_stages(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("S1",), ("S2_75",), ("S5_5",), ("S9",), (None,)], "stage STRING")
    return rows.withColumn("next", G.next_stage(F.col("stage"), STAGES))


@query("schema_drift", """WITH e(name, kind) AS (VALUES ('Title', 'title'), ('Year', 'number'), ('Tags', 'multi_select')), f(name, kind) AS (VALUES ('title', 'title'), ('year', 'text'), ('Owner', 'people'))
SELECT coalesce(lower(e.name), lower(f.name)) AS name, CASE WHEN f.kind IS NULL THEN 'missing' WHEN e.kind IS NULL THEN 'unexpected' ELSE 'changed' END AS status FROM e FULL JOIN f ON lower(e.name) = lower(f.name) WHERE e.kind IS DISTINCT FROM f.kind""")
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.createDataFrame([("Title", "title"), ("Year", "number"), ("Tags", "multi_select")], "name STRING, kind STRING")
    f = spark.createDataFrame([("title", "title"), ("year", "text"), ("Owner", "people")], "name STRING, kind STRING")
    return J.schema_drift(e, f, "name", "kind")


@query("resolve_fields", """SELECT * FROM (VALUES ('dopant', 'Dopant material'), ('2', 'Temperature'), ('the temperature value', 'Temperature'), ('unknown', NULL)) t(word, field)""")
def resolve_fields(spark: SparkSession, sf: str) -> DataFrame:
    fields = spark.createDataFrame([("dopant", "Dopant material", 1), ("temp", "Temperature", 2)], "alias STRING, name STRING, place INT")
    asked = spark.createDataFrame([("dopant",), ("2",), ("the temperature value",), ("unknown",)], "word STRING")
    return J.resolve_field(asked, fields, "word", "alias", "name", "place")


@query("constraint_violations", """WITH w(id, current_stage, status) AS (VALUES (1, 'S1', 'created'), (2, NULL, 'running'), (3, 'S9', 'running'), (4, 'S2', 'flying')) SELECT CAST(id AS BIGINT) AS id, CASE WHEN current_stage = 'S9' THEN 'current_stage' ELSE 'status' END AS violated FROM w WHERE current_stage = 'S9' OR status = 'flying'""")
def constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    from scholia.catalog import violations

    rows = spark.createDataFrame([(1, "S1", "created"), (2, None, "running"), (3, "S9", "running"), (4, "S2", "flying")], "id BIGINT, current_stage STRING, status STRING")
    return violations(rows, "workflow").select("id", F.array_join("violated", ",").alias("violated"))


@query("percent_columns", """SELECT "column", total, coalesce(total BETWEEN 90 AND 110, false) AS is_percent FROM (VALUES ('Zn', CAST(100.0 AS DOUBLE)), ('Se', 60.0)) t("column", total)""")
def percent_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("40", "20"), ("60", "40"), ("x", None)], "Zn STRING, Se STRING")
    return S.percent_columns(rows, ["Zn", "Se"])


@query("atom_feed", """SELECT * FROM (VALUES ('First', 'One', '1'), ('Second', 'Two', '2')) t(title, summary, id)""")
def atom_feed(spark: SparkSession, sf: str) -> DataFrame:
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>1</id><title>First</title><summary>One</summary></entry><entry><id>2</id><title>Second</title><summary>Two</summary></entry></feed>'
    return R.arxiv(spark.createDataFrame([(xml,)], "xml STRING"), "xml")


PW = """     calculation = 'scf'
     iteration #  1     ecut=    60.00 Ry
     total energy              =    -645.10000000 Ry
     highest occupied, lowest unoccupied level (ev):     6.4358    7.5358
!    total energy              =    -645.62919810 Ry
     convergence has been achieved in  11 iterations
     Forces acting on atoms (cartesian axes, Ry/au):
     atom    1 type  1   force =     0.00300000    0.00400000    0.00000000
     PWSCF        :   10m54.02s CPU   2m48.09s WALL
   JOB DONE.
"""


PH = """     q = (    0.000000000   0.000000000   0.000000000 )
     freq (    1) =      -0.512345 [THz] =     -17.09 [cm-1]
     freq (    2) = -582076.000000 [THz] =********** [cm-1]
     q = (    0.500000000   0.000000000   0.000000000 )
     freq (    1) =       5.996000 [THz] =     200.00 [cm-1]
"""


OUTPUTS = [(1, PW), (2, "Error in routine cdiaghg (3):"), (3, ""), (4, "stopping ..."), (5, "nothing")]


@query("pw_outputs", """SELECT * FROM (VALUES (CAST(1 AS BIGINT), true, -645.6291981, 6.4358, 1.1, 11, 0.005, 168.09), (2, false, NULL, NULL, NULL, NULL, NULL, NULL), (3, false, NULL, NULL, NULL, NULL, NULL, NULL), (4, false, NULL, NULL, NULL, NULL, NULL, NULL), (5, false, NULL, NULL, NULL, NULL, NULL, NULL))
t(job, converged, total_energy_ry, homo_ev, gap_ev, scf_iterations, max_force, wall_time_s)""")
def pw_outputs(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(OUTPUTS, "job BIGINT, text STRING").select("job", S.pw(F.col("text")).alias("p"))
    return rows.select("job", "p.converged", "p.total_energy_ry", "p.homo_ev", "p.gap_ev", "p.scf_iterations", F.round("p.max_force_ry_au", 6).alias("max_force"), "p.wall_time_s")


@query("job_success", """SELECT * FROM (VALUES (CAST(1 AS BIGINT), true, 'JOB DONE found'), (2, false, 'QE error: cdiaghg (3):'), (3, false, 'empty output'), (4, false, 'QE stopped abnormally'), (5, false, 'JOB DONE not found')) t(job, ok, reason)""")
def job_success(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(OUTPUTS, "job BIGINT, text STRING").select("job", S.success(F.col("text")).alias("s")).select("job", "s.*")


@query("phonon_modes", """SELECT * FROM (VALUES (CAST(0.0 AS DOUBLE), CAST(1 AS INTEGER), CAST(-17.09 AS DOUBLE), false), (0.0, 2, NULL, true), (0.5, 1, 200.0, false)) t(qx, mode, cm1, bad)""")
def phonon_modes(spark: SparkSession, sf: str) -> DataFrame:
    blocks = spark.createDataFrame([(PH,)], "text STRING").select(F.explode(S.phonons(F.col("text"))).alias("b"))
    return blocks.select(F.col("b.q")[0].alias("qx"), F.posexplode("b.modes").alias("i", "m")).select("qx", (F.col("i") + 1).alias("mode"), "m.cm1", "m.bad")


@query("detect_techniques", """SELECT * FROM (VALUES ('a.xrdml', 'XRD', 0.95), ('b.wdf', 'Raman', 1.0), ('c.txt', 'Uncertain', 0.25), ('d.bin', 'Unknown', 0.0)) t(file, technique, confidence)""")
def detect_techniques(spark: SparkSession, sf: str) -> DataFrame:
    files = spark.createDataFrame([("a.xrdml", "diffraction 2.0", 10.0, 80.0), ("b.wdf", "Raman shift laser", 100.0, 3000.0), ("c.txt", "", 0.0, 150.0), ("d.bin", "", None, None)], "file STRING, text STRING, low DOUBLE, high DOUBLE")
    scores = S.technique_scores(F.concat(F.lit("."), F.substring_index("file", ".", -1)), F.col("text"), F.col("low"), F.col("high"))
    return files.select("file", S.technique(scores).alias("t")).select("file", "t.*")


@query("reply_items", """SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'material', 'ZnSe'), (1, 'defect', 'vacancy [V]'), (3, 'material', 'CdTe')) t(id, category, value)""")
def reply_items(spark: SparkSession, sf: str) -> DataFrame:
    replies = [(1, 'Sure: [{"category": "Material", "value": " ZnSe "}, {"category": "defect", "value": "vacancy [V]"}, {"category": "colour", "value": "red"}] done'), (2, "no list [here"), (3, '```json\n[{"category": "material", "value": "CdTe"}]\n```')]
    rows = spark.createDataFrame(replies, "id BIGINT, text STRING")
    items = F.from_json(S.first_json_array(F.col("text")), "array<struct<category:string,value:string>>")
    return rows.select("id", F.inline(S.valid_items(items, ("material", "defect"))))


@query("section_names", """SELECT * FROM (VALUES ('i_introduction', 'introduction', false), ('growth_of_znse', 'synthesis', false), ('references', 'references', true), ('a_synthesis_and_more', 'synthesis', false), ('one_two_three_four_five_six_seven_eight_nine', 'preamble', false), ('theory', 'theory', false)) t(name, canonical, noise)""")
def section_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(n,) for n in ("i_introduction", "growth_of_znse", "references", "a_synthesis_and_more", "one_two_three_four_five_six_seven_eight_nine", "theory")], "name STRING")
    return rows.select("name", T.section_name(F.col("name")).alias("canonical"), T.is_noise_section(F.col("name")).alias("noise"))


@query("coerced_values", """SELECT * FROM (VALUES ('three', 3.0, NULL), ('1,250.5 kg', 1250.5, NULL), ('yes', NULL, true), ('off', NULL, false), ('none', NULL, NULL)) t(text, number, checkbox)""")
def coerced_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("three",), ("1,250.5 kg",), ("yes",), ("off",), ("none",)], "text STRING")
    return rows.select("text", T.to_number(F.col("text")).alias("number"), T.to_boolean(F.col("text")).alias("checkbox"))


@query("query_plans", """WITH m(x, m) AS (VALUES ('ZnSe', 1), ('MoS2', 2)), a(x, a) AS (VALUES ('CVD', 1), ('MBE', 2)), t(x, t) AS (VALUES ('photoluminescence', 1), ('defects', 2)),
q AS (SELECT 1 AS kind, m, a, t, m.x || ' ' || a.x || ' ' || t.x AS query FROM m, a, t UNION ALL SELECT 2, m, a, 0, m.x || ' ' || a.x FROM m, a UNION ALL SELECT 3, m, 0, t, m.x || ' ' || t.x FROM m, t)
SELECT row_number() OVER (ORDER BY kind, m, a, t) - 1 AS place, query FROM q QUALIFY place < 12""")
def query_plans(spark: SparkSession, sf: str) -> DataFrame:
    made = T.queries(["ZnSe", "MoS2"], ["CVD", "MBE"], ["photoluminescence", "defects"])
    return spark.createDataFrame(list(enumerate(made)), "place BIGINT, query STRING")


def _table(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


@query("themes", """SELECT * FROM (VALUES ('Fundamental ZnO work', 'ZnO Fundamentals', 1987), ('fundamental', 'ZnSe Fundamentals', NULL), ('A vs B', 'ZnSe vs ZnO Comparative', 2029), ('Band gap and optical', 'Bandgap Engineering', 2004),
('carrier life', 'Charge Transport', NULL), ('Post growth', 'Post-Deposition Treatments', NULL), ('research gap', 'Challenges & Research Gaps', NULL), ('other', 'ZnSe Fundamentals', NULL)) t(name, theme, year)""")
def themes(spark: SparkSession, sf: str) -> DataFrame:
    texts = {"Fundamental ZnO work": "in 1979, 1987 and 1990", "A vs B": "2030 12029 2029", "Band gap and optical": "(2004)"}
    names = ("Fundamental ZnO work", "fundamental", "A vs B", "Band gap and optical", "carrier life", "Post growth", "research gap", "other")
    rows = _table(spark, "name STRING, text STRING", *((n, texts.get(n, "none")) for n in names))
    return rows.select("name", P.theme(F.col("name")).alias("theme"), P.publication_year(F.col("text")).alias("year"))


@query("plan_steps", """SELECT * FROM (VALUES (CAST(1 AS BIGINT), NULL, '7', NULL), (2, 'missing: b', NULL, '9'), (3, 'disallowed tool: drop', NULL, NULL), (4, NULL, 'x', NULL)) t(step, fault, a, b)""")
def plan_steps(spark: SparkSession, sf: str) -> DataFrame:
    steps = _table(spark, "step BIGINT, tool STRING, params MAP<STRING, STRING>, skip BOOLEAN", (1, "one", {"a": "$id"}, False), (2, "two", {"a": "$none", "c": "x"}, None), (3, "drop", {}, False), (4, "two", {"a": "x"}, True))
    context = F.create_map(F.lit("id"), F.lit("7"))
    values = P.resolved(F.col("params"), context)
    listed = P.resolved_list(F.array(F.lit("$id"), F.lit("9")), F.create_map(F.lit("other"), F.lit("1")))
    return steps.select("step", P.step_fault(F.col("tool"), F.col("params"), F.col("skip"), {"one": ["a"], "two": ["a", "b"]}).alias("fault"), F.try_element_at(values, F.lit("a")).alias("a"), F.when(F.col("step") == 2, listed[1]).alias("b"))


@query("routes", """SELECT * FROM (VALUES ('XRD', 'XRD', NULL), ('Unknown', NULL, 'no technique above the threshold'), ('Uncertain', 'Raman', 'uncertain'), ('TEM', NULL, 'no parser for TEM')) t(technique, parser, error)""")
def routes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, "technique STRING, guess STRING", ("XRD", None), ("Unknown", "XRD"), ("Uncertain", "Raman"), ("TEM", "TEM"))
    return rows.select("technique", P.routed(F.col("technique"), F.col("guess"), tuple(S.TECHNIQUES)).alias("r")).select("technique", "r.*")


@query("best_sentences", r"""SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'We grew ZnSe films here. ZnSe was annealed.'), (2, ''), (3, 'ZnSe one.')) t(id, best)""")
def best_sentences(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, "id BIGINT, text STRING", (1, "We grew ZnSe films here. It rained. ZnSe was annealed. Then znse was measured at length."), (2, "Nothing of note. At all."), (3, "ZnSe one. The second sentence on ZnSe is far too long to fit into the budget."))
    return rows.select("id", T.best_sentences(F.col("text"), ("znse",), 45).alias("best"))


@query("quantities", """SELECT * FROM (VALUES ('300 nm', 300.0, 'nm'), ('about 2.5 at.% Co', 2.5, 'at.% Co'), ('12', 12.0, ''), ('none', NULL, NULL)) t(value, number, unit)""")
def quantities(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, "value STRING", ("300 nm",), ("about 2.5 at.% Co",), ("12",), ("none",)).select("value", T.quantity(F.col("value")).alias("q")).select("value", "q.number", "q.unit")


@query("valid_values", """SELECT * FROM (VALUES ('XRD', true), ('Zn', false), ('ZnSe', true), ('V_Se', true), ('thin film growth', false), ('grown film', true), ('300 nm', true), ('  ', false), (NULL, false)) t(value, valid)""")
def valid_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, "value STRING", *((v,) for v in ("XRD", "Zn", "ZnSe", "V_Se", "thin film growth", "grown film", "300 nm", "  ", None)))
    return rows.select("value", T.is_valid_value(F.col("value"), F.array(F.lit("grown"))).alias("valid"))


@query("valid_facts", """SELECT * FROM (VALUES ('material', 'ZnSe', true), ('material', 'not specified', false), ('material', 'ab12', false), ('optical_property', '2.7 eV', true), ('optical_property', 'blue', false), ('electrical_property', '5 ns', true),
('annealing_condition', '500 °C', true), ('annealing_condition', 'hot', false), ('doping_parameter', '3 at.%', true), ('defect_type', 'vacancy', true), ('defect_type', 'see table 2', false), ('other', 'x', true), ('other', ' ', false)) t(category, value, valid)""")
def valid_facts(spark: SparkSession, sf: str) -> DataFrame:
    cases = (("material", "ZnSe"), ("material", "not specified"), ("material", "ab12"), ("optical_property", "2.7 eV"), ("optical_property", "blue"), ("electrical_property", "5 ns"), ("annealing_condition", "500 °C"), ("annealing_condition", "hot"), ("doping_parameter", "3 at.%"), ("defect_type", "vacancy"), ("defect_type", "see table 2"), ("other", "x"), ("other", " "))
    return _table(spark, "category STRING, value STRING", *cases).select("category", "value", T.is_valid_fact(F.col("category"), F.col("value")).alias("valid"))


@query("parameter_values", """SELECT * FROM (VALUES ('annealing_condition', '500 °C'), ('optical_property', '2.70 eV'), ('optical_property', 'PL 460 nm'), ('electrical_property', '12 ns')) t(category, value)""")
def parameter_values(spark: SparkSession, sf: str) -> DataFrame:
    text = "Annealed at 500 °C. The band gap was 2.70 eV, with emission at 460 nm and a lifetime of 12 ns."
    return _table(spark, "text STRING", (text,)).select(F.inline(T.parameters(F.col("text"))))


@query("acronyms", f"""SELECT * FROM (VALUES ('{L.CHARACTERIZATION_ACRONYMS[0]}', 'characterization'), ('{L.SYNTHESIS_ACRONYMS[0]}', 'synthesis_method'), ('hello', NULL)) t(token, category)""")
def acronyms(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, "token STRING", (L.CHARACTERIZATION_ACRONYMS[0],), (L.SYNTHESIS_ACRONYMS[0],), ("hello",))
    return rows.select("token", T.acronym(F.col("token"))["category"].alias("category"))


@query("record_faults", """SELECT * FROM (VALUES (CAST(1 AS BIGINT), ''), (2, 'name: missing,score: not a number'), (3, 'score: out of bounds')) t(id, faults)""")
def record_faults(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, "id BIGINT, name STRING, score STRING", (1, "a", "5"), (2, " ", "many"), (3, "b", "11"))
    faults = T.record_faults({"name": "title", "score": "number"}, {"score": (0, 10)})
    return rows.select("id", F.array_join(faults, ",").alias("faults"))


@query("dates", """SELECT * FROM (VALUES ('2024-02-29', DATE '2024-02-29'), ('31/12/2023', DATE '2023-12-31'), ('12/31/2023', DATE '2023-12-31'), ('1-2-2020', DATE '2020-02-01'), ('20200131', DATE '2020-01-31'), ('today', DATE '2020-01-01'), ('Yesterday', DATE '2019-12-31'), ('tomorrow', DATE '2020-01-02'), ('soon', NULL)) t(text, date)""")
def dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, "text STRING", *((t,) for t in ("2024-02-29", "31/12/2023", "12/31/2023", "1-2-2020", "20200131", "today", "Yesterday", "tomorrow", "soon")))
    return rows.select("text", T.to_date(F.col("text"), F.to_date(F.lit("2020-01-01"))).alias("date"))


@query("reply_objects", r"""SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x', CAST(2 AS BIGINT)), (2, NULL, NULL), (3, 'a\q', 1)) t(id, a, b)""")
def reply_objects(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, "id BIGINT, text STRING", (1, '```json\n{"a": "x", "b": 2}\n```'), (2, "no object"), (3, r'so: {"a": "a\q", "b": 1}'))
    return rows.select("id", S.json_object(S.sanitize_escapes(F.col("text")), "a STRING, b BIGINT").alias("o")).select("id", "o.a", "o.b")


_DOS = "# E (eV)   dos(E)     Int dos(E) EFermi =    6.4 eV\n -5.000  0.1000E+00  0.2000E+00\n -4.990  0.3000E+00  0.5000E+00\n"


_BANDS = " &plot nbnd=   2, nks=     2 /\n   0.000000  0.000000  0.000000\n  -5.100    1.200\n   0.500000  0.000000  0.000000\n  -4.900    1.400\n"


_NEB = "image:  1   -10.5 eV\nimage:  2   -9.9 eV\nimage:  3   -10.4 eV\nactivation energy (->) = 0.6 (0.600 eV)\nneb: convergence achieved in 12 iterations\n"


@query("band_structures", """SELECT * FROM (VALUES (0.0, 1, -5.1), (0.0, 2, 1.2), (0.5, 1, -4.9), (0.5, 2, 1.4)) t(kx, band, energy)""")
def band_structures(spark: SparkSession, sf: str) -> DataFrame:
    points = _table(spark, "text STRING", (_BANDS,)).select(F.explode(S.bands(F.col("text"))["points"]).alias("p"))
    return points.select(F.col("p.k")[0].alias("kx"), F.posexplode("p.values").alias("i", "energy")).select("kx", (F.col("i") + 1).alias("band"), "energy")


@query("densities_of_states", """SELECT * FROM (VALUES (-5.0, 0.1, 0.2), (-4.99, 0.3, 0.5)) t(energy, dos, integral)""")
def densities_of_states(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, "text STRING", (_DOS,)).select(F.inline(S.dos(F.col("text")))).select("energy", "dos", F.col("partial")[0].alias("integral"))


@query("neb_paths", """SELECT true AS converged, 0.6 AS activation_ev, CAST(3 AS BIGINT) AS images, 0.1 AS reaction_ev""")
def neb_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, "text STRING", (_NEB,)).select(S.neb(F.col("text")).alias("n")).select("n.converged", "n.activation_ev", F.size("n.path").cast("long").alias("images"), "n.reaction_ev")


@query("section_keys", """SELECT * FROM (VALUES ('2.1 Results and Discussion', 'results_and_discussion'), ('  Methods (XRD)', 'methods_xrd'), ('3', '')) t(heading, key)""")
def section_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, "heading STRING", ("2.1 Results and Discussion",), ("  Methods (XRD)",), ("3",)).select("heading", T.section_key(F.col("heading")).alias("key"))


@query("pseudopotential_ranks", """SELECT * FROM (VALUES ('Zn', 'zn.pbe.us', 'zn.pbe.paw|zn.pz.us', false), ('Se', 'se.pbesol.us', '', false), ('O', NULL, NULL, true)) t(symbol, recommended, alternatives, missing)""")
def pseudopotential_ranks(spark: SparkSession, sf: str) -> DataFrame:
    files = _table(spark, "element STRING, functional STRING, type STRING, name STRING", ("Zn", "pz", "us", "zn.pz.us"), ("Zn", "pbe", "paw", "zn.pbe.paw"), ("Zn", "pbe", "us", "zn.pbe.us"), ("Se", "pbesol", "us", "se.pbesol.us"))
    ranked = readers.ranked_pseudopotentials(files, _table(spark, "symbol STRING", ("Zn",), ("Se",), ("O",)))
    return ranked.select("symbol", "recommended", F.array_join("alternatives", "|").alias("alternatives"), "missing")


@query("meshes", """SELECT * FROM (VALUES (CAST(1 AS BIGINT), '8,8,4'), (2, '2,2,2')) t(id, dense)""")
def meshes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, "id BIGINT, mesh ARRAY<INT>", (1, [4, 4, 2]), (2, [1, 1, 1]))
    return rows.select("id", F.array_join(S.dense_mesh(F.col("mesh")).cast("array<string>"), ",").alias("dense"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_by_hand(spark, duck, name):
    function, sql = CASES[name]
    df = function(spark, "")
    columns, expected = rows_of_sql(duck, sql)
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


def test_intents_by_hand(spark):
    from scholia.functions import intents as I

    lines = ["Create database please", "add a log, then create database", "Yes.", "that's right", "I know", "no thanks", "update it", "in the background", "run now", "the second", "option 4", "énoé", "", None]
    text = F.col("t")
    rows = spark.createDataFrame([(t,) for t in lines], "t STRING").select(I.command(text).alias("c")).select("c.*")
    assert [tuple(r) for r in rows.collect()] == [("1", "menu"), ("2", "menu"), ("yes", "yes"), ("yes", "yes"), ("unknown", None), ("cancel", "cancel"), ("edit", "edit"), ("2", "mode"), ("3", "mode"), ("2", "number"), ("4", "digit"), ("unknown", None), ("unknown", None), ("unknown", None)]
    lines = ["Score is seven, I think", "score: 7,5", "the twelve. of 3", "none", "score of 3 or 4", None]
    rows = spark.createDataFrame([(t,) for t in lines], "t STRING").select(I.number(text, "score").alias("n")).select("n.*")
    assert [tuple(r) for r in rows.collect()] == [(7.0, "anchored"), (7.5, "anchored"), (12.0, "first"), (None, None), (3.0, "anchored"), (None, None)]
    lines = ["not done", "done yes", "it is done", "done is not so", "undone", None]
    rows = spark.createDataFrame([(t,) for t in lines], "t STRING").select(I.boolean(text, "done"))
    assert [r[0] for r in rows.collect()] == [False, True, True, False, None, None]
    lines = ["Skip.", "next one please now", "move on to the next field", "leave it blank", "nothing", None]
    rows = spark.createDataFrame([(t,) for t in lines], "t STRING").select(I.skips(text))
    assert [r[0] for r in rows.collect()] == [True, True, False, True, False, False]
