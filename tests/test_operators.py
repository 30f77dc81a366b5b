"""Operators on small literal tables: ties, nulls, empty tables, sequences."""

from __future__ import annotations

import json
import os
import random
import re
import time
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.catalog import SCHEMAS, empty, violations
from scholia.functions import structured as S
from scholia.functions import text as T
from scholia.operators import aggregates as A
from scholia.operators import cooccurrence as C
from scholia.operators import graphs as G
from scholia.operators import joining as J
from scholia.operators import merging as M
from scholia.operators import ranking as R
from scholia.operators import statistics as ST
from scholia.operators import vectors as V
from scholia.sources import readers, writers
from scholia.streaming import streams


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_schemas_are_read(spark):
    for name in SCHEMAS:
        assert empty(spark, name).count() == 0


def test_violations_of_rules_and_parents(spark):
    stages = spark.createDataFrame([(1, 7, "S1"), (2, 8, "S9"), (3, None, "S2")], "id BIGINT, workflow_id BIGINT, stage_name STRING")
    workflows = spark.createDataFrame([(7,)], "id BIGINT")
    found = {r["id"]: r["violated"] for r in violations(stages, "stage", {"workflow": workflows}).collect()}
    assert found == {2: ["stage_name", "unknown workflow"], 3: ["unknown workflow"]}
    attempts = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id BIGINT, attempt_number INT")
    assert sorted(r["id"] for r in violations(attempts, "execution_attempt").collect()) == [1, 3]


def test_token_batches_start_anew(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 3, 9), ("a", 4, 30), ("a", 5, 1), ("b", 1, 3), (None, 1, None)], "g STRING, i INT, t INT")
    got = {(r["g"], r["i"]): r["batch"] for r in A.token_batches(rows, "g", "i", "t", 10).collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("a", 3): 2, ("a", 4): 3, ("a", 5): 4, ("b", 1): 1, (None, 1): 1}


def test_merged_sections_keep_order_and_limit(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "k INT, i INT, t STRING")
    assert A.merged_sections(rows, ["k"], "i", "t", 3).first()["content"] == "a\n\n"


def test_round_robin_is_fair(spark):
    rows = spark.createDataFrame([("c", s, 10 * s + i) for s in range(3) for i in range(s * 5 + 1)], "cat STRING, src INT, i INT")
    got = R.balanced_sample(rows, "cat", "src", "i", 7).orderBy("place").collect()
    assert [(r["src"], r["turn"]) for r in got] == [(0, 1), (1, 1), (2, 1), (1, 2), (2, 2), (1, 3), (2, 3)]


def test_ties_give_null(spark):
    rows = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (2, "a", 3), (2, "b", 1)], "k INT, l STRING, s INT")
    assert {r["k"]: r["l"] for r in R.argmax_or_null(rows, "k", "l", "s").collect()} == {1: None, 2: "a"}


def test_pages_cover_all_rows_once(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    cursor, seen = None, []
    while True:
        got = R.page(rows, "k", cursor, 4).orderBy("k").collect()
        seen += [r["k"] for r in got]
        if not got or not got[0]["more"]:
            break
        cursor = got[-1]["k"]
    assert seen == list(range(10))


def test_gaps_partition_the_matrix(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (1, "x")], "p INT, a STRING")
    right = spark.createDataFrame([(1, "u"), (3, "v")], "p INT, b STRING")
    got = {(r["a"], r["b"]): (r["papers"], r["kind"], r["nearest"]) for r in C.find_gaps(left, right, "p", "a", "b", 0).collect()}
    assert got == {("x", "v"): (0, "unexplored", "y"), ("y", "u"): (0, "unexplored", "x"), ("y", "v"): (0, "unexplored", "x")}


def test_shared_and_unique_values(spark):
    rows = spark.createDataFrame([("w1", "a"), ("w2", "a"), ("w1", "b"), ("w2", None), (None, "c")], "w STRING, v STRING")
    got = {(r["kind"], r["workflow"], r["value"]) for r in C.workflow_comparison(rows, "w", "v").collect()}
    assert got == {("shared", None, "a"), ("unique", "w1", "b")}


def test_lookup_prefers_the_first_key(spark):
    known = spark.createDataFrame([(1, "d1", "One"), (2, None, "two "), (3, "d3", "One")], "id INT, doi STRING, title STRING")
    rows = spark.createDataFrame([("d3", "One"), (None, " ONE"), ("dx", "TWO"), (None, None)], "doi STRING, title STRING")
    got = [(r["doi"], r["title"], r["match"]) for r in J.lookup_or(rows, known, "doi", "title", "id").collect()]
    assert sorted(got, key=repr) == sorted([("d3", "One", 3), (None, " ONE", 1), ("dx", "TWO", 2), (None, None, None)], key=repr)


def test_fuzzy_keep_first_equals_the_sequence(spark):
    titles = ["alpha beta gamma delta", "alpha beta gamma delto", "other words here", "alpha beta gamma delta!", "Other words here"]
    rows = spark.createDataFrame(list(enumerate(titles)), "i INT, t STRING")
    kept: list[str] = []
    for t in titles:
        if not any(SequenceMatcher(None, t.lower(), k).ratio() > 0.9 for k in kept):
            kept.append(t.lower())
    got = J.fuzzy_keep_first(rows, F.lit("one"), "i", "t").orderBy("i").collect()
    assert [r["t"].lower() for r in got] == kept


def test_upsert_is_idempotent_and_null_safe(spark):
    present = spark.createDataFrame([(1, 1, "a"), (None, 1, "n")], "k INT, o INT, v STRING")
    change = spark.createDataFrame([(1, 2, None), (2, 1, "b"), (None, 5, "m")], "k INT, o INT, v STRING")
    once = M.upsert(present, change, ["k"], "o", keep_old=["v"])
    twice = M.upsert(once, change, ["k"], "o", keep_old=["v"])
    want = {(1, 2, "a"), (2, 1, "b"), (None, 5, "m")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_updates_of_other_columns_are_refused(spark):
    rows = spark.createDataFrame([(1, "a")], "k INT, v STRING")
    with pytest.raises(ValueError):
        M.update(rows, rows, "k", ["v"], {"w"})


def test_constant_columns_have_no_correlation(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.5, 5.0)], "a DOUBLE, b DOUBLE, c DOUBLE")
    got = ST.correlations(rows, ["a", "b", "c"]).collect()
    assert [(r["field_a"], r["field_b"], r["strength"]) for r in got] == [("a", "b", "strong positive")]
    assert ST.correlations(rows.limit(2), ["a", "b"]).count() == 0
    assert ST.numeric_stats(rows.limit(1), ["c"]).first()["stdev"] == 0.0
    assert ST.numeric_stats(rows.limit(0), ["c"]).first()["count"] == 0


def test_short_series_have_no_trend(spark):
    rows = spark.createDataFrame([("s", i, 1.0) for i in range(3)] + [("u", i, float(i)) for i in range(4)] + [("d", i, -float(i)) for i in range(5)] + [("c", i, 2.0) for i in range(4)], "k STRING, i INT, v DOUBLE")
    got = {r["k"]: r["trend"] for r in ST.trend(rows, "k", "i", "v").collect()}
    assert got == {"s": "insufficient data", "u": "increasing", "d": "decreasing", "c": "stable"}


def test_nearest_vectors_with_ties_and_nulls(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (4, None), (5, [9.0])], "id INT, e ARRAY<FLOAT>")
    got = [(r["id"], r["distance"]) for r in V.top_k(v, v.where("id = 2"), "id", "e", 2).orderBy("rank").collect()]
    assert got == [(2, 0.0), (1, 1.0)]


def test_nearest_vectors_over_many_blocks(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, [float(r.randint(0, 3)) for _ in range(3 if i % 7 else 2)]) for i in range(300)] + [(300 + i, [0.0, 1.0, 2.0]) for i in range(9)]
    v = spark.createDataFrame(rows, "id INT, e ARRAY<FLOAT>").repartition(5)
    want = {}
    for q, a in rows:
        if q % 20 == 0:
            near = sorted((sum((x - y) ** 2 for x, y in zip(a, b)), i) for i, b in rows if len(a) == len(b))[:7]
            want |= {(q, n + 1): (i, d) for n, (d, i) in enumerate(near)}
    for limit in (V.SMALL_BYTES, 0):  # broadcast, and dealt out in pairs of partitions
        monkeypatch.setattr(V, "SMALL_BYTES", limit)
        got = V.top_k(v, v.where("id % 20 = 0"), "id", "e", 7, block=4, chunk=16).collect()
        assert {(r["query"], r["rank"]): (r["id"], r["distance"]) for r in got} == want
    assert V.top_k(v.limit(0), v, "id", "e", 2).count() == 0 == V.top_k(v, v.limit(0), "id", "e", 2).count()


def test_levels_of_a_deep_chain_and_of_nothing(spark):
    nodes = spark.createDataFrame([(i, [i - 1] if i else []) for i in range(25)], "n INT, d ARRAY<INT>")
    assert {r["n"]: r["level"] for r in G.levels(nodes, "n", "d").collect()} == {i: i + 1 for i in range(25)}
    assert G.levels(nodes.limit(0), "n", "d").count() == 0


def test_names_in_texts_by_either_route(spark, monkeypatch):
    names = spark.createDataFrame([("Brand#11", 3), ("Brand#1", 9), ("zinc", 1), ("", 20)], "n STRING, o INT")
    rows = spark.createDataFrame([(1, "see BRAND#11 here"), (2, "brand#1"), (3, "ZINC oxide brand#11"), (4, ""), (5, "zin"), (6, None)], "k INT, t STRING")
    for many in (J.MANY, 0):
        monkeypatch.setattr(J, "MANY", many)
        assert {r["k"]: r["n"] for r in J.first_containing(rows, "t", names, "n", "o", 8).collect()} == {1: "Brand#11", 2: "Brand#1", 3: "zinc", 4: "", 5: "", 6: None}


def test_best_overlaps(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["x"]), (3, []), (4, ["b", "c"])], "k INT, w ARRAY<STRING>")
    items = spark.createDataFrame([(7, ["a", "b", "c"]), (6, ["b", "c", "a"]), (9, ["c"])], "i INT, w ARRAY<STRING>")
    got = {r["k"]: (r["i"], r["jaccard"]) for r in J.best_overlap(docs, "k", F.col("w"), items, "i", F.col("w")).collect()}
    assert got == {1: (6, 2 / 3), 2: (None, 0.0), 3: (None, 0.0), 4: (6, 2 / 3)}


def test_sums_by_status_over_no_rows_are_null(spark, tmp_path):
    from scholia.plans.aggregates import section_status

    spark.createDataFrame([], "o_orderstatus STRING").write.parquet(f"{tmp_path}/orders.parquet")
    assert tuple(section_status(spark, str(tmp_path)).first()) == (None, None)


def slow_levels(depends):
    out = {}
    while True:
        new = {n: 1 + max((out[d] for d in ds), default=0) for n, ds in depends.items() if n not in out and all(d in out for d in ds)}
        if not new:
            return out
        out |= new


def test_paths_double(spark):
    """A chain of 10,000 takes the rounds of its logarithm, and so does a tree."""
    chain = spark.range(10_000).select("id", F.expr("CASE WHEN id = 0 THEN array() ELSE array(id - 1) END").alias("d"))
    found, rounds = G.levels_and_rounds(chain, "id", "d")
    assert rounds < 20 and found.where("level <> id + 1").count() == 0 and found.count() == 10_000
    tree = spark.range(1, 128).select("id", F.expr("CASE WHEN id = 1 THEN array() ELSE array(id div 2) END").alias("d"))
    found, rounds = G.levels_and_rounds(tree, "id", "d")
    assert rounds < 7 and found.where("level <> length(bin(id))").count() == 0


@pytest.mark.parametrize("seed", [1, 3])
def test_levels_of_any_graph(spark, seed):
    """With shared and missing dependencies, nulls, repeats and cycles of several lengths."""
    r = random.Random(seed)
    depends = {n: [r.choice([*range(max(0, n - 6), n), *([r.randint(0, 45)] if r.random() < 0.1 * seed else [])]) for _ in range(r.choice([0, 1, 1, 2, 3]) if n else 0)] for n in range(40)}
    rows = [(n, ds + ([None] if n == 33 else [])) for n, ds in depends.items()]
    got = {x["n"]: x["level"] for x in G.levels(spark.createDataFrame(rows, "n BIGINT, d ARRAY<BIGINT>"), "n", "d").collect()}
    depends[33] = [-1]
    assert got == slow_levels(depends)


def test_levels_leave_cycles_out(spark):
    nodes = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["a", "b"]), ("x", ["y"]), ("y", ["x"]), ("m", ["missing"])], "n STRING, d ARRAY<STRING>")
    assert {r["n"]: r["level"] for r in G.levels(nodes, "n", "d").collect()} == {"a": 1, "b": 2, "c": 3}


def test_missing_dependencies_block_unless_lenient(spark):
    nodes = spark.createDataFrame([("a", "approved", []), ("b", "pending", ["a"]), ("c", "pending", ["gone"]), ("d", "pending", None)], "n STRING, s STRING, d ARRAY<STRING>")
    assert {r["n"] for r in G.ready(nodes, "n", "s", "d").collect()} == {"b", "d"}
    assert {r["n"] for r in G.ready(nodes, "n", "s", "d", strict=False).collect()} == {"b", "c", "d"}


def reference_chunks(t: str, size: int, overlap: int, snap: int) -> list[str]:
    out, start = [], 0
    while start < len(t):
        end = min(start + size, len(t))
        if end < len(t) and (dot := t.rfind(". ", end - snap, end)) >= 0:
            end = dot + 1
        out.append(t[start:end].strip() if end < len(t) else t[start:end])
        if end == len(t):
            break
        start = end - overlap
    return [c for c in out if c.strip()]


def test_chunks_overlap(spark):
    t = "".join(f"Sentence number {i} is here. " for i in range(60))
    assert one(spark, T.chunks(F.col("t"), 200, 20, 60), t=t) == reference_chunks(t, 200, 20, 60)
    rows = spark.createDataFrame([(None,), ("",), ("short",)], "t STRING").select(T.chunks(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in rows] == [[], [], ["short"]]


def test_parameters_and_facts(spark):
    s = "Samples were annealed at 450 °C and the band gap of 2.70 eV was found by x-ray diffraction after chemical vapor deposition."
    got = {(r["category"], r["value"]) for r in one(spark, T.sentence_facts(F.col("s")), s=s)}
    assert got == {("annealing_condition", "450 °C"), ("optical_property", "2.70 eV"), ("characterization", "XRD"), ("synthesis_method", "CVD")}
    assert one(spark, T.sentence_facts(F.col("s")), s="Copyright 2020, all rights reserved, annealed at 450 °C") == []


@pytest.mark.parametrize(("category", "value", "good"), [("material", "ZnSe", True), ("material", "thin film", False), ("material", "CuCrS258", False), ("optical_property", "2.7 eV", True), ("optical_property", "wide", False), ("electrical_property", "10 ns", True), ("annealing_condition", "450 °C", True), ("annealing_condition", "hot", False), ("doping_parameter", "5 at.%", True), ("defect_type", "see table 3", False), ("other", "anything", True), ("material", " ", False)])
def test_fit_values(spark, category, value, good):
    assert one(spark, T.is_valid_fact(F.col("c"), F.col("v")), c=category, v=value) is good


def test_quantities_and_coercion(spark):
    q = one(spark, T.quantity(F.col("v")), v="about 450 deg C")
    assert (q["number"], q["unit"]) == (450.0, "°C")
    assert str(one(spark, T.to_date(F.col("v")), v="31/12/2024")) == "2024-12-31"
    assert str(one(spark, T.to_date(F.col("v")), v="12/31/2024")) == "2024-12-31"
    assert one(spark, T.to_list(F.col("v")), v="a, b and c;") == ["a", "b", "c"]
    assert one(spark, T.acronym(F.col("v")), v="FE-SEM")["label"] == "FE-SEM"
    assert one(spark, T.acronym(F.col("v")), v="XYCVD")["category"] == "synthesis_method"
    assert one(spark, T.acronym(F.col("v")), v="QQQ") is None


def test_faulty_records(spark):
    rows = spark.createDataFrame([("t", "5", "yes"), ("", "x", "maybe"), ("t", "99", None)], "name STRING, score STRING, done STRING")
    got = [r["f"] for r in rows.select(T.record_faults({"name": "title", "score": "number", "done": "checkbox"}, {"score": (1, 10)}).alias("f")).collect()]
    assert got == [[], ["name: missing", "score: not a number", "done: not a checkbox"], ["score: out of bounds"]]


def test_inferred_fields_have_one_title():
    fields = T.infer_fields("title, due date, hours spent and tags")
    assert [(f["name"], f["type"]) for f in fields] == [("Name", "title"), ("Due Date", "date"), ("Hours Spent", "number"), ("Tags", "multi_select")]


def test_latex_and_best_sentences(spark):
    assert one(spark, T.latex(F.col("t")), t=r"a_b & 5% \x") == r"a\_b \& 5\% \textbackslash{}x"
    assert one(spark, T.best_sentences(F.col("t"), ("gap",), 30), t="No. The gap is wide. The gap is here and long enough to drop. Gap!") == "The gap is wide. Gap!"


def test_bands_and_dos_files(spark):
    b = one(spark, S.bands(F.col("t")), t=" &plot nbnd=   2, nks=   2 /\n  0.000000  0.000000  0.000000\n  1.5000  -2.5000\n  0.500000  0.000000  0.000000\n  3.0000  4.0000\n")
    assert (b["nbnd"], b["nks"], [p["values"] for p in b["points"]]) == (2, 2, [[1.5, -2.5], [3.0, 4.0]])
    d = one(spark, S.dos(F.col("t")), t="# header\n 1.0 2.0 0.5 0.25\n\n-1.5 0.0\nbad line\n")
    assert [(r["energy"], r["dos"], r["partial"]) for r in d] == [(1.0, 2.0, [0.5, 0.25]), (-1.5, 0.0, [])]


def test_json_in_replies(spark):
    assert one(spark, S.first_json_array(F.col("t")), t='x [1, "]", [2]] y [3]') == '[1, "]", [2]]'
    assert one(spark, S.first_json_array(F.col("t")), t="[ no") is None
    assert one(spark, S.json_object(F.col("t"), "a INT")["a"], t='```json\n{"a": 3}\n```') == 3
    assert json.loads(one(spark, S.sanitize_escapes(F.col("t")), t=r'{"a": "\alpha \n"}'))["a"] == "\\alpha \n"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), max_size=20))
def test_keep_first_is_idempotent(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i INT, a INT, b INT")
    once = R.keep_first(rows, [F.col("a")], [F.asc("b"), F.asc("i")])
    again = R.keep_first(once, [F.col("a")], [F.asc("b"), F.asc("i")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))
    assert once.count() == len({a for a, _ in pairs})


def test_files(spark, tmp_path):
    writers.append_jsonl(spark.createDataFrame([(1, "a")], "i INT, t STRING"), str(tmp_path / "log"))
    writers.append_jsonl(spark.createDataFrame([(2, "b")], "i INT, t STRING"), str(tmp_path / "log"))
    assert {r["i"] for r in readers.jsonl(spark, str(tmp_path / "log"), "i INT, t STRING").collect()} == {1, 2}
    (tmp_path / "scan.xy").write_text("# head\nname value\n1.0, 2.0\n3.5\t4.0\n; end\n5 6 7\n")
    assert sorted((r["x"], r["y"]) for r in readers.ascii_table(spark, str(tmp_path / "scan.xy")).collect()) == [(1.0, 2.0), (3.5, 4.0), (5.0, 6.0)]
    (tmp_path / "a.xrdml").write_text('<?xml version="1.0"?><x xmlns="http://www.xrdml.com"><positions axis="2Theta"><startPosition>10</startPosition><endPosition>20</endPosition></positions><counts>1 2 3</counts></x>')
    got = readers.xrdml(spark, str(tmp_path / "a.xrdml")).first()
    assert (got["axis"], got["intensity"]) == ([10.0, 15.0, 20.0], [1.0, 2.0, 3.0])
    (tmp_path / "s.emsa").write_text("#FORMAT : EMSA\n#OFFSET : 1.0\n#XPERCHAN : 0.5\n#DATATYPE : Y\n#SPECTRUM\n4.0\n6.0\n#ENDOFDATA\n")
    assert sorted((r["x"], r["y"]) for r in readers.emsa(spark, str(tmp_path / "s.emsa")).collect()) == [(1.0, 4.0), (1.5, 6.0)]
    (tmp_path / "jobs/j1").mkdir(parents=True)
    (tmp_path / "jobs/j1/status.json").write_text(json.dumps({"job_id": "j1", "status": "done", "created_at": "2024-01-01T00:00:00", "exit_code": 0}))
    assert [r["job_id"] for r in readers.jobs(spark, str(tmp_path / "jobs"), "done").collect()] == ["j1"]
    for n in ("Zn.pbe-us.UPF", "Zn.pz-nc.UPF", "Se_pbe_paw.upf"):
        (tmp_path / n).write_text("<UPF/>")
    files = readers.pseudopotentials(spark, str(tmp_path))
    species = spark.createDataFrame([("Zn",), ("Se",), ("Te",)], "symbol STRING")
    got = {r["symbol"]: (r["recommended"], r["missing"]) for r in readers.ranked_pseudopotentials(files, species).collect()}
    assert got == {"Zn": ("Zn.pbe-us.UPF", False), "Se": ("Se_pbe_paw.upf", False), "Te": (None, True)}


def test_paged_source(spark):
    source = readers.paged_source("numbers", "k BIGINT, v STRING", lambda cursor, stop, size: [(k, f"v{k}") for k in range(cursor + 1, min(stop, cursor + 1 + size))])
    spark.dataSource.register(source)
    got = spark.read.format("numbers").option("high", "25").option("pageSize", "4").option("partitions", "3").load()
    assert sorted(r["k"] for r in got.collect()) == list(range(25))


def test_counters_over_several_batches_equal_one(spark, tmp_path):
    rows = [(i, None, i % 3, ("view", "view", "purchase", "view", "view")[i * 7 % 5], 0.0, "") for i in range(60)]
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], streams.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    got = streams.settled(streams.skip_counters(streams.events(spark, str(tmp_path / "events"), "*.parquet", 1), "view", "purchase"), ["user_id"])
    want = {}
    for i, _, u, kind, _, _ in rows:
        s, a, n = want.get(u, (0, 0, 0))
        want[u] = (0, a + 1, n) if kind == "purchase" else (0, a, n + 1) if s == 2 else (s + 1, a, n)
    assert {r["user_id"]: (r["skips"], r["answers"], r["auto_skips"]) for r in got.collect()} == want


def test_sections_of_texts_with_marks_and_of_very_many_headings(spark):
    """Control characters are text like any other, and a text of thousands of headings takes a moment."""
    from scholia.functions import papers as P

    odd = "x\u0001junk\u0001y\nabstract\na\u0001b\u0001h\u0001tc\nMethods\n\u0001h"
    many = "\n".join(f"{('Methods', 'Results', 'Discussion')[i % 3]}\nline {i}" for i in range(9000))
    rows = spark.createDataFrame([(1, odd), (2, many)], "i INT, t STRING").select("i", P.raw_sections(F.col("t")).alias("r"), P.keyword_sections(F.col("t")).alias("k"))
    began = time.time()
    got = {r["i"]: r for r in rows.collect()}
    assert time.time() - began < 60
    assert [tuple(x) for x in got[1]["r"]] == [("body", "x\u0001junk\u0001y"), ("abstract", "a\u0001b\u0001h\u0001tc"), ("methods", "\u0001h")]
    assert [tuple(x) for x in got[1]["k"]] == [("abstract", "a\u0001b\u0001h\u0001tc"), ("methods", "\u0001h")]
    assert [tuple(x) for x in got[2]["r"]] == [("methods", "line 8997"), ("results", "line 8998"), ("discussion", "line 8999")] == [tuple(x) for x in got[2]["k"]]


def test_raw_sections_at_their_edges(spark):
    from scholia.functions import papers as P

    def slow(text):
        lines, out, name, held = text.split("\n"), {}, "body", []
        for line in lines:
            if re.fullmatch(rf"(?i)(?:{P.HEADERS})\s*", line.strip()):
                if held:
                    out[name] = "\n".join(held).strip()
                name, held = line.strip().lower().replace(" ", "_"), []
            else:
                held.append(line)
        if held:
            out[name] = "\n".join(held).strip()
        return {"body": text} if not out or list(out) == ["body"] else out

    texts = ["", "plain", " plain \n text ", "Abstract", "Abstract\nMethods", "Abstract\n\nMethods\nx", "x\nAbstract\ny\nabstract\nz", "\n Results and  discussion \n a\n b\n\nSummary\n", "abstracts\nAbstract of\nOUTLOOK\nend", "Abstract\nbody text\nbody", "a\nOutlook\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = {r["t"]: {s["name"]: s["content"] for s in r["s"]} for r in rows.select("t", P.raw_sections(F.col("t")).alias("s")).collect()}
    for t in texts:
        assert got[t] == slow(t), t
    assert spark.createDataFrame([(None,)], "t STRING").select(P.raw_sections(F.col("t"))).first()[0] is None


def test_fuzzy_titles_across_all_rows(spark):
    r = random.Random(6)
    words = ["growth", "of", "zinc", "selenide", "films", "on", "quartz", "by", "vapour", "deposition", "and", "their", "optical", "response", "defects", "in"]
    titles = [" ".join(r.choice(words) for _ in range(r.randint(1, 9))) for _ in range(60)]
    for t in titles[:40]:  # one or two letters changed, put in or left out
        for _ in range(2):
            new = list(t)
            for _ in range(r.randint(1, 2)):
                i = r.randrange(len(new))
                new[i : i + 1] = r.choice([[], ["x"], [new[i], "y"]])
            titles.append("".join(new).title())
    titles += ["", None, "ab", "abc", "abcde", "abxcde", "abcdef", titles[3]]
    r.shuffle(titles)
    kept: list[tuple[int, str]] = []
    for i, t in enumerate(titles):
        low = (t or "").lower()
        if not any(low == k or SequenceMatcher(None, low, k).ratio() > 0.9 for _, k in kept):
            kept.append((i, low))
    rows = spark.createDataFrame(list(enumerate(titles)), "i INT, t STRING").withColumn("block", F.lit("extra")).repartition(3)
    got = J.fuzzy_keep_first(rows, None, "i", "t")
    assert got.columns == rows.columns and sorted(r["i"] for r in got.collect()) == [i for i, _ in kept]
    assert J.fuzzy_keep_first(rows.limit(0), None, "i", "t").count() == 0


def test_binary_spectra(spark, tmp_path):
    numbers = np.array([1.0, 2.5, np.nan, -3.0, 2e9], "<f4").tobytes()
    spc = bytes([0, 0, 0, 130]) + (2).to_bytes(4, "little") + np.array([5.0, 6.0], "<f8").tobytes()
    spc = spc + b"\0" * (512 - len(spc)) + np.array([1.0, 2.0], "<f4").tobytes()
    files = {"a.raw": b"\0" * 712 + numbers + b"x", "b.WDF": b"\0" * 512 + numbers, "c.sp": b"\0" * 4096 + numbers, "d.spc": spc, "e.spc": b"short", "f.wdf": b"", "g.txt": b"1"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r["file"].rpartition("/")[2]: (r["axis"], r["intensity"]) for r in readers.binary_spectra(spark, str(tmp_path)).collect()}
    assert got == {"a.raw": ([10.0, 80.0], [1.0, 2.5]), "b.WDF": ([100.0, 3500.0], [1.0, 2.5]), "c.sp": ([800.0, 500.0, 200.0], [1.0, 2.5, -3.0]), "d.spc": ([5.0, 6.0], [4.0, 8.0]), "e.spc": (None, None)}


def test_what_is_stored_is_deleted_when_asked(spark):
    from scholia import durable

    rows = durable.stored(spark.range(5))
    path = rows.inputFiles()[0].rpartition("/")[0]
    assert rows.count() == 5 and os.path.dirname(path).rpartition("/")[2] == durable.folder(spark).rpartition("/")[2] and durable.cut(rows).count() == 5
    durable.discard(spark, path)
    assert not os.path.exists("/" + path.removeprefix("file:").lstrip("/"))
    assert durable.is_small(spark.range(3), 3) and not durable.is_small(spark.range(4), 3) and durable.is_small(spark.range(0), 0)


def test_regions_at_the_bounds_of_a_page_are_kept(spark):
    from decimal import Decimal

    from scholia.functions import documents as D

    def slow(x0, y0, x1, y1, width, height) -> bool:
        w, h = x1 - x0, y1 - y0
        small = w <= 0 or h <= 0 or w * h < Decimal("0.02") * width * height
        return small or max(w, h) > 7 * min(w, h) or y1 < Decimal("0.07") * height or y0 > Decimal("0.93") * height

    boxes = [(0, 0, 400, y1, 700, 800) for y1 in (55, 56, 57)] + [(0, y0, 400, y0 + 60, 700, 800) for y0 in (743, 744, 745)]
    boxes += [(0, 100, w, 100 + h, 700, 800) for w, h in ((112, 100), (111, 100), (280, 40), (281, 40), (287, 41))]
    boxes += [(0, 0, 600, 7 * k, 600, 100 * k) for k in range(1, 60)] + [(0, 93 * k, 600, 100 * k, 600, 100 * k) for k in range(1, 60)]
    rows = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], "i INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, w DOUBLE, h DOUBLE")
    got = rows.select("i", D.is_garbage_region(F.struct("x0", "y0", "x1", "y1"), F.col("w"), F.col("h")).alias("g")).collect()
    assert {r["i"]: r["g"] for r in got} == {i: slow(*b) for i, b in enumerate(boxes)}


def _kept(titles: list[str], ratio: float = 0.9) -> list[int]:
    kept: list[int] = []
    for i, t in enumerate(titles):
        if not any(t == titles[k] or SequenceMatcher(None, t, titles[k]).ratio() > ratio for k in kept):
            kept.append(i)
    return kept


def _edited(r: random.Random, title: str, most: int) -> str:
    new = list(title)
    for _ in range(r.randint(1, most)):
        i = r.randrange(len(new) + 1)
        new[i : i + r.choice([0, 1, 4])] = [r.choice("etaoinsh rdlu.,q") for _ in range(r.choice([0, 1, 1, 6]))]
    return "".join(new)


def test_similarity_is_that_of_the_sequence_matcher():
    from scholia.operators.titles import alike, common_length, masks_of, places_of, starts_of

    r = random.Random(8)
    for _ in range(250):
        letters = r.choice(["ab", "abc ", "aaaaaabbbbcccddeef ghi,!", "eeeettttaaooiinnsshhrdlu    bcfgkmpvwyz,."])
        old = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 60, 199, 200, 201, 420, 900])))
        new = _edited(r, old, max(1, len(old) // r.choice([5, 20, 60])))
        true = SequenceMatcher(None, new, old).ratio()
        for ratio in (0.9, 0.5, true, max(0.0, true - 1e-9)):
            assert alike(new, old, ratio, places_of(new), starts_of(old)) == (true > ratio), (new, old)
        matched = sum(b.size for b in SequenceMatcher(None, new, old, False).get_matching_blocks())
        assert matched <= common_length(new, masks_of(places_of(old)), len(old)) <= min(len(new), len(old))
    rows = [[0] * 40 for _ in range(40)]
    a, b = "".join(r.choice("abcd") for _ in range(39)), "".join(r.choice("abcd") for _ in range(39))
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert common_length(a, masks_of(places_of(b)), 39) == rows[-1][-1]


def test_fuzzy_titles_of_few_stretches_and_in_crowds(spark, monkeypatch):
    from scholia.operators import titles as TI

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgijklmnopqrstuvwxyz") for _ in range(6))
    titles = ["ha" * 60 + word() for _ in range(8)] + ["ho " * 150 + word() for _ in range(8)]  # no stretch in common but those of what repeats
    base = "".join(r.choice("etaoinsh rdlu etaonis h.,q") for _ in range(260))
    crowd = [base]
    for _ in range(60):  # copies of copies: similar to some of them, and not to others
        crowd.append(_edited(r, r.choice(crowd[-12:]), 3))
    titles += crowd + [_edited(r, base[:k], 4) for k in (20, 60, 150, 190, 199, 205, 230) for _ in range(4)]
    titles += ["漢字" * 40 + "".join(map(chr, range(0x4E00 + 20 * k, 0x4E00 + 20 * k + r.randint(5, 25)))) for k in range(14)]
    titles = list(dict.fromkeys(t.lower() for t in titles))
    r.shuffle(titles)
    want = _kept(titles)
    rows = spark.createDataFrame([(f"k{i:03}", t) for i, t in enumerate(titles)], "i STRING, t STRING").repartition(3)
    for limits in ({}, {"MANY": 5, "PAIRS": 300, "OWN": 20, "ALL": 60}):  # dealt to more tasks, and what is over their limit dealt anew
        for name, value in limits.items():
            monkeypatch.setattr(TI, name, value)
        assert sorted(r["i"] for r in J.fuzzy_keep_first(rows, None, "i", "t").collect()) == [f"k{i:03}" for i in want]
    assert 0 < len(want) < len(titles) - 30
    with pytest.raises(ValueError):
        J.fuzzy_keep_first(rows, None, "i", "t", 1.0)
