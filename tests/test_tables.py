"""Tables that are rewritten folder by folder, services that filter, and files as they come."""

from __future__ import annotations

import glob
import json
import threading
import urllib.parse
import urllib.request
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.operators.tables import BUCKET, KeyedTable
from scholia.sources import paged
from scholia.streaming import streams as S
from tests.conftest import SF

SCHEMA = "k BIGINT, n BIGINT, v STRING"


@pytest.fixture
def keyed(spark, tmp_path):
    made = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], 8)
    made.create(spark.createDataFrame([(i, 0, f"v{i}") for i in range(100)] + [(None, 0, "none")], SCHEMA))
    return made


def files(t):
    return {f for f in glob.glob(f"{t.path}/{BUCKET}=*/*.parquet")}


def content(t):
    return {(r["k"]): (r["n"], r["v"]) for r in t.rows().collect()}


def test_other_folders_keep_their_files(spark, keyed):
    before, was = files(keyed), content(keyed)
    changes = spark.createDataFrame([(3, 1, "first"), (3, 2, None), (3, 1, "again"), (1000, 1, "new"), (None, 5, "null key")], SCHEMA)
    touched = keyed.upsert(changes, "n", ["v"])
    assert touched == sorted({r[0] for r in changes.select(keyed._bucket()).distinct().collect()}) and len(touched) < 8
    after = files(keyed)
    of = lambda names, hit: {f for f in names if (int(f.split(f"{BUCKET}=")[1].split("/")[0]) in touched) is hit}
    assert of(before, False) == of(after, False) and not of(before, True) & of(after, True)
    assert content(keyed) == {**was, 3: (2, "v3"), 1000: (1, "new"), None: (5, "null key")}


def test_only_touched_folders_are_read(spark, keyed):
    seen = []
    keyed._rewrite([2, 5], lambda present: seen.append(present._jdf.queryExecution().executedPlan().toString()) or present)
    assert f"{BUCKET}" in seen[0] and "PartitionFilters: [" in seen[0] and "2,5" in seen[0].replace(" ", "")
    assert len(content(keyed)) == 101


def test_deletes_and_folders_that_end_empty(spark, keyed):
    gone = keyed.rows().where(keyed._bucket() == 4)
    keys = {r["k"] for r in gone.collect()}
    assert keyed.delete(gone) == [4]
    assert set(content(keyed)) == set(range(100)) - keys | {None}
    assert keyed.delete(spark.createDataFrame([], SCHEMA)) == [] and keyed.upsert(spark.createDataFrame([], SCHEMA), "n") == []
    keyed.delete(spark.createDataFrame([(None, 0, "")], SCHEMA))
    assert None not in content(keyed)


def test_many_changes_equal_a_plain_upsert(spark, keyed):
    want = content(keyed)
    for n in range(1, 4):
        rows = [(k, n, f"{n}:{k}") for k in range(n * 7, 130, n * 5)]
        keyed.upsert(spark.createDataFrame(rows, SCHEMA), "n")
        want |= {k: (i, v) for k, i, v in rows}
    assert content(keyed) == want


@pytest.fixture(scope="module")
def service(spark):
    """The events by pages over HTTP; counts its requests."""
    rows = [tuple(r) for r in load(spark, SF, "events").select("event_id", "user_id", "event_type", "value").orderBy("event_id").collect()]
    names = ["event_id", "user_id", "event_type", "value"]
    asked = []
    test = {"=": lambda a, b: a == b, "in": lambda a, b: a in b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "prefix": lambda a, b: a.startswith(b)}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = json.loads(urllib.parse.unquote(self.path.split("?", 1)[1]))
            asked.append(q)
            good = [r for r in rows if q["cursor"] < r[0] < q["stop"] and all(test[o](r[names.index(c)], v) for c, o, v in q["where"])]
            body = json.dumps(good[: q["size"]]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}/?"

    def fetch(cursor, stop, size, where):
        q = urllib.parse.quote(json.dumps({"cursor": cursor, "stop": stop, "size": size, "where": where}))
        with urllib.request.urlopen(at + q) as reply:
            return [tuple(r) for r in json.loads(reply.read())]

    paged.register(spark, "events_service", "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE", fetch, ("=", "in", ">=", "prefix"))
    yield lambda: spark.read.format("events_service").option("high", len(rows)).option("partitions", 4).load(), asked
    server.shutdown()


@pytest.mark.parametrize("condition,most", [
    ("true", None), ("event_id < 90", 4), ("event_id = 17", 1), ("event_id >= 10 AND event_id < 10", 1), ("event_id IN (5, 300)", 8), ("event_type = 'view'", 8),
    ("event_type LIKE 'sig%' AND event_id > 500", 8), ("user_id >= 10 AND value > 20", 12), ("value > 30 OR event_type = 'view'", None), ("event_id = 3 AND event_id = 4", 1), ("event_type IN ('view', 'click') AND user_id = 3", 4), ("event_id > 99999999", 1), ("event_type IS NULL", None),
])
def test_conditions_go_into_the_requests(spark, service, condition, most):
    read, asked = service
    events = load(spark, SF, "events").select("event_id", "user_id", "event_type", "value")
    total = -(-events.count() // paged.PAGE)
    asked.clear()
    got = Counter(map(tuple, read().where(condition).collect()))
    assert got == Counter(map(tuple, events.where(condition).collect()))
    assert len(asked) <= (most if most is not None else total + 4)


def test_joins_and_counts_over_the_service(spark, service):
    read, asked = service
    asked.clear()
    got = read().where("event_type = 'signup'").groupBy("user_id").count()
    want = load(spark, SF, "events").where("event_type = 'signup'").groupBy("user_id").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {tuple(map(tuple, q["where"])) for q in asked} == {(("event_type", "=", "signup"),)}


def test_new_files_are_listed_once(spark, tmp_path):
    root, run = tmp_path / "root", str(tmp_path / "run")
    (root / "sub").mkdir(parents=True)
    find = lambda: sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in S.discovered(spark, str(root), run, "binaryFile", S.FILE, "*.dat").collect())
    assert find() == []
    (root / "a.dat").write_bytes(b"xx")
    (root / "sub/b.dat").write_bytes(b"y")
    (root / "empty.dat").write_bytes(b"")  # Spark leaves files without contents out
    (root / "c.txt").write_bytes(b"x")
    assert find() == [("a.dat", 2), ("b.dat", 1)]
    assert find() == []
    (root / "sub/d.dat").write_bytes(b"12345")
    assert find() == [("d.dat", 5)]


def test_new_job_records(spark, tmp_path):
    root, run = tmp_path / "jobs", str(tmp_path / "run")
    for n, name in enumerate(("j1", "j2", "j3")):
        (root / name).mkdir(parents=True)
        (root / name / "status.json").write_text(json.dumps({"job_id": name, "status": "done" if n else "failed"}))
        got = S.discovered(spark, str(root), run, "json", "job_id STRING, status STRING", "status.json").where(F.col("status") != "failed")
        assert [r["job_id"] for r in got.collect()] == ([name] if n else [])
