"""License scans, sharding, secret scans and mixing against brute force."""

from __future__ import annotations

import hashlib
import itertools
import re
import time
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.llm import licenses, secrets, sharding, source_mix
from tests.llm.conftest import DOCS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIT = licenses.TEMPLATES[0][1]


def license_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def base_places(t):
    w = license_words(t)
    return sorted((i, label) for label, phrase in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def test_licenses(spark, docs, rows):
    changed = MIT.split()
    del changed[10], changed[30]
    more = [
        (100, "The MIT License. mit-license MIT\nLicense", None, None, None), (101, f"intro words {' '.join(changed)} end", None, None, None), (102, "General Public General Public License, Apache LICENSE", None, None, None),
        (103, " ".join(MIT.split()[:12]), None, None, None), (104, "mit", None, None, None), (102, "General Public General Public License, Apache LICENSE", None, None, None), (102, "other mit license", None, None, None), (None, "mit license", None, None, None),
    ]
    all_rows = rows + more
    got = licenses.scan(spark.createDataFrame(all_rows, DOCS).withColumn("t", F.lit(1)).withColumn("w", F.lit(2))).collect()
    assert len(got) == len(all_rows)
    want = Counter()
    for i, t, *_ in all_rows:
        p = base_places(t)
        want[i, len(license_words(t)), len(p), p[0][0] if p else None, p[-1][0] if p else None, ",".join(sorted({x for _, x in p}))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    of = {r["doc_id"]: r for r in got}
    assert of[101]["labels"] == "mit" and of[101]["n_base"] == 0 and of[101]["spans"].startswith("mit:2:") and 0.8 < of[101]["score"] < 1
    assert of[103]["labels"] == "" and of[103]["score"] == 0
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.scan(docs).count() == len(rows)


def test_licenses_of_no_documents(none):
    assert licenses.scan(none).count() == 0


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    t = t or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [x[2] for x in sorted(found)]


def test_secrets(spark, rows):
    blob = "q7Zk+X9vB2mT/4LdWc8RyH1sJp0Gn6Ea"
    more = [
        (100, 'password = "hunter22" and PASSWORD:abc, Api_Key=\'abcdef.g', None, None, None), (101, "AKIA" + "A1B2" * 4 + " AKIASHORT xAKIA" + "Z" * 16, None, None, None), (102, "0123456789abcdef01234567 fffé" + "a" * 24, None, None, None),
        (103, "token=token = secret=value99 paſſword=abcdefgh tokens: abc", None, None, None), (104, f"😀 here {blob} stands", None, None, None), (105, "get_user_account_settings_manager InternationalOrganisationResponsibility", None, None, None), (106, f"token={blob}", None, None, None),
        (107, "token=" + "ab" * 20, None, None, None), (108, ("secret: " + "c0ffee" * 5 + "\n") * 300, None, None, None),
    ]
    docs = spark.createDataFrame(rows + more, DOCS)
    scanned = secrets.scan(docs.withColumn("m_hex", F.lit(1)), secrets.train(secrets.samples(spark)))
    got = scanned.select("doc_id", secrets.listed(F.col("spans")).alias("s")).collect()
    assert Counter((r["doc_id"], ",".join(x for x in r["s"].split(",") if x and not x.startswith("markov"))) for r in got) == Counter((r[0], ",".join(base_spans(r[1]))) for r in rows + more)
    markov = {r["doc_id"]: [x for x in r["s"].split(",") if x.startswith("markov")] for r in got}
    assert markov[104] == [f"markov:7:{7 + len(blob)}"] and not markov[105] and not markov[106]
    assert not any(markov[i] for i in range(20))


def test_secrets_of_very_many_matches(spark):
    """Seconds, not hours, for 100,000 matches in one text; tokens between known spans are told apart from them."""
    blob = "q7Zk+X9vB2mT/4LdWc8RyH1sJp0Gn6Ea"
    text = "".join(f"{i} {'c0ffee' * 4} x\n" if i % 2 else f"{i} {blob}\n" for i in range(60_000)) + "token=abcdef1 " * 40_000
    began = time.time()
    got = secrets.scan(spark.createDataFrame([(1, text), (2, "")], "doc_id BIGINT, text STRING"), secrets.train(secrets.samples(spark))).collect()
    assert time.time() - began < 120
    spans = next(r["spans"] for r in got if r["doc_id"] == 1)
    want = [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]{24,}", text)] + [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text)] + [(m.start(), "markov", m.end()) for m in re.finditer(re.escape(blob), text)]
    assert [(s["start"], s["kind"], s["end"]) for s in spans] == sorted(want)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(-50, 50), max_size=40), min_size=1, max_size=12))
def test_running_merges(spark, lists):
    rows = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    for merge, plain in ((lambda a, b: a + b, lambda a, b: a + b), (F.greatest, max), (F.least, min)):
        got = Counter(tuple(r[0]) for r in rows.select(secrets._running(F.col("x"), merge)).collect())
        assert got == Counter(tuple(itertools.accumulate(x, plain)) for x in lists)


def test_secrets_of_no_documents(spark, none):
    assert secrets.scan(none, secrets.train(secrets.samples(spark))).count() == 0


def test_markov_models_tell_random_strings(spark):
    ratio = secrets.train(secrets.samples(spark))
    held = secrets.samples(spark, 6000).where("true").withColumn("i", F.monotonically_increasing_id())
    scored = held.where(F.length("text") >= 20).select("random", secrets.score(F.col("text"), ratio).alias("s"))
    wrong = scored.agg(F.avg(F.when((F.col("random") == 1) != (F.col("s") > secrets.THRESHOLD), 1.0).otherwise(0.0)).alias("e")).first()["e"]
    assert wrong < 0.02
    empty = secrets.train(secrets.samples(spark).limit(0))
    assert set(empty) == {0.0}


def test_shards_fit(spark, docs, rows):
    limit = 4000
    got = sharding.assign(docs, limit)
    assert got.columns == [c for c in docs.columns if c != "shard"] + list(sharding.SHARD_COLUMNS)
    out = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r[0], r[1]) for r in rows)
    sizes, count, hashes = Counter(), Counter(), defaultdict(set)
    for r in out:
        n = len((r["text"] or "").encode())
        sizes[r["shard"]] += n
        count[r["shard"]] += 1
        h = int(hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}:{r['text'] or ''}".encode()).hexdigest()[:15], 16)
        hashes[r["shard"]].add(h)
        assert f"{h:060b}".startswith(r["shard"]) and len(r["shard"]) == r["shard_depth"]
    for r in out:
        assert (r["shard_bytes"], r["shard_docs"]) == (sizes[r["shard"]], count[r["shard"]]) and r["fits"] == (sizes[r["shard"]] <= limit)
        if not r["fits"]:
            assert len(hashes[r["shard"]]) == 1
        if r["shard"]:  # only an oversized bucket was split
            up = r["shard"][:-1]
            assert sum(n for s, n in sizes.items() if s.startswith(up)) > limit


def test_repeated_rows_are_dealt_to_shards_that_fit(spark):
    docs = spark.createDataFrame([(1, "a" * 100, None, None, None)] * 57 + [(2, "b" * 50, None, None, None)], DOCS).repartition(4)
    got = sharding.assign(docs, 1000).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += len(r["text"])
    assert len(got) == 58 and max(sizes.values()) <= 1000 and all(r["shard_bytes"] == sizes[r["shard"]] and r["fits"] for r in got)


def test_one_shard_and_none(docs, none):
    assert {r["shard"] for r in sharding.assign(docs, 1 << 30).select("shard").collect()} == {""}
    assert sharding.assign(none).count() == 0


def water(sizes: dict, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else share[s] for s in names}
        capped |= over


def test_mix(spark, docs, rows):
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += n(r[1])
    targets = water(dict(sizes))
    got = source_mix.assign(docs).collect()
    assert len(got) == len(rows) and got == source_mix.assign(docs).collect() or sorted(map(tuple, got), key=repr) == sorted(map(tuple, source_mix.assign(docs).collect()), key=repr)
    for r in source_mix.targets(docs).collect():
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
    mixed = source_mix.mix(docs)
    assert mixed.columns == docs.columns
    copies = Counter()
    for r in got:
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("source"))
    by = docs.select("doc_id", "source").join(source_mix.assign(docs), "doc_id").groupBy("source", "target").agg(F.sum("taken").alias("taken"))
    assert sum(abs(r["taken"] - r["target"]) for r in by.collect()) < 0.05 * 120_000
    assert source_mix.assign(docs.limit(0)).count() == 0 and source_mix.mix(docs.limit(0)).count() == 0
