"""The pipeline's near-duplicates against brute force over five-word shingles."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import near_copies, simhash
from scholia.llm.common import table
from tests.conftest import SF
from tests.llm.conftest import DOCS, words


def slow_set(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_roots(texts):
    sets, root = [slow_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def partition(names, roots):
    groups = {}
    for n, r in zip(names, roots):
        groups.setdefault(r, []).append(n)
    return Counter(tuple(sorted(g, key=repr)) for g in groups.values())


def test_equals_brute_force(spark, docs, none):
    for df in (docs, table(spark, SF, "documents")):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        ids, keys = zip(*rows)
        got = near_copies.classes(df).collect()
        roots = slow_roots(keys)
        least = {r: min((i for i, q in zip(ids, roots) if q == r and i is not None), default=None) for r in roots}
        assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((i, least[r]) for i, r in zip(ids, roots))
        kept = near_copies.dedup(df)
        assert kept.columns == df.columns and kept.count() == len(set(roots))
    assert near_copies.classes(none).count() == 0 and near_copies.dedup(none).count() == 0


def test_chains_and_pairs_at_the_threshold(spark):
    base = words(7, 60).split()
    texts = [" ".join(base), " ".join([*base[:58], "x", "y"]), " ".join([*base[:30], "zz", *base[31:]]), " ".join([*base[:50], *("q" * 1 + str(i) for i in range(10))])]
    texts += [" ".join([*base[:58], "x", str(i)]) for i in range(30)] + [words(500 + i, 60) for i in range(20)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.classes(df).collect()}
    roots = slow_roots(texts)
    assert partition(got, got.values()) == partition(range(len(texts)), roots)


def test_stage_reaches_copies_that_differ_by_words(spark):
    base = words(11, 80).split()
    near = " ".join([*base[:40], "other", *base[41:]])
    assert len(slow_set(" ".join(base)) & slow_set(near)) >= 0.8 * len(slow_set(" ".join(base)) | slow_set(near))
    rows = [(1, " ".join(base), "en", "s", 0), (2, near, "en", "s", 0), (3, words(12, 80), "en", "s", 0), *((None, words(i, 80), "en", "s", 0) for i in (13, 14))]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert Counter(r["doc_id"] for r in kept) == {1: 1, 3: 1, None: 2}


@pytest.mark.parametrize("kind", ["int", "string", "decimal(20,0)"])
def test_ids_of_any_type(spark, docs, kind):
    """The classes are those of long ids; of strings the least comes first in the order of strings."""
    found = near_copies.classes(docs.withColumn("doc_id", F.col("doc_id").cast(kind)))
    groups = lambda df: {frozenset(map(str, r["g"])) for r in df.where("doc_id IS NOT NULL").groupBy("root").agg(F.collect_list("doc_id").alias("g")).collect()}
    assert groups(found) == groups(near_copies.classes(docs))
    kept = near_copies.dedup(docs.withColumn("doc_id", F.col("doc_id").cast(kind)))
    assert kept.schema["doc_id"].dataType.simpleString() == kind and kept.count() == found.select("root").distinct().count()


def test_stage_searches_fingerprints_by_the_trees(spark, monkeypatch):
    """The stage's candidates are those of operator 8's trees, and without them nothing is linked."""
    asked, links = [], simhash.links
    base = words(11, 80).split()
    rows = [(1, " ".join(base), "en", "s", 0), (2, " ".join([*base[:40], "other", *base[41:]]), "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(simhash, "links", lambda sets, *more: asked.append(sets.columns) or links(sets, *more))
    assert corpus_pipeline.near_duplicates(spark, df, SF).count() == 1 and len(asked) == 1 and "f0" in asked[0]
    monkeypatch.setattr(simhash, "links", lambda sets, *more: links(sets.limit(0), *more))
    assert corpus_pipeline.near_duplicates(spark, df, SF).count() == 2


def test_pairs_at_the_threshold_are_candidates():
    rng = np.random.default_rng(3)
    for n, more, fewer in [(4, 1, 0), (5, 1, 0), (9, 1, 1), (12, 3, 0), (45, 5, 5), (100, 25, 0), (450, 50, 50)] * 100:
        x = rng.integers(0, 1 << 63, n + more, np.uint64)
        a, b = x[:n], x[fewer:]
        assert (n - fewer) / (n + more) >= near_copies.LEAST
        p, q = (np.concatenate([[0, int(near_copies.SCALE * np.log(len(s)))], near_copies.fingerprint(s)]).astype(np.uint64) for s in (a, b))
        assert near_copies.Sets.distance(p[None], q)[0] <= near_copies.RADIUS and np.bitwise_count(p[2:4] ^ q[2:4]).sum() <= near_copies.HALF


def test_trees_find_all_candidates(spark, monkeypatch):
    """Several shards and chunks against all pairs: components, and weights that count each pair once."""
    rng, n = np.random.default_rng(5), 600
    x = np.concatenate([np.arange(n)[:, None], (near_copies.SCALE * rng.normal(5, 1, (n, 1)).clip(1)).astype(int), rng.integers(-(1 << 63), 1 << 63, (n, 4))], 1)
    for i in range(0, 300, 3):  # near and not so near ones, and chains of them
        for j in (1, 2):
            x[i + j, 1:] = x[i + j - 1, 1:]
            x[i + j, 1] += rng.integers(0, 90)
            for bit in rng.choice(256, rng.integers(20, 90), replace=False):
                x[i + j, 2 + bit // 64] ^= (np.uint64(1) << np.uint64(bit % 64)).view(np.int64)
    monkeypatch.setattr(simhash, "SPREAD", n**0.5 / 6)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    monkeypatch.setattr(near_copies.Sets, "leaf", 20)
    found = simhash.links(spark.createDataFrame(x.tolist(), list(near_copies.Sets.columns)), near_copies.RADIUS, near_copies.Sets).collect()
    p, root, weight = x.view(np.uint64), list(range(n)), Counter()
    for i in range(n):
        d = near_copies.Sets.distance(p[:i], p[i])
        for j in np.flatnonzero((d <= near_copies.RADIUS) & (np.bitwise_count(p[:i, 2:4] ^ p[i, 2:4]).sum(1) <= near_copies.HALF)):
            root = [root[j] if r == root[i] else r for r in root]
            weight += {int(k): int(near_copies.RADIUS + 1 - d[j]) for k in (i, j)}
    got, sums = list(range(n)), Counter()
    for r in found:
        sums[r["a"]] += r["w"] if r["a"] == r["b"] else 0
        got = [got[r["b"]] if g == got[r["a"]] else g for g in got]
    assert partition(range(n), got) == partition(range(n), root) and 100 < len(set(root)) < n
    assert +sums == weight


@pytest.mark.parametrize("free", [1, 7, 40])
def test_blocks_bring_together_what_the_pivot_does_not_join(spark, monkeypatch, free):
    monkeypatch.setattr(near_copies, "BLOCK", 1000)
    rows = [(1, u, 10, u if u < free else 99) for u in range(40)]
    found = near_copies._blocks(spark.createDataFrame(rows, "k long, u long, n long, root long")).collect()
    meet = {}
    for r in found:
        meet.setdefault((r["i"], r["j"]), set()).add(r["u"])
    assert all(any({a, b} <= m for m in meet.values()) for a in range(free) for b in range(40))
    assert max(map(len, meet.values())) < 30


def test_unrelated_texts_do_not_meet(spark, monkeypatch):
    """What is sent to the search is in proportion to the texts, and only near ones meet in a place."""
    sent, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda points, *more: sent.extend(r.asDict() for r in points.collect()) or links(points, *more))
    texts = [words(i, 80) for i in range(300)]
    texts.append(texts[0].replace(texts[0].split()[40], "other", 1))
    assert near_copies.dedup(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)).count() == 300
    met = {}
    for r in sent:
        met.setdefault(r.get("place"), set()).add(r["u"])  # without places all meet
    assert 300 < len(sent) <= 12 * len(texts) and len(set().union(*(u for u in met.values() if len(u) > 1))) == 2


def test_near_sets_share_two_of_their_least_hashes():
    rng = np.random.default_rng(4)
    for n, more, fewer in [(4, 1, 0), (5, 1, 0), (9, 1, 1), (12, 3, 0), (45, 5, 5), (44, 10, 0), (100, 25, 0), (450, 50, 50)] * 200:
        x = rng.integers(0, 1 << 63, n + more, np.uint64)
        a, b = (near_copies.lowest(np.sort(s)) for s in (x[:n], x[fewer:]))
        assert len(np.intersect1d(a, b)) >= 2 and max(len(a), len(b)) <= near_copies.LOWEST


def test_crowded_places_are_parted_and_lose_no_pair(spark, monkeypatch):
    """A line that many texts have is no place, a group of copies is; near sets meet all the same."""
    monkeypatch.setattr(near_copies, "CROWD", 30)
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(1 << 40, 1 << 63, n, np.uint64)
    line, base = rng.integers(0, 1 << 40, 2, np.uint64), draw(100)
    sets = [np.concatenate([line, draw(58)]) for _ in range(80)]
    sets += [np.concatenate([s[:57], draw(3)]) for s in sets[:20]] + [np.concatenate([base[:96], draw(4)]) for _ in range(60)]
    sets = [np.sort(s) for s in sets]
    rows = [(i, near_copies.lowest(s).view(np.int64).tolist(), *[0] * 5) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, f"u long, lowest array<long>, {', '.join(f'{c} long' for c in near_copies.Sets.columns[1:])}")
    places = {r["place"]: set(r["u"]) for r in near_copies._placed(df).groupBy("place").agg(F.collect_list("u").alias("u")).collect()}
    near = {(i, j) for j in range(160) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert len(near) > 1000 and all(any({i, j} <= m for m in places.values()) for i, j in near)
    assert not set(line.view(np.int64).tolist()) & places.keys() and max(len(m & set(range(100))) for m in places.values()) == 100  # the line's two hashes together
    assert sum(map(len, places.values())) <= 160 * (near_copies.LOWEST - 2 + 2 * (near_copies.LOWEST - 1))


def crowd(n):
    """Points: most near one of them, others in chains that hang on to these or are apart, the last unrelated."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.arange(n)[:, None], np.full((n, 1), 1000), rng.integers(-(1 << 63), 1 << 63, (n, 4))], 1)
    for i in range(1, n * 4 // 5):
        x[i] = [i, *x[0 if i < n // 2 else i - 1 - i % 3, 1:]]
        for bit in rng.choice(256, rng.integers(5, 30) if i < n // 2 else rng.integers(15, 70), replace=False):
            x[i, 2 + bit // 64] ^= (np.uint64(1) << np.uint64(bit % 64)).view(np.int64)
    return x


def joined(n, pairs):
    forest = near_copies.Forest(n)
    forest.join(*np.array(list(pairs), np.int64).reshape(-1, 2).T)
    return forest.root.tolist()


def candidates(x):
    p = x.view(np.uint64)
    for i in range(len(p)):
        good, _ = near_copies.Sets.near(p, np.arange(i), i, near_copies.RADIUS)
        yield from ((i, int(j)) for j in np.flatnonzero(good))


def test_crowds_are_joined_without_all_pairs(monkeypatch):
    x, seen, near, leaves = crowd(1000), [], near_copies.Sets.near, simhash.leaves
    monkeypatch.setattr(near_copies.Sets, "near", staticmethod(lambda x, a, *more: seen.append(len(a)) or near(x, a, *more)))
    monkeypatch.setattr(simhash, "leaves", lambda *of: (seen.append(len(own) * len(ask)) or (own, ask) for own, ask in leaves(*of)))
    a, b, w = near_copies.Sets.crowd(x.view(np.uint64), near_copies.RADIUS)
    compared = sum(seen)
    roots = joined(1000, candidates(x))
    assert joined(1000, zip(a, b)) == roots and 100 < len(set(roots)) < 900
    assert set(a[w > 0]) == {i for p in candidates(x) for i in p} and (w >= 0).all() and compared < 600 * 1000  # all of them: 1000 * 1000
    few = x[:50]
    a, b, w = near_copies.Sets.few(np.concatenate([few, few]).view(np.uint64), np.repeat([1, 2], 50), near_copies.RADIUS)
    assert joined(50, zip(a, b)) == joined(50, candidates(few))
    assert {int(k): int(v) for k, v in zip(a, w) if v} == {k: 2 * v for k, v in weights(few).items()}


def weights(x):
    out, p = Counter(), x.view(np.uint64)
    for i, j in candidates(x):
        d = int(near_copies.Sets.distance(p[[i]], p[j])[0])
        out.update({i: near_copies.RADIUS + 1 - d, j: near_copies.RADIUS + 1 - d})
    return +out


@pytest.mark.parametrize("large", [1 << 20, 60])
def test_places_of_any_size_find_all_candidates(spark, monkeypatch, large):
    """Points meet in their places alone, those of few and of many points, and those that are parted."""
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "SPREAD", 5)
    monkeypatch.setattr(simhash, "SMALL", 10)
    x, rows, want = crowd(400), [], set()
    for place, at in enumerate([range(150), range(140, 200), range(300, 400), *(range(i, i + 4) for i in range(200, 300, 3))]):
        rows += [(place, *x[i].tolist()) for i in at]
        want |= {(at[i], at[j]) for i, j in candidates(x[list(at)])}
    df = spark.createDataFrame(rows, f"place long, {', '.join(f'{c} long' for c in near_copies.Sets.columns)}").repartition(3)
    found = simhash.links(df, near_copies.RADIUS, near_copies.Sets, "place").collect()
    assert partition(range(400), joined(400, ((r["a"], r["b"]) for r in found))) == partition(range(400), joined(400, want))
