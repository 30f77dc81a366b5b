"""Clusters and codes of vectors against plain rounds over Python's integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.llm import clustering, vector_codes

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def table_of(n: int, dimensions: int = 64) -> list[tuple]:
    r = random.Random(n)
    near = [[r.gauss(0, 1) for _ in range(dimensions)] for _ in range(6)]
    rows = [(i, [float(np.float32(a + r.gauss(0, 0.3))) for a in near[i % 6]], i % 4 or None) for i in range(n)]
    rows += [(n, [0.0] * dimensions, 1), (n + 1, [0.0] * dimensions, 1), rows[3], rows[3], (None, rows[5][1], None), (None, None, None)]
    rows += [(n + 2, None, 0), (n + 3, [], 0), (n + 4, [1.0] * (dimensions - 1), 0), (n + 5, [1.0] * (dimensions - 1) + [None], 0)]
    rows += [(n + 6, [1.0] * (dimensions - 1) + [math.nan], 0), (n + 7, [-math.inf] * dimensions, 0), (n + 8, [-3.25] * dimensions, None)]
    return rows


def kept(rows: list[tuple], dimensions: int = 64) -> list[tuple]:
    """id, integers, label, and the floats that ties go by."""
    good = [r for r in rows if r[1] and len(r[1]) == dimensions and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label, [float(np.float32(x)) for x in v]) for i, v, label in good]


def far(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(x: list[int], of: list[list[int]]) -> int:
    return min(range(len(of)), key=lambda j: (far(x, of[j]), j))


def means(xs: list[list[int]], at: list[int], of: list[list[int]]) -> list[list[int]]:
    own = [[x for x, a in zip(xs, at) if a == j] for j in range(len(of))]
    return [[sum(c) // len(g) for c in zip(*g)] if g else list(old) for g, old in zip(own, of)]


def clusters_of(rows: list[tuple], k: int = 8, rounds: int = 10) -> tuple[list[tuple], list[list[int]]]:
    rows = kept(rows)
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[3]))[:k]
    centroids, xs = [r[1] for r in first], [r[1] for r in rows]
    for _ in range(rounds):
        centroids = means(xs, [nearest(x, centroids) for x in xs], centroids)
    at = [nearest(x, centroids) for x in xs]
    return sorted(((r[0], a, far(x, centroids[a])) for r, x, a in zip(rows, xs, at)), key=repr), centroids


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in ("x", "cluster", "upper", "lower", "moved", "code", "error", "part", "entry", "sums")})


@pytest.mark.parametrize("n", [40, 3])
def test_clusters_equal_plain_rounds(spark, n):
    rows = table_of(max(n, 6)) if n > 6 else table_of(6)[:n]
    found, centroids, inertia = clustering.cluster(frame(spark, rows))
    want, wanted = clusters_of(rows)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert centroids.tolist() == wanted
    assert inertia == [sum(d for _, c, d in want if c == j) for j in range(len(wanted))]


def test_no_vectors(spark):
    none = frame(spark, table_of(6)).limit(0)
    found, centroids, inertia = clustering.cluster(none)
    assert found.columns == ["vec_id", "cluster", "distance"] and found.count() == 0 and not len(centroids) and inertia == []
    coded, books = vector_codes.compress(none)
    assert coded.count() == 0 and books == []


def test_large_numbers(spark):
    """Squares that a long can't hold are computed as Python's integers, and a distance beyond it is null."""
    rows = [(i, [float(np.float32(v))] * 64, 0) for i, v in enumerate((1e6, 1.5e6, -2e6, 3e7, 1e12, 0.0, 1e38, 5.0, 7.0, 1e6))]
    found, _, _ = clustering.cluster(frame(spark, rows), rounds=3)
    assert found.count() == len(rows) and found.where("distance = 0").count() > 0
    coded, _ = vector_codes.compress(frame(spark, rows), rounds=2)
    assert coded.where("error = 0").count() == len(rows)  # each is an entry of its own, or equal to one


vectors = st.lists(st.lists(st.integers(-6, 6), min_size=4, max_size=4), min_size=1, max_size=40)


@settings(max_examples=60, deadline=None)
@given(vectors, st.integers(1, 6), st.integers(1, 5))
def test_bounds_never_change_an_assignment(xs, k, rounds):
    """Small numbers are full of ties; the bounds are carried through the rounds."""
    x = np.array(xs, np.int64)
    centroids, before = x[:k].copy(), None
    state = None
    for _ in range(rounds):
        rule = clustering.Assignment(centroids, before)
        state = rule(x, *(state or rule.start(len(x))))
        at = [nearest(v, centroids.tolist()) for v in xs]
        assert state[0].tolist() == at
        before, centroids = centroids, np.array(means(xs, at, centroids.tolist()), np.int64)


def test_bounds_skip_most_distances():
    rng = np.random.default_rng(5)
    x = clustering.scaled(np.repeat(rng.normal(0, 3, (8, 64)), 200, axis=0) + rng.normal(0, 0.2, (1600, 64)))
    centroids, before, state, counts = x[::200].copy(), None, None, []
    for _ in range(5):
        rule = clustering.Assignment(centroids, before)
        state = rule(x, *(state or rule.start(len(x))))
        before, centroids = centroids, np.array([x[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) for j in range(8)])
        counts.append(rule.computed)
    assert sum(counts[1:]) < 0.1 * 4 * x.shape[0] * 8


def codes_of(rows: list[tuple], entries: int, rounds: int) -> tuple[list[tuple], list]:
    rows = kept(rows)
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = []
    cut = [[r[1][p * 16 : p * 16 + 16] for r in rows] for p in range(4)]
    for p in range(4):
        book = [r[1][p * 16 : p * 16 + 16] for r in first]
        for _ in range(rounds):
            book = means(cut[p], [nearest(x, book) for x in cut[p]], book)
        books.append(book)
    at = [[nearest(x, books[p]) for x in cut[p]] for p in range(4)]
    error = [sum(far(cut[p][i], books[p][at[p][i]]) for p in range(4)) for i in range(len(rows))]
    return sorted(((r[0], r[2], bytes(at[p][i] for p in range(4)), error[i]) for i, r in enumerate(rows)), key=repr), books


@pytest.mark.parametrize("entries", [256, 7])
def test_codes_equal_plain_rounds(spark, entries):
    rows = table_of(60)
    coded, books = vector_codes.compress(frame(spark, rows), entries=entries)
    want, wanted = codes_of(rows, entries, 4)
    assert sorted(((r["vec_id"], r["label"], bytes(r["code"]), r["error"]) for r in coded.collect()), key=repr) == want
    assert [b.tolist() for b in books] == wanted
    codes = np.array([list(w[2]) for w in want])
    assert vector_codes.decoded(codes, books).shape == (len(want), 64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=8, max_size=8), min_size=1, max_size=30), st.lists(st.lists(st.integers(-3, 3), min_size=8, max_size=8), min_size=1, max_size=12))
def test_bounds_keep_the_nearest_entry(xs, book):
    at, d = vector_codes.Codebook(np.array(book, np.int64)).nearest(np.array(xs, np.int64))
    assert at.tolist() == [nearest(x, book) for x in xs]
    assert d.tolist() == [far(x, book[a]) for x, a in zip(xs, at)]


def test_bounds_leave_out_most_entries():
    rng = np.random.default_rng(6)
    smooth = clustering.scaled(np.cumsum(rng.normal(0, 0.3, (600, 16)), axis=1) + rng.normal(0, 2, (600, 1)))
    rule = vector_codes.Codebook(smooth[:256])
    rule.nearest(smooth)
    assert rule.computed < 0.2 * 600 * 256
