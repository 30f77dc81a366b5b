"""SimHash near-duplicates: vantage-point trees over 64-bit fingerprints, exact within a Hamming radius.

Fingerprints are computed where texts are read, and equal ones are merged before anything else. A tree of vantage points,
built from a sample of SAMPLE fingerprints (or eight a shard, of which there are as many as the root of their number), parts the
space into shards: at each point, what lies within the median distance goes inside, the rest outside. A fingerprint is held by one shard; by the triangle inequality it can have links only
in shards whose side it reaches with RADIUS to spare, and is sent to those of them that come after its own as a query. Each
shard searches its fingerprints by a vantage-point tree of its own: a task holds those, and streams the queries by in chunks of
CHUNK. Only a spanning forest of a chunk's links leaves it, at most a row per fingerprint, so a dense group never emits its pairs, and no link between different texts is lost: the
components are those of all pairs. They are joined up by Spark (`common.components`).

Texts: null counts as empty; the fingerprint of a text without words is zero, linked like any other. Rows repeated, or with
null ids, are rows like any other; a component's id is its least doc_id that is not null. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from scholia.durable import broadcast_if_small
from scholia.llm.common import Forest, anew, components, cut, table

SEED, WORDS, RADIUS = 42, 3, 3
SAMPLE, SPREAD, LEAF, BLOCK, CHUNK = 16_384, 16, 48, 1 << 21, 1 << 19
#: Points of a place that are compared together with those of other places, and that one task holds at most.
SMALL, LARGE = 64, 1 << 20


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text as an unsigned integer: a bit is set if over half of the shingles' hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    last = ends[WORDS - 1 :] or ends[-1:]
    hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, last)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(bits)).tobytes(), "big")


def fingerprints(text: Column) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return of(text)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


# A tree is a leaf's number, or (vantage point, distance, inner tree, outer tree).


def _split(x: np.ndarray, rng: np.random.Generator, radius: int, space: type[Bits]) -> tuple[np.ndarray, int] | None:
    """A vantage point of x and a distance that leave the least to search, with a tenth of x on each side; None if x can't be parted."""
    best = None
    for v in x[rng.permutation(len(x))[:8]]:
        n = np.bincount(space.distance(x, v)).cumsum() / len(x)
        mu = np.flatnonzero((n >= 0.1) & (n <= 0.9))
        if len(mu):
            inner, reach_in = n[mu], n[np.minimum(mu + radius, len(n) - 1)]
            reach_out = 1 - np.where(mu >= radius, n[np.maximum(mu - radius, 0)], 0)
            cost = inner * reach_in + (1 - inner) * reach_out
            i = int(cost.argmin())
            if best is None or cost[i] < best[0]:
                best = cost[i], v, int(mu[i])
    return best and best[1:]


def build(sample: np.ndarray, leaf: float, radius: int = RADIUS, space: type[Bits] | None = None):
    """A tree over the sample whose leaves hold at most about `leaf` of it, and their number."""
    rng, count, space = np.random.default_rng(7), 0, space or Bits

    def grow(x: np.ndarray):
        nonlocal count
        found = _split(x, rng, radius, space) if len(x) > leaf else None
        if not found:
            count += 1
            return count - 1
        v, mu = found
        inside = space.distance(x, v) <= mu
        return v, mu, grow(x[inside]), grow(x[~inside])

    return grow(sample), count


def route(tree, x: np.ndarray, radius: int = RADIUS, space: type[Bits] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf that x reach: its number, the places in x, and whether the leaf is their own."""
    todo, space = [(tree, np.arange(len(x)), np.ones(len(x), bool))], space or Bits
    while todo:
        node, at, own = todo.pop()
        if not len(at):
            continue
        if not isinstance(node, tuple):
            yield node, at, own
            continue
        v, mu, inner, outer = node
        d = space.distance(x[at], v).astype(np.int64)
        i, o = d <= mu + radius, d > mu - radius
        todo += [(inner, at[i], own[i] & (d[i] <= mu)), (outer, at[o], own[o] & (d[o] > mu))]


def leaves(x: np.ndarray, held: int, radius: int, among: bool, space: type[Bits]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The first `held` of x, parted by a vantage-point tree: for each of its leaves their places, and those of all that reach it."""
    rng = np.random.default_rng(7)
    todo = [(np.arange(held), np.arange(0 if among else held, len(x)))]
    while todo:
        own, ask = todo.pop()
        if not len(own) or not len(ask):
            continue
        found = None
        if len(own) > space.leaf:
            v = x[own[rng.integers(len(own))]]
            d = space.distance(x[own], v).astype(np.int64)
            mu = int(np.median(d))
            if d.max() == mu:
                mu -= 1
            if (d <= mu).any() and (d > mu).any():
                found = v, d, mu
        if found:
            v, d, mu = found
            e = space.distance(x[ask], v).astype(np.int64)
            todo += [(own[d <= mu], ask[e <= mu + radius]), (own[d > mu], ask[e > mu - radius])]
            continue
        yield own, ask


def link(held: np.ndarray, asked: np.ndarray, radius: int = RADIUS, among: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links between asked and held, and among held, if those are asked for: pairs of fingerprints."""
    x = np.concatenate([held, asked])
    forest = Forest(len(x))
    for own, ask in leaves(x, len(held), radius, among, Bits):
        step = max(1, BLOCK // len(own))
        for i in range(0, len(ask), step):
            part = ask[i : i + step]
            a, b = np.nonzero(distance(x[part][:, None], x[own][None, :]) <= radius)
            forest.join(part[a], own[b])
    apart = forest.root != np.arange(len(x))
    return x[apart], x[forest.root[apart]]


class Bits:
    """The space that a tree parts: its columns, all longs, as an array of points and back; distances; and what is found in a shard."""

    columns, out, leaf = ("fp",), ("a", "b"), LEAF
    distance = staticmethod(distance)

    @staticmethod
    def points(columns: list[np.ndarray]) -> np.ndarray:
        return columns[0].astype(np.int64).view(np.uint64)

    @staticmethod
    def longs(x: np.ndarray) -> list[np.ndarray]:
        return [x.view(np.int64)]

    @staticmethod
    def link(held: np.ndarray, asked: np.ndarray, radius: int, among: bool) -> list[np.ndarray]:
        return [x.view(np.int64) for x in link(held, asked, radius, among)]


def _parted(points: DataFrame, radius: int, space: type[Bits], keys: list[str]) -> DataFrame:
    """Edges of the points (of equal keys, if there are any) by a tree of vantage points over them all and one of each shard."""
    n = points.count()
    shards = max(1, math.ceil(math.sqrt(n) / SPREAD))  # a fingerprint is sent to more shards the more there are: few large ones
    first, names, wanted = F.xxhash64(space.columns[0]), list(space.columns), max(SAMPLE, 8 * shards)
    # those of the least hashes; the first condition leaves about twice as many, so that the tasks don't send as many each
    few = points.select(names).where(first <= F.lit(min((1 << 63) - 1, -(1 << 63) + (wanted << 65) // max(n, 1))))
    sample = few.orderBy(first, space.columns[0]).limit(wanted).toArrow()
    sample = space.points([sample.column(c).to_numpy() for c in names])
    tree, _ = build(sample, len(sample) / shards, radius, space)
    none, by = sample[:0].copy(), len(keys)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x = space.points(columns[by:])
            found = list(route(tree, x, radius, space))
            home = np.zeros(len(x), np.int64)
            for leaf, at, own in found:
                home[at[own]] = leaf
            for leaf, at, own in found:
                keep = own | (leaf > home[at])
                at, own = at[keep], own[keep]
                of = [*(c[at] for c in columns[:by]), np.full(len(at), leaf, np.int32), own]
                yield pa.RecordBatch.from_arrays([*map(pa.array, of), *map(pa.array, space.longs(x[at]))], [*keys, "shard", "own", *names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, asked, among = None, [], [], True

        def linked() -> pa.RecordBatch:
            nonlocal held, asked, among
            held = [np.concatenate([*held, none])]
            found = space.link(held[0], np.concatenate([*asked, none]), radius, among)
            asked, among = [], False
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], list(space.out))

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            of, own, x = columns[: by + 1], columns[by + 1].astype(bool), space.points(columns[by + 2 :])
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in of], axis=0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(own)]):
                if i == j:
                    continue
                here = [c[i] for c in of]
                if here != shard:
                    if shard is not None:
                        yield linked()
                    shard, held, asked, among = here, [], [], True
                held.append(x[i:j][own[i:j]])  # all of a shard's own come before its queries
                asked.append(x[i:j][~own[i:j]])
                if sum(map(len, asked)) >= CHUNK:
                    yield linked()
        if shard is not None:
            yield linked()

    of = [*keys, "shard"]
    dealt = points.select(*keys, *names).mapInArrow(send, f"{''.join(f'{c} long, ' for c in keys)}shard int, own boolean, {_longs(names)}")
    return dealt.repartition(*of).sortWithinPartitions(*of, F.desc("own")).mapInArrow(search, _longs(space.out))


def _longs(names: Iterable[str]) -> str:
    return ", ".join(f"{c} long" for c in names)


def links(points: DataFrame, radius: int = RADIUS, space: type[Bits] = Bits, place: str | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct points (fingerprints: column fp, long) within the radius.

    With a place (a column of longs), those of all pairs of an equal place: a place is a shard then, searched by a tree of its own
    (`space.few`, `space.crowd`), and one of over LARGE points is parted into shards as all points are without places.
    """
    if place is None:
        return _parted(points, radius, space, [])
    names = list(space.columns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple[np.ndarray, np.ndarray]] = []

        def linked() -> Iterator[pa.RecordBatch]:
            of, x = map(np.concatenate, zip(*wait))
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            sizes = np.diff(np.append(starts, len(of)))
            for i in np.flatnonzero(sizes > SMALL):
                yield space.crowd(x[starts[i] : starts[i] + sizes[i]], radius)
            few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
            if few.any():
                yield space.few(x[few], of[few], radius)

        def edges() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                if batch.num_rows:
                    of, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                    x, at = space.points(x), int(np.searchsorted(of, of[-1]))
                    if wait and wait[-1][0][-1] == of[-1]:  # all of one place, which may go on
                        wait.append((of, x))
                        continue
                    wait.append((of[:at], x[:at]))
                    yield from linked()
                    wait[:] = [(of[at:], x[at:])]
            if wait:
                yield from linked()

        for found in edges():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], list(space.out))

    large = cut(points.groupBy(place).count().where(F.col("count") > LARGE).select(F.col(place).alias("_place")))
    same, some = F.col(place) == F.col("_place"), not large.isEmpty()
    large = broadcast_if_small(large)
    whole = points.join(large, same, "left_anti") if some else points
    found = whole.select(place, *names).repartition(place).sortWithinPartitions(place).mapInArrow(search, _longs(space.out))
    return found.unionByName(_parted(points.join(large, same, "left_semi"), radius, space, [place])) if some else found


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, key (hash of the text), fp, component_id: one row per input row."""
    prints = cut(docs.select("doc_id", F.xxhash64("text").alias("key"), fingerprints(F.coalesce("text", F.lit(""))).alias("fp")))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct, radius))
    linked = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "low", "root")
    low = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = linked.join(low, "root").select(F.col("fp").alias("_fp"), "component_id")
    # anew, so that both sides of the join have exchanges of their own and a fingerprint that many rows share can be split
    of = distinct.join(linked, F.col("fp") == F.col("_fp"), "left").select(anew("fp").alias("_fp"), F.coalesce("component_id", "low").alias("component_id"))
    return prints.join(of, F.col("fp") == F.col("_fp"), "left").drop("_fp")


def dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents with one row of each component: that of the least id (and least key, among rows of that id)."""
    found = cut(classes(docs.select("doc_id", "text"), radius))
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "key", "fp")).alias("r"), F.count("*").alias("n"))
    named = found.where("doc_id = component_id").groupBy("component_id").agg(F.min(F.struct("doc_id", "key", "fp")).alias("r"))
    keep = first.where("component_id IS NULL").select("r.doc_id", "r.key").unionByName(named.select("r.doc_id", "r.key")).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"))
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("_id")) & (F.col("of") == F.col("_key")), "left_semi")
    repeated = found.groupBy("doc_id", "key").count().where("count > 1")
    if not repeated.isEmpty():  # equal in id and text: any one of them stays
        kept = kept.dropDuplicates(["id", "of"])
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
SQL: dict[str, str] = {}
