"""Near copies by words: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of at least LEAST.

The method is that of `simhash`: fingerprints are searched by its vantage-point trees, shard by shard. Its 64 bits and radius of 3 can't
carry a similarity of 0.8, at which two fingerprints differ in 15 % of their bits (19 % for sets of 4 and 5 shingles, at most 16 % for
greater ones). So fingerprints have 256 bits here, and candidates differ in RADIUS of them at most, and in HALF of the first 128: a pair
at 0.8 is missed with a chance of some 3e-8 (1e-5 for 4 and 5 shingles), and of unrelated texts 3e-11 are candidates. The distance
is the greater one of that of the fingerprints and that of the sizes, on a logarithmic scale: sets so near have sizes in a proportion of
LEAST to 1 / LEAST.

Such a radius leaves nothing out by fingerprints alone, for those of unrelated texts are all about 128 bits apart: trees over all texts send
each to nearly half of all shards. So the shards are places here, named by the least hashes of a set, and a set goes to at most LOWEST of
them, however many texts there are: those of sets at LEAST have two in common, for certain up to 54 shingles, else but for a chance of
0.2^12 * 49 (2e-7) that they have fewer, and of 0.2^12 that they have none. Each place is searched by a tree of its own. A hash that more than CROWD sets have, as of
a line that many texts share, names no place itself; each pair of it and another one does, up to LOWEST^2 rows for a set.

Candidates are then compared on the sets of shingles themselves, as 64-bit hashes, so no pair below LEAST is linked. Texts of equal
sets are merged first. A dense group never emits its pairs: the search returns a spanning forest of the candidates, whose components are
the groups in which links can be. First each group's members are compared to one of them, that with the most and nearest candidates,
which is the text that most of a group were made from; so a group of copies costs a row for each. Members that the pivot doesn't join
meet all others in blocks of bounded size, each pair of blocks in a task of its own, where all overlaps come from a product of incidence
matrices, and only a spanning forest leaves the task. Such a member goes to as many tasks as the group has blocks, with its hashes, and
one that the pivot joins to as many as the others have: U of G members of n shingles are about 2 * U * G * (n + EACH) / BLOCK rows.

Words and texts are those of `simhash`: bytes in lower case between ASCII white space, null counting as empty. A text of under
five words is one shingle, texts without words are equal. Rows repeated, or with null ids, are rows like any other; ids are of any type
that has an order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from scholia.durable import broadcast_if_small
from scholia.llm import simhash
from scholia.llm.common import Forest, anew, components, cut

SEED, WORDS, LEAST = 42, 5, 0.8
#: Longs of a fingerprint, and hashes whose bits are added up at once (as bytes).
LONGS, STEP = 4, 255
#: Bits in which fingerprints of candidates differ at most, in all and in the first half, and the fewest shingles of a set that can have near ones.
RADIUS, HALF, FEWEST = 76, 48, 4
#: A length's logarithm on the scale of the distance: sizes in a proportion of LEAST are RADIUS apart, or less.
SCALE = (RADIUS - 1) / -math.log(LEAST)
#: Pairs that are compared at once, and links that a task collects before it joins them.
PAIRS, LINKS = 1 << 17, 1 << 20
#: The least hashes of a set by which it is brought together with others, at most, and sets of one of them that are parted by a second one.
LOWEST, CROWD = 12, 512
#: Vantage points tried in a crowd, the share of it that must be near the best, and others of those that the rest is compared with first.
TRIES, DENSE, PROBES = 16, 0.125, 32
#: Edges that one task joins up, instead of rounds of many.
FEW = 1 << 16
#: Shingles of a block of sets that are compared with each other, what a set counts beside its own, and shingles of a step of that.
BLOCK, EACH, WIDTH = 1 << 18, 256, 4096


def shingles(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [joined[a:b] for a, b in zip(starts, ends[WORDS - 1 :] or ends[-1:])]


def hashes(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's set of shingles."""
    return np.unique(np.frombuffer(b"".join([xxh64_digest(s, SEED) for s in set(shingles(text))]), ">u8").astype(np.uint64))


def fingerprint(x: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, of LONGS words of 64 bits: a bit is set if over half of the set have it. A word's bits are those of
    the hashes mixed anew (splitmix64)."""
    ones = np.zeros(64 * LONGS, np.int64)
    for i in range(0, len(x), STEP):
        z = x[i : i + STEP, None] + np.arange(1, LONGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(x)).view(np.uint64)


def lowest(x: np.ndarray) -> np.ndarray:
    """The least hashes of a sorted set: as many as make sure that two are common to sets at LEAST, but LOWEST at most."""
    return x[: min(LOWEST, len(x) - math.ceil(LEAST * len(x) - 1e-9) + 2)]


def sketch(text: str | None) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """A hash of a text's set of shingles, the set's size, that as a coordinate, its fingerprint, and its least hashes."""
    x = hashes(text)
    return xxh64_intdigest(x.tobytes(), SEED), len(x), int(SCALE * math.log(max(len(x), 1))), fingerprint(x), lowest(x)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sketch(t) for t in b.column(2).to_pylist()]
        u = np.array([f[0] for f in found], np.uint64).view(np.int64)
        n, s = (np.array([f[i] for f in found], np.int64) for i in (1, 2))
        bits = np.array([f[3] for f in found], np.uint64).reshape(-1, LONGS).view(np.int64)
        low = pa.array([f[4].view(np.int64) for f in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(u), pa.array(n), low, pa.array(s), *(pa.array(c.copy()) for c in bits.T)], ["doc_id", "key", "u", "n", "lowest", *Sets.columns[1:]])


class Sets(simhash.Bits):
    """Sets by fingerprint and size: points are rows of u, s (the size's coordinate) and the fingerprint's words. A distance is that of the fingerprints or of the
    sizes, the greater one; both have the triangle inequality, so it has it too."""

    columns, out, leaf = ("u", "s", *(f"f{i}" for i in range(LONGS))), ("a", "b", "w"), 1024

    @staticmethod
    def points(columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([c.astype(np.int64) for c in columns], 1).view(np.uint64)

    @staticmethod
    def longs(x: np.ndarray) -> list[np.ndarray]:
        return [c.copy() for c in x.view(np.int64).T]

    @staticmethod
    def distance(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        apart = np.abs(x[:, 1].view(np.int64) - v[..., 1].astype(np.int64))
        return np.maximum(np.bitwise_count(x[:, 2:] ^ v[..., 2:]).sum(1, dtype=np.int64), apart)

    @staticmethod
    def near(x: np.ndarray, a: np.ndarray, b: np.ndarray | int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether pairs of places in x are candidates, and their distances."""
        half = np.bitwise_count(x[a, 2 : 2 + LONGS // 2] ^ x[b, 2 : 2 + LONGS // 2]).sum(-1, dtype=np.int64)
        d = Sets.distance(x[a], x[b])
        return (half <= HALF) & (d <= radius), d

    @staticmethod
    def edges(u: np.ndarray, root: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """(a, b, 0) of a spanning forest of the candidates, and (a, a, w) of each set that has some: w is the greater, the more and the nearer they are."""
        u, apart, some = u.view(np.int64), np.flatnonzero(root != np.arange(len(u))), np.flatnonzero(weight)
        return [np.concatenate(c) for c in ((u[apart], u[some]), (u[root[apart]], u[some]), (np.zeros(len(apart), np.int64), weight[some]))]

    @staticmethod
    def link(held: np.ndarray, asked: np.ndarray, radius: int, among: bool) -> list[np.ndarray]:
        """The edges of all candidates between asked and held, and among held, if those are asked for."""
        x = np.concatenate([held, asked])
        forest, weight = Forest(len(x)), np.zeros(len(x), np.int64)
        Sets.search(x, len(held), radius, among, forest, weight)
        return Sets.edges(x[:, 0], forest.root, weight)

    @staticmethod
    def search(x: np.ndarray, held: int, radius: int, among: bool, forest: Forest, weight: np.ndarray, names: np.ndarray | None = None) -> None:
        """Adds the candidates among x, whose first are held, to the forest and the weights, where x have the places `names`."""
        names = np.arange(len(x)) if names is None else names
        wait: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if wait:
                forest.join(*map(np.concatenate, zip(*wait)))
                wait.clear()

        size = x[:, 1].astype(np.int64)
        for own, ask in simhash.leaves(x, held, radius, among, Sets):
            own, ask = own[np.argsort(size[own])], ask[np.argsort(size[ask])]
            y, held_size, step = [c.copy() for c in x[own].T], size[own], max(1, PAIRS // len(own))
            for i in range(0, len(ask), step):
                part = ask[i : i + step]
                low, high = np.searchsorted(held_size, [size[part[0]] - radius, size[part[-1]] + radius + 1])
                if low == high:
                    continue
                z = [c.copy()[:, None] for c in x[part].T]
                half = np.bitwise_count(z[2] ^ y[2][low:high])
                for c in range(3, 2 + LONGS // 2):
                    half += np.bitwise_count(z[c] ^ y[c][low:high])
                at = np.flatnonzero(half <= HALF)
                if not len(at):
                    continue
                a, b = part[at // (high - low)], own[low:high][at % (high - low)]
                a, b = a[a > b], b[a > b]  # each pair once: what only asks has the higher places
                d = Sets.distance(x[a], x[b])
                a, b, d = names[a[d <= radius]], names[b[d <= radius]], d[d <= radius]
                if len(a):
                    weight += np.bincount(np.concatenate([a, b]), np.tile(radius + 1 - d, 2), len(weight)).astype(np.int64)
                    wait.append((a, b))
                    if sum(len(w[0]) for w in wait) >= LINKS:
                        flush()
        flush()

    @staticmethod
    def few(x: np.ndarray, of: np.ndarray, radius: int) -> list[np.ndarray]:
        """The edges of all candidates of equal `of`, which is sorted and of which few are equal; x may be repeated."""
        names, at = np.unique(x[:, 0], return_inverse=True)
        forest, weight, step, a = Forest(len(names)), np.zeros(len(names), np.int64), 0, np.arange(len(of))
        while True:
            step += 1
            a = a[a + step < len(of)]
            a = a[of[a] == of[a + step]]
            if not len(a):
                return Sets.edges(names, forest.root, weight)
            good, d = Sets.near(x, a, a + step, radius)
            p, q, w = at[a[good]], at[a[good] + step], radius + 1 - d[good]
            weight += np.bincount(np.concatenate([p, q]), np.tile(w, 2), len(names)).astype(np.int64)
            forest.join(p, q)

    @staticmethod
    def crowd(x: np.ndarray, radius: int) -> list[np.ndarray]:
        """Edges whose components are those of all candidates among x, of which most may be.

        What is near a vantage point is one component with it, so its sets are not compared with each other, and another set only until
        it is near one of them: a group of copies costs a few comparisons for each.
        """
        rng, left = np.random.default_rng(7), np.arange(len(x))
        forest, weight = Forest(len(x)), np.zeros(len(x), np.int64)

        def join(a: np.ndarray, v: int, d: np.ndarray) -> None:
            weight[a] += radius + 1 - d
            weight[v] += (radius + 1 - d).sum()
            forest.join(a, np.full(len(a), v))

        while len(left) > simhash.SMALL:
            best = None
            for v in rng.choice(left, TRIES, False):
                good, d = Sets.near(x, left, v, radius)
                if best is None or good.sum() > best[1].sum():
                    best = v, good, d
            v, good, d = best
            if good.sum() < DENSE * len(left):
                break
            ball, left = left[good], left[~good]
            join(ball[ball != v], v, d[good][ball != v])
            for v in rng.choice(ball, min(PROBES, len(ball)), False):
                good, d = Sets.near(x, left, v, radius)
                join(left[good], v, d[good])
                ball, left = np.concatenate([ball, left[good]]), left[~good]
            both = np.concatenate([ball, left])
            Sets.search(x[both], len(ball), radius, False, forest, weight, both)
        Sets.search(x[left], len(left), radius, True, forest, weight, left)
        return Sets.edges(x[:, 0], forest.root, weight)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([hashes(t).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), found], ["u", "x"])


def _near(size_a: np.ndarray, size_b: np.ndarray, both: np.ndarray) -> np.ndarray:
    return both / np.maximum(size_a + size_b - both, 1) >= LEAST


def _arrays(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = _arrays(b.column(2)), _arrays(b.column(3))
            both = np.array([len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y)])
            good = _near(np.array(list(map(len, x))), np.array(list(map(len, y))), both)
            yield b.select(["a", "b"]).filter(pa.array(good))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common hashes of each two of the sets, by products of incidence matrices of bounded width."""
    sizes = np.array(list(map(len, sets)))
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)  # exact up to 2**24
    edges = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + WIDTH, WIDTH)) if len(column) else []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        m = np.zeros((len(sets), WIDTH), np.float32)
        m[row[low:high], column[low:high] - i * WIDTH] = 1
        out += m @ m.T
    np.fill_diagonal(out, sizes)
    return out


def _compare(group: pa.Table) -> pa.Table:
    """A spanning forest of the links among the sets of a pair of blocks, between what their pivots join already."""
    u, root = group.column("u").to_numpy(), group.column("root").to_numpy()
    x = _arrays(group.column("x"))
    sizes = np.array(list(map(len, x)))
    a, b = np.nonzero(np.triu(_near(sizes[:, None], sizes[None, :], overlaps(x)), 1))
    names, at = np.unique(root, return_inverse=True)
    forest = Forest(len(names))
    forest.join(at[a], at[b])
    apart = np.flatnonzero(forest.root != np.arange(len(names)))
    return pa.table({"a": names[apart], "b": names[forest.root[apart]]})


def _blocks(members: DataFrame) -> DataFrame:
    """k, i, j, u, root: the members (k, u, n, root) of each group dealt to blocks, for each pair of blocks that they take part in.

    Members that the group's pivot joins are not compared with each other again: their blocks only meet those of the others.
    """
    members = members.withColumn("free", F.col("root") == F.col("u"))
    blocks = lambda c: F.coalesce(F.ceil(F.sum(F.when(c, F.col("n") + EACH)) / BLOCK).cast("int"), F.lit(0))
    count = members.groupBy("k").agg(blocks(F.col("free")).alias("o"), blocks(~F.col("free")).alias("l")).withColumn("_k", anew("k")).drop("k")
    dealt = members.join(count, F.col("k") == F.col("_k"))
    dealt = dealt.withColumn("own", F.when(F.col("free"), F.pmod(F.xxhash64("u"), F.col("o"))).otherwise(F.col("o") + F.pmod(F.xxhash64("u"), F.col("l"))).cast("int"))
    last = F.when(F.col("free"), F.col("o") + F.col("l")).otherwise(F.col("o")) - 1
    other = dealt.select("k", "u", "root", "own", "o", "l", F.explode(F.sequence(F.lit(0), last)).alias("other")).where("own <> other OR o + l = 1")
    return other.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "u", "root")


def _placed(sets: DataFrame) -> DataFrame:
    """The points of the sets, each in the places (column place) that its least hashes name.

    A hash that over CROWD sets have names a place with each other one of theirs instead, unless most of those sets' hashes are such: these are
    copies of each other, of which a place with a second hash would hold nearly all again.
    """
    each = sets.select(*Sets.columns, "lowest", F.explode("lowest").alias("h"))
    hot = cut(each.groupBy("h").count().where(F.col("count") > CROWD).select("h"))
    if hot.isEmpty():
        return each.select(F.col("h").alias("place"), *Sets.columns)
    held = cut(each.select("u", "h", F.size("lowest").alias("all")).join(broadcast_if_small(hot), "h"))
    of = held.groupBy("u").count().select(anew("u").alias("_u"), "count")
    loose = held.join(of, F.col("u") == F.col("_u")).groupBy("h").agg((2 * F.sum("count") < F.sum("all")).alias("loose")).where("loose")
    each = each.join(broadcast_if_small(cut(loose).withColumnRenamed("h", "_h")), F.col("h") == F.col("_h"), "left")
    others = F.transform(F.array_remove("lowest", F.col("h")), lambda x: F.xxhash64("h", x))
    return each.select(F.explode(F.when(F.col("loose"), others).otherwise(F.array("h"))).alias("place"), *Sets.columns)


def _by_pivot(sets: DataFrame) -> DataFrame:
    """k, u, n, pivot, m: the members of each group of candidates but its pivot, and the pivot, with both sizes."""
    found = cut(simhash.links(_placed(sets.where(F.col("n") >= FEWEST)), RADIUS, Sets, "place"))
    weights = found.where("a = b").groupBy("a").agg(F.sum("w").alias("weight"))
    groups = components(found.where("a <> b").select("a", "b"), few=FEW).select("node", F.col("root").alias("k"))
    rows = cut(groups.join(weights, F.col("node") == F.col("a")).join(sets.select("u", "n"), F.col("node") == F.col("u")).select("k", "u", "n", "weight"))
    pivots = rows.groupBy("k").agg(F.max(F.struct("weight", "u", "n")).alias("p")).select(anew("k").alias("_k"), F.col("p.u").alias("pivot"), F.col("p.n").alias("m"))
    return rows.join(pivots, F.col("k") == F.col("_k")).where("u <> pivot").select("k", "u", "n", "pivot", "m")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), root (a set of the component), component_id (its least doc_id): one row per input row."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = cut(docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_sketches, f"doc_id {kind}, key long, u long, n long, lowest array<long>, {', '.join(f'{c} long' for c in Sets.columns[1:])}"))
    sets = cut(prints.groupBy("u").agg(F.min("n").alias("n"), F.min(F.struct("doc_id", "key")).alias("one"), F.min("doc_id").alias("low"), F.first("lowest").alias("lowest"), *(F.min(c).alias(c) for c in Sets.columns[1:])))
    rows = cut(_by_pivot(sets))
    wanted = rows.select(F.explode(F.array("u", "pivot")).alias("u")).distinct()
    # one row of each set is read again, by its id, so that a text that many rows hold is no hot key
    one = sets.join(wanted, "u", "left_semi").select("u", F.col("one.doc_id").alias("_id"), F.col("one.key").alias("_key"))
    texts = docs.join(one, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))).select("u", "text").mapInArrow(_hashed, "u long, x array<long>")
    found = cut(texts.groupBy("u").agg(F.first("x").alias("x")))
    close = F.least("n", "m") >= F.greatest("n", "m") * LEAST - 1e-6
    pairs = rows.where(close).select(F.col("pivot").alias("a"), F.col("u").alias("b"))
    side = lambda s: found.select(F.col("u").alias(s), F.col("x").alias(f"x{s}"))
    edges = cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "xa", "xb").mapInArrow(_verified, "a long, b long"))
    # what was not compared yet: in each group, members other than its pivot, if that doesn't join all of them
    heads = edges.select(anew("b").alias("_u"), F.col("a").alias("root"))
    rows = cut(rows.join(heads, F.col("u") == F.col("_u"), "left").select("k", "u", "n", F.coalesce("root", "u").alias("root")))
    open_ = rows.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(anew("k").alias("_k"))
    blocks = _blocks(rows.join(open_, F.col("k") == F.col("_k")).drop("_k")).join(found, "u").select("k", "i", "j", "u", "root", "x")
    more = blocks.groupBy("k", "i", "j").applyInArrow(_compare, "a long, b long")
    roots = components(more, few=FEW).select(F.col("node"), F.col("root").alias("r"))
    linked = sets.join(heads, F.col("u") == F.col("_u"), "left").select("u", "low", F.coalesce("root", "u").alias("of"))
    linked = linked.join(roots, F.col("of") == F.col("node"), "left").select("u", "low", F.coalesce("r", "of").alias("root"))
    low = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    of = linked.join(low, "root").select(anew("u").alias("_u"), "root", "component_id")
    return prints.select("doc_id", "key", "u").join(of, F.col("u") == F.col("_u"), "left").select("doc_id", "key", "root", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with one row of each component: that of the least id (and least key, among rows of that id)."""
    found = cut(classes(docs))
    # of rows that are first in their component by id, or all of a component without ids, the least key
    keep = found.where("doc_id <=> component_id").groupBy("root").agg(F.min("doc_id").alias("_id"), F.min("key").alias("_key")).drop("root")
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"))
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("_id")) & (F.col("of") == F.col("_key")), "left_semi")
    repeated = found.groupBy("doc_id", "key").count().where("count > 1")
    if not repeated.isEmpty():  # equal in id and text: any one of them stays
        kept = kept.dropDuplicates(["id", "of"])
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
