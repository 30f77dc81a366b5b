"""Clusters of vectors by Lloyd's rounds with Elkan's bounds.

Vectors are integers: floor(SCALE * component). Each vector carries an upper bound of the distance to its own centroid and a lower
bound of the distance to each; both follow the centroids by how far these moved. A distance is only computed where the bounds and
half the distance between two centroids leave a choice. Bounds are rounded outwards and compared strictly, so a centroid at an equal
distance is never skipped and ties go to the smaller number; whatever is computed is an exact integer.

A round is one pass over a table of vectors and bounds, which is written anew to the shared folder and replaces the one before: no
shuffle, and a lost executor costs its tasks alone. Tasks hold one Arrow batch. What a round gathers are sums of the vectors that
changed their cluster, added up by Spark to k * (dimensions + 1) numbers; the centroids, all that the driver holds, are as few.

Null, empty or shorter vectors, and those with a component that is null or not finite, are dropped. Rows repeated are vectors of
their own. A null id is hashed as an empty string and comes out as null. With fewer than k vectors each is a centroid; without
vectors the result is empty. Components beyond 2**62 after scaling count as 2**62; a distance that no long can hold is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import free, stored, table

CLUSTERS, ROUNDS, SEED, SCALE, DIMENSIONS = 8, 10, 3, 1024, 64
#: Up to this, squared distances of 64 components fit a long; beyond it numbers are Python's.
NARROW = 1 << 27
_MOST, _LONG = 1 << 62, (1 << 63) - 1
_FAR = np.finfo(np.float32).max


def finite(name: str, dimensions: int) -> str:
    """The condition, in SQL, for vectors that count."""
    return f"size({name}) = {dimensions} AND forall({name}, x -> x IS NOT NULL AND abs(x) < double('Infinity'))"


def scaled(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -float(_MOST), float(_MOST)).astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each vector's integers in as few bytes as its batch needs."""
    most = int(np.abs(x).max(initial=0))
    kind = next(k for k in ("<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
    return [row.tobytes() for row in x.astype(kind)]


def unpacked(column: pa.Array, dimensions: int) -> np.ndarray:
    """The vectors of a column of packed ones, as 64-bit integers, or as Python's where they are large."""
    rows = column.to_pylist()
    x = np.zeros((len(rows), dimensions), np.int64)
    sizes = np.array(list(map(len, rows)), np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x[at] = np.frombuffer(b"".join([rows[i] for i in at]), f"<i{size // dimensions}").reshape(-1, dimensions)
    return fitting(x)


def fitting(x: np.ndarray) -> np.ndarray:
    return x if not x.size or max(abs(int(x.max())), abs(int(x.min()))) <= NARROW else x.astype(object)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    if x.dtype == object or y.dtype == object:
        x, y = x.astype(object), y.astype(object)
    d = x - y
    return (d * d).sum(-1)


def _above(x: np.ndarray) -> np.ndarray:
    """Floats that are not under x, which may be off by a few units of its last place."""
    with np.errstate(over="ignore"):
        return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.minimum(x * (1 - 1e-12), _FAR).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Assignment:
    """One round's rule: from vectors, their clusters and bounds, to the same for the centroids of now."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None) -> None:
        self.centroids = fitting(centroids)
        self.moved = None if before is None else _above(_root(squared(self.centroids, fitting(before)))).astype(np.float64)
        half = _below(_root(squared(self.centroids[:, None], self.centroids[None]))) / np.float32(2)
        np.fill_diagonal(half, np.inf)
        self.half = half
        self.computed = 0

    def start(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds that know nothing."""
        return np.zeros(n, np.int32), np.full(n, np.inf, np.float32), np.zeros((n, len(self.centroids)), np.float32)

    def __call__(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.moved is not None:
            upper = _above(upper + self.moved[cluster])
            lower = _below(np.maximum(lower - self.moved, 0))
        go = np.flatnonzero(upper >= self.half.min(1)[cluster])  # the others are nearer to theirs than half the way to any other
        of, up, low, own = cluster[go], upper[go], lower[go], x[go]
        best = squared(own, self.centroids[of])
        self.computed += len(go)
        up = _above(_root(best))
        low[np.arange(len(go)), of] = _below(_root(best))
        for j in range(len(self.centroids)):
            i = np.flatnonzero((of != j) & (low[:, j] <= up) & (self.half[of, j] <= up))
            if not len(i):
                continue
            d = squared(own[i], self.centroids[j])
            self.computed += len(i)
            low[i, j] = _below(_root(d))
            nearer = (d < best[i]) | ((d == best[i]) & (j < of[i]))
            i, d = i[nearer], d[nearer]
            of[i], best[i], up[i] = j, d, _above(_root(d))
        cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
        cluster[go], upper[go], lower[go] = of, up, low
        return cluster, upper, lower


def _sums(k: int, x: np.ndarray, cluster: np.ndarray, sign: int) -> np.ndarray:
    """Of each cluster the sum of its vectors and their number, as one row of Python's integers."""
    out = np.zeros((k, x.shape[1] + 1), object)
    for j in np.unique(cluster):
        at = cluster == j
        out[j, :-1] = [sign * int(v) for v in x[at].sum(0)]
        out[j, -1] = sign * int(at.sum())
    return out


def _once(values: np.ndarray, rows: int) -> pa.Array:
    """A column with numbers in its first row, and nulls in the others."""
    return pa.array([[Decimal(int(v)) for v in values.ravel()], *[None] * (rows - 1)], pa.list_(pa.decimal128(38, 0)))


_STATE = ["vec_id", "x", "cluster", "upper", "lower", "moved"]


def _first_round(rule: Assignment, dimensions: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = scaled(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
                small = fitting(x)
                cluster, upper, lower = rule(small, *rule.start(len(x)))
                yield _rows(b.column(0), pa.array(packed(x), pa.binary()), cluster, upper, lower, _sums(len(rule.centroids), small, cluster, 1))

    return run


def _next_round(rule: Assignment, dimensions: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, before, upper, lower = _read(b, rule, dimensions)
                cluster, upper, lower = rule(x, before, upper, lower)
                other = cluster != before
                k = len(rule.centroids)
                moved = _sums(k, x[other], cluster[other], 1) + _sums(k, x[other], before[other], -1)
                yield _rows(b.column(0), b.column(1), cluster, upper, lower, moved)

    return run


def _last_round(rule: Assignment, dimensions: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, *state = _read(b, rule, dimensions)
                cluster = rule(x, *state)[0]
                d = [int(v) for v in squared(x, rule.centroids[cluster])]
                sums = np.zeros(len(rule.centroids), object)
                np.add.at(sums, cluster, np.array(d, object))
                distance = pa.array([v if v <= _LONG else None for v in d], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()), distance, _once(sums, len(d))], ["vec_id", "cluster", "distance", "inertia"])

    return run


def _read(b: pa.RecordBatch, rule: Assignment, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lower = np.frombuffer(b"".join(b.column(4).to_pylist()), np.float32).reshape(-1, len(rule.centroids))
    return unpacked(b.column(1), dimensions), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False), lower


def _rows(ids: pa.Array, x: pa.Array, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, x, pa.array(cluster), pa.array(upper), pa.array([r.tobytes() for r in lower], pa.binary()), _once(moved, len(ids))], _STATE)


def added(df: DataFrame, column: str, size: int) -> list[int]:
    """The sums of a column of arrays by place; Spark adds them up, and `size` numbers come back."""
    out = [0] * size
    for place, total in df.where(f"{column} IS NOT NULL").select(F.posexplode(column)).groupBy("pos").agg(F.sum("col")).collect():
        out[place] = int(total)
    return out


def seeds(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the least hashes, in their order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(key, "embedding").limit(k).collect()
    return scaled(np.array([r["embedding"] for r in first], np.float64))


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """From vec_id and embedding: the vectors' vec_id, cluster and distance (squared), the final centroids, and each cluster's sum of distances."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    kept = vectors.where(finite("embedding", dimensions)).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    centroids = seeds(kept, k, seed)
    k = len(centroids)
    if not k:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), centroids, []
    schema = f"vec_id {kind}, x binary, cluster int, upper float, lower binary, moved array<decimal(38,0)>"
    totals = np.zeros((k, dimensions + 1), object)
    state, before = None, None
    for _ in range(rounds):
        rule = Assignment(centroids, before)
        after = stored(kept.mapInArrow(_first_round(rule, dimensions), schema) if state is None else state.mapInArrow(_next_round(rule, dimensions), schema))
        if state is not None:
            free(state)
        state, before = after, centroids
        totals += np.array(added(state, "moved", totals.size), object).reshape(totals.shape)
        centroids = np.array([[int(s) // int(t[-1]) for s in t[:-1]] if t[-1] else list(c) for t, c in zip(totals, centroids)], np.int64)
    out = stored(state.mapInArrow(_last_round(Assignment(centroids, before), dimensions), f"vec_id {kind}, cluster int, distance long, inertia array<decimal(38,0)>"))
    free(state)
    return out.drop("inertia"), centroids, added(out, "inertia", k)


def digest(numbers: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in numbers.ravel()).encode()).hexdigest()


def _long(n: int) -> int | None:
    return n if n <= _LONG else None


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids, inertia = cluster(table(spark, sf_dir, "embeddings"))
    of = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1) if values else F.lit(None).cast(kind)
    return found.select("vec_id", "cluster", "distance", of([_long(n) for n in inertia], "long").alias("cluster_inertia"), F.lit(_long(sum(inertia))).cast("long").alias("inertia"), of([digest(c) for c in centroids], "string").alias("centroid_sha256"))


def _sql() -> str:
    """The rounds one after the other, all distances of each."""
    nearest = lambda n: f"""
n{n} AS MATERIALIZED (SELECT rid, cid, d FROM (SELECT v.rid, c.cid, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{n} c USING (pos) GROUP BY v.rid, c.cid) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, cid) = 1)"""  # noqa: E731
    moved = lambda n: f"""
c{n + 1} AS MATERIALIZED (SELECT c.cid, c.pos, CAST(coalesce(m.x, c.x) AS BIGINT) AS x FROM c{n} c LEFT JOIN
  (SELECT cid, pos, (s - ((s % n) + n) % n) // n AS x FROM (SELECT cid, pos, sum(x) AS s, count(*) AS n FROM v JOIN n{n} USING (rid) GROUP BY cid, pos)) m USING (cid, pos))"""  # noqa: E731
    rounds = ",".join(nearest(n) + "," + moved(n) for n in range(ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT rid, unnest(range({DIMENSIONS})) AS pos, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
first AS (SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS cid FROM kept QUALIFY cid < {CLUSTERS}),
c0 AS MATERIALIZED (SELECT cid, pos, x FROM first JOIN v USING (rid)),{rounds},{nearest(ROUNDS)},
h AS (SELECT cid, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cid)
SELECT vec_id, CAST(cid AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cid) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM n{ROUNDS} JOIN kept USING (rid) JOIN h USING (cid)
"""


QUERIES = {"op11_clusters": op11_clusters}
SQL = {"op11_clusters": _sql()}
