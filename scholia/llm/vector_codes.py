"""Compression of vectors to codes of a few bytes: a codebook for each part of the vector, entries found by segment-mean lower bounds.

Vectors are integers, floor(SCALE * component), cut into equal consecutive parts. The nearest entry of a part is searched from coarse to
fine: for segments of b components with sums S and residual norms R (what is left of the segment's norm beside its mean),

    distance >= sum over segments of (S_x - S_c)^2 / b + (R_x - R_c)^2

first with the whole part as one segment, then with halves, quarters and eighths. At each step the entry with the least bound gets its
exact distance, and entries whose bound is above the least exact distance so far are left out; a slack beyond any rounding keeps
ties in. Survivors get exact integer distances, ties go to the lower index.

Codebooks start from the vectors of the least ids and are refined by rounds; a round is one pass over the packed vectors, written once
to the shared folder, and each task adds up its own vectors per entry, so that Spark adds at most parts * entries rows a task. The
codebooks, parts * entries * (dimensions / parts) numbers, are all that the driver holds and tasks are sent.

Null vectors, those of another number of dimensions and those with a component that is null or not finite are dropped. Rows repeated are
vectors of their own, equal ids stand in the order of their components, null ids come last. With fewer vectors than entries each is an
entry; without vectors the result is empty. Components beyond 2**62 after scaling count as 2**62; an error that no long can hold is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.durable import is_small
from scholia.llm.clustering import DIMENSIONS, SCALE, digest, finite, fitting, packed, scaled, squared, unpacked
from scholia.llm.common import anew, free, stored, table

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Segments of a part at each step; those that don't divide a part are left out. Vectors that are compared at a time.
STEPS, CHUNK = (1, 2, 4, 8), 2048
_SLACK, _LONG = 1e-9, (1 << 63) - 1


def _features(x: np.ndarray, count: int) -> np.ndarray:
    """Of each row's segments the sums over the root of their length, and the norms of what is beside their means: their distances are the bounds."""
    s = x.reshape(len(x), count, -1)
    b = s.shape[2]
    sums, squares = s.sum(2), (s * s).sum(2)
    return np.hstack([sums / np.sqrt(b), np.sqrt((b * squares - sums * sums).astype(np.float64) / b)])  # under the root an exact integer


class Codebook:
    """The nearest of some entries, with bounds from coarse to fine."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = fitting(entries)
        self.narrow = self.entries.dtype != object
        self.steps = [c for c in STEPS if entries.shape[1] % c == 0]
        self.norms = (self.entries.astype(np.float64) ** 2).sum(1)
        self.features = [_features(self.entries, c) for c in self.steps] if self.narrow else []
        self.computed = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row its entry's index and exact squared distance."""
        if not self.narrow or x.dtype == object:  # numbers beyond a long: Python's, and all distances
            d = np.array([[int(v) for v in squared(row, self.entries)] for row in x], object).reshape(len(x), len(self.entries))
            self.computed += d.size
            at = np.array([min(range(len(r)), key=r.__getitem__) for r in d], np.int64)
            return at, d[np.arange(len(x)), at]
        found = [self._nearest(x[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.full(len(x), np.iinfo(np.int64).max)
        left = np.ones((len(x), len(self.entries)), bool)
        norms = (x.astype(np.float64) ** 2).sum(1)
        for step, of in zip(self.steps, self.features):
            rows = np.flatnonzero(left.sum(1) > 1)  # the others have their entry
            if not len(rows):
                break
            own = _features(x[rows], step)
            bound = (own * own).sum(1)[:, None] + (of * of).sum(1) - 2 * (own @ of.T) - _SLACK * (norms[rows, None] + self.norms)
            bound[~left[rows]] = np.inf
            least[rows] = np.minimum(least[rows], squared(x[rows], self.entries[bound.argmin(1)]))
            self.computed += len(rows)
            left[rows] = bound <= least[rows, None]
        rows, columns = np.nonzero(left)
        d = squared(x[rows], self.entries[columns])
        self.computed += len(d)
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        least = np.minimum.reduceat(d, first)
        hit = np.flatnonzero(d == np.repeat(least, np.diff(np.append(first, len(rows)))))
        hit = hit[np.flatnonzero(np.diff(rows[hit], prepend=-1))]  # the lowest index of those that tie
        return columns[hit], least


def _packed(dimensions: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = scaled(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed(x), pa.binary())], ["vec_id", "label", "x"])

    return run


def _totals(books: list[np.ndarray]) -> Callable:
    """part, entry, count, sums: what a task's vectors add to each entry that they use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [Codebook(b) for b in books]
        width = books[0].shape[1]
        sums = np.zeros((len(books), len(books[0]), width), object)
        counts = np.zeros((len(books), len(books[0])), np.int64)
        for b in batches:
            if b.num_rows:
                x = unpacked(b.column(0), width * len(books))
                for p, rule in enumerate(rules):
                    part = x[:, p * width : (p + 1) * width]
                    at, _ = rule.nearest(part)
                    own = np.zeros((len(rule.entries), width), part.dtype)
                    np.add.at(own, at, part)
                    sums[p] += own
                    counts[p] += np.bincount(at, minlength=len(rule.entries))
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array([[str(v) for v in r] for r in sums[p, e]], pa.list_(pa.string()))], ["part", "entry", "count", "sums"])

    return run


def _coded(books: list[np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [Codebook(b) for b in books]
        width = books[0].shape[1]
        for b in batches:
            if b.num_rows:
                x = unpacked(b.column(2), width * len(books))
                found = [rule.nearest(x[:, p * width : (p + 1) * width]) for p, rule in enumerate(rules)]
                error = [sum(int(v) for v in row) for row in zip(*(f[1] for f in found))]
                codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([e if e <= _LONG else None for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> tuple[DataFrame, list[np.ndarray]]:
    """From vec_id, embedding and label: vec_id, label, code (a byte for each part) and error (squared, over all parts); and the parts' codebooks.

    At most 256 entries, and dimensions that the parts divide.
    """
    id_kind, label_kind = vectors.schema["vec_id"].dataType.simpleString(), vectors.schema["label"].dataType.simpleString()
    out = f"vec_id {id_kind}, label {label_kind}, code binary, error long"
    kept = vectors.where(finite("embedding", dimensions)).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], out), []
    width = dimensions // parts
    start = scaled(np.array([r[0] for r in first], np.float64))
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    x = stored(kept.mapInArrow(_packed(dimensions), f"vec_id {id_kind}, label {label_kind}, x binary"))
    for _ in range(rounds):
        sums = x.select("x").mapInArrow(_totals(books), "part int, entry int, count long, sums array<string>")
        each = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
        for r in sums.groupBy("part", "entry").agg(F.sum("count").alias("count"), *each).collect():
            books[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["count"] for i in range(width)]
    coded = stored(x.mapInArrow(_coded(books), out))
    free(x)
    return coded, books


def decoded(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The vectors, as integers, that codes stand for."""
    return np.concatenate([b[codes[:, p]] for p, b in enumerate(books)], axis=1)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    # labels may be few and so a label's rows many: one row per label is joined, sent out while there are few
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).select(F.xxhash64("label").alias("_hash"), F.col("label").alias("_label"), "label_error")
    total = F.broadcast(total) if is_small(total) else total.withColumn("_hash", anew("_hash"))
    rows = coded.join(total, (F.xxhash64("label") == F.col("_hash")) & F.col("label").eqNullSafe(F.col("_label")))
    every = digest(np.concatenate([b.ravel() for b in books])) if books else None
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(every).cast("string").alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other, all distances of each; products of doubles are exact here."""
    width = DIMENSIONS // PARTS
    nearest = lambda n: f"""
n{n} AS MATERIALIZED (SELECT p, rid, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT v.p, v.rid, c.e, list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x) AS d FROM v JOIN c{n} c USING (p)) GROUP BY p, rid)"""  # noqa: E731
    moved = lambda n: f"""
m{n} AS (SELECT p, e, pos, floor(sum(val) / count(*)) AS val FROM (SELECT v.p, n.e, unnest(range({width})) AS pos, unnest(v.x) AS val FROM v JOIN n{n} n USING (p, rid)) GROUP BY p, e, pos),
c{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(l.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT p, e, list(val ORDER BY pos) AS x FROM m{n} GROUP BY p, e) l USING (p, e))"""  # noqa: E731
    rounds = ",".join(nearest(n) + "," + moved(n) for n in range(ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT unnest(range({PARTS})) AS p),
v AS MATERIALIZED (SELECT p, rid, x[p * {width} + 1 : p * {width} + {width}] AS x FROM kept, parts),
c0 AS MATERIALIZED (SELECT p, rid AS e, x FROM v WHERE rid < {ENTRIES}),{rounds},{nearest(ROUNDS)},
books AS (SELECT sha256(string_agg(CAST(CAST(val AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, pos)) AS h FROM (SELECT p, e, unnest(range({width})) AS pos, unnest(x) AS val FROM c{ROUNDS})),
coded AS (SELECT rid, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (rid), books
"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
SQL = {"op12_vector_codes": _sql()}
