"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scholia.durable import broadcast_if_small


def normalized(v: Column) -> Column:
    """The vector over its length plus 1e-10, as doubles."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + F.lit(1e-10)
    return F.transform(v, lambda x: x.cast("double") / length)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(squared: Column) -> Column:
    return 1 / (1 + squared)


def _packed(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Blocks (dim, keys, matrix) of up to `size` vectors of one dimension, in the partitions in which they stand; null vectors are left out."""
    kind = to_arrow_type(rows.schema[key].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            keys, parts = held.pop(dim)
            matrix = pa.array([np.array(parts, np.float64).tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([keys], pa.list_(kind)), matrix], ["dim", "keys", "matrix"])

        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if v is not None:
                    keys, parts = held.setdefault(len(v), ([], []))
                    keys.append(k)
                    parts.append([np.nan if x is None else x for x in v])
                    if len(keys) == size:
                        yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return rows.select(key, vector).mapInArrow(pack, f"dim int, keys array<{rows.schema[key].dataType.simpleString()}>, matrix binary")


#: Query blocks are broadcast up to so many bytes.
SMALL_BYTES = 64 << 20


def top_k(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 512, chunk: int = 4096) -> DataFrame:
    """query, key, distance (squared), rank: the k nearest of all vectors to each query vector, exactly.

    A stated query set against all rows: queries are packed into blocks of `block` vectors and the others into blocks of `chunk`, where
    they stand. Each pair of blocks is a matrix product in a task, which keeps k rows per query. The blocks of queries are broadcast if
    they hold at most SMALL_BYTES; beyond, Spark deals out pairs of partitions. Ties go to the least key. Filter the vectors before, never
    after. Rows without a vector, or of another dimension than the query's, are left out.
    """
    kind, qkind = (f.schema[key].dataType.simpleString() for f in (vectors, queries))
    key_type, query_type = (to_arrow_type(f.schema[key].dataType) for f in (vectors, queries))
    asked = _packed(queries, key, vector, block).toDF("qdim", "qkeys", "qmatrix")
    size = queries.agg(F.coalesce(F.sum(F.size(vector).cast("long") * 8), F.lit(0))).first()[0]
    pairs = _packed(vectors, key, vector, chunk).crossJoin(F.broadcast(asked) if size <= SMALL_BYTES else asked).where("dim = qdim")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, keys, matrix, qkeys, qmatrix in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4, 5))):
                x, q = (np.frombuffer(m, np.float64).reshape(-1, dim) for m in (matrix, qmatrix))
                rough = (q * q).sum(1)[:, None] - 2 * (q @ x.T) + (x * x).sum(1)[None, :]
                slack = 1e-9 * (1 + (q * q).sum(1).max(initial=0) + (x * x).sum(1).max(initial=0))
                out = []
                for n, near in enumerate(rough):
                    edge = np.partition(near, k - 1)[k - 1] + slack if len(near) > k else np.inf
                    at = np.flatnonzero(near <= edge)  # a few more than k; their distances are computed anew
                    d = ((x[at] - q[n]) ** 2).sum(1)
                    out += [(qkeys[n], keys[i], e) for e, i in sorted(zip(d.tolist(), at.tolist()), key=lambda z: (z[0], keys[z[1]]))[:k]]
                if out:
                    a, c, d = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, query_type), pa.array(c, key_type), pa.array(d, pa.float64())], ["query", key, "distance"])

    found = pairs.mapInArrow(nearest, f"query {qkind}, `{key}` {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def evidence(sections: DataFrame, hits: DataFrame, section: str, category: str, score: str, key: str, per_section: int = 8) -> DataFrame:
    """For each section the best hits among its categories. `sections` (section, categories) is broadcast if it is short."""
    of = sections.select(section, F.explode("categories").alias(category))
    ranked = hits.join(broadcast_if_small(of), category).groupBy(section, key).agg(F.max(score).alias(score))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(section).orderBy(F.desc(score), key))).where(F.col("rank") <= per_section)
