"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.durable import cut, free, stored  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of everything that is not ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def anew(key: str) -> Column:
    """The key as a number by which Spark doesn't know the rows to be dealt out already.

    A join of an aggregate by this key deals out both of its sides, and Spark can then split a hot key on the other side.
    """
    return F.col(key).bitwiseXOR(F.lit(0))


#: Pairs that a task of a round of `components` writes, on average, at most.
ROUND_ROWS = 200_000


class Forest:
    """Union-find over numbers below n, fed with arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            new = a != b
            a, b = a[new], b[new]
            if not len(a):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if both:
        names, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*both)]), return_inverse=True)
        forest = Forest(len(names))
        forest.join(*np.split(at, 2))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[forest.root])], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """Connected components of an undirected edge list of longs: (node, root), root being the least node reachable.

    Alternating large-star and small-star rounds; each node's neighbours are only aggregated and joined, never
    gathered, and every round is checkpointed, so that a lost executor costs one round at most. Null ends and loops
    are ignored; an empty edge list gives an empty result. As soon as a list has at most `few` pairs, one task joins them.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    count = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = count(pairs)
    while before[0] > few:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(anew("u").alias("_u"), "m")
        # large star: every greater neighbour of u goes to the least of u and its neighbours
        large = both.where("v > u").join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(anew("u").alias("_u"), "m")
        small = large.join(low, F.col("u") == F.col("_u")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        pairs = cut(small.coalesce(max(1, math.ceil(before[0] / ROUND_ROWS))))  # pairs never become more
        now = count(pairs)
        if now == before:
            break
        before = now
    else:
        return pairs.coalesce(1).mapInArrow(_joined, "node long, root long")
    roots = pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
