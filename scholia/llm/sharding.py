"""Sharding by extendible hashing, with DataFrame operations alone.

Documents are hashed; a bucket is a prefix of the hash's bits. The directory starts at one bucket, and each round splits the
buckets above the byte limit, and no others, on one more bit, until every shard fits. Rounds read a histogram over prefixes of
the hash, not the documents: these are read once for their total, once for the histogram, and once to be assigned. Only if a
bucket must split beyond the histogram's bits are the sizes of that bucket's own documents read, once for all such buckets.
The directory is indexed by the histogram's prefixes: a document looks up its own, and in it, where buckets are finer, the one
of which the range of hashes holds its own.

Size is the UTF-8 length of the text; null counts as 0 bytes. What no bit can part: a document above the limit has a shard of
its own (``fits`` is false), and rows repeated in id and text so often that together they exceed the limit are dealt to
shards ``<bits>-<n>`` by counts per input partition. Columns added to whole documents are shard columns only; an input column
of such a name is replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.llm.common import cut, table

LIMIT = 64 << 20
HASH_BITS = 60
#: The directory is broadcast up to this many rows of six numbers; beyond, it is joined on the prefix, which is uniform.
BROADCAST_ROWS = 1 << 17
SHARD_COLUMNS = ("shard", "shard_depth", "shard_bytes", "shard_docs", "fits")


def size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def hashed(doc_id: Column, text: Column) -> Column:
    """60 bits of a digest of id and text."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, HASH_BITS - bits)


def _histogram(rows: DataFrame, key: Column) -> DataFrame:
    """p (prefix or hash), low, high (the least and the greatest hash of p), bytes, docs."""
    return rows.groupBy(key.alias("p")).agg(F.min("h").alias("low"), F.max("h").alias("high"), F.sum("n").alias("bytes"), F.count("*").alias("docs"))


def _split(counts: DataFrame, bits: int, depth: int, last: int, limit: int) -> tuple[list[DataFrame], DataFrame]:
    """Splits all buckets of `depth` bits bit by bit, as far as `last`: the shards found, and the counts of buckets that are still too large.

    counts: p (of `bits` bits), low, high, bytes, docs. A bucket of a single hash is a shard whatever its size.
    """
    done = []
    while True:
        bucket = F.shiftright("p", bits - depth)
        sums = counts.groupBy(bucket.alias("bucket")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("low").alias("low"), F.max("high").alias("high"))
        sums = cut(sums)
        fits = (F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high"))
        done.append(sums.where(fits).select("bucket", F.lit(depth).alias("shard_depth"), "shard_bytes", "shard_docs"))
        large = sums.where(~fits).select(F.col("bucket").alias("_bucket"))
        if large.isEmpty():
            return done, counts.limit(0)
        counts = cut(counts.join(large, bucket == F.col("_bucket"), "left_semi"))
        if depth == last:
            return done, counts
        depth += 1


def directory(rows: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, int]:
    """From rows (h, n): slot (prefix of the directory's bits), shard_depth, shard_bytes, shard_docs, first, last (hashes); and the directory's bits.

    A shard of fewer bits than the directory stands in several slots, a slot with a shard of more bits holds several shards.
    """
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(total / limit, 1)))) + 3)
    counts = cut(_histogram(rows, prefix(F.col("h"), bits)))
    done, large = _split(counts, bits, 0, bits, limit)
    if bits < HASH_BITS and not large.isEmpty():
        slots = large.select(F.col("p").alias("_p"))
        own = rows.join(F.broadcast(slots) if slots.count() <= BROADCAST_ROWS else slots, prefix(F.col("h"), bits) == F.col("_p"), "left_semi")
        more, _ = _split(cut(_histogram(own, F.col("h"))), HASH_BITS, bits + 1, HASH_BITS, limit)
        done += more
    shards = cut(reduce(DataFrame.unionByName, done))
    shards = shards.select("*", F.expr(f"shiftleft(bucket, {HASH_BITS} - shard_depth)").alias("first"), F.expr(f"shiftleft(bucket + 1, {HASH_BITS} - shard_depth) - 1").alias("last"))
    slot = F.sequence(prefix(F.col("first"), bits), prefix(F.col("last"), bits))
    return cut(shards.select(F.explode(slot).alias("slot"), "shard_depth", "shard_bytes", "shard_docs", "first", "last")), bits


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The documents with SHARD_COLUMNS: the shard's bits (or bits-n), their number, the shard's bytes and rows."""
    own = [c for c in docs.columns if c not in SHARD_COLUMNS]
    keyed = docs.select(F.struct(*(f"`{c}`" for c in own)).alias("row"), hashed(F.col("doc_id"), F.col("text")).alias("h"), size(F.col("text")).alias("n"))
    found, bits = directory(keyed.select("h", "n"), limit)
    small = found.count() <= BROADCAST_ROWS
    same = (prefix(F.col("h"), bits) == F.col("slot")) & F.col("h").between(F.col("first"), F.col("last"))
    rows = keyed.join(F.broadcast(found) if small else found, same)
    name = F.expr(f"CASE WHEN shard_depth = 0 THEN '' ELSE lpad(bin(shiftright(h, {HASH_BITS} - shard_depth)), shard_depth, '0') END")
    rows = rows.withColumn("shard", name)
    if not found.where((F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)).isEmpty():
        rows = _deal_repeats(rows, limit)
    return rows.withColumn("fits", F.col("shard_bytes") <= limit).select(*(F.col("row")[c].alias(c) for c in own), *SHARD_COLUMNS)


def _deal_repeats(rows: DataFrame, limit: int) -> DataFrame:
    """Deals the rows of each shard that holds too many repeats of one document to shards of as many as fit.

    Repeats are numbered by their input partition and their place in it: the windows hold one partition's share of the
    repeats, or one row per partition.
    """
    crowded = (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
    part = cut(rows.where(crowded).withColumn("part", F.spark_partition_id()))
    counts = part.groupBy("shard", "part").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy(F.lit(1))) - 1
    dealt = part.withColumn("place", place).join(before.drop("c"), ["shard", "part"])
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n"), F.lit(1))))
    number = F.floor((F.col("place") + F.col("before")) / each)
    held = F.least(each, F.col("shard_docs") - number * each)
    dealt = dealt.withColumn("number", number).withColumn("held", held)
    dealt = dealt.withColumn("shard", F.concat_ws("-", "shard", F.col("number").cast("string"))).withColumn("shard_docs", F.col("held")).withColumn("shard_bytes", F.col("held") * F.col("n"))
    return rows.where(~crowded).unionByName(dealt.select(*rows.columns))


def write(sharded: DataFrame, path: str) -> None:
    """One folder per shard; each shard's rows meet in one task, within the limit."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


def _digest(docs: DataFrame, limit: int) -> DataFrame:
    return assign(docs.select("doc_id", "text"), limit).select("doc_id", size(F.col("text")).alias("n_bytes"), *SHARD_COLUMNS)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(table(spark, sf_dir, "documents"), LIMIT)


#: The limit of a query that splits on small tables, too; some of their documents are above it.
SMALL_LIMIT = 32 << 10


def small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator at a limit that tables of few megabytes exceed many times."""
    return _digest(table(spark, sf_dir, "documents"), SMALL_LIMIT)


def _sql(limit: int) -> str:
    """Sums of all buckets at all depths; a document's shard is its least bucket that fits or can't be parted. Repeats beyond the limit are not dealt."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
x AS (SELECT *, unnest(range(0, {HASH_BITS + 1})) AS depth FROM d),
b AS (SELECT *, sum(n_bytes) OVER p AS shard_bytes, count(*) OVER p AS shard_docs, min(h) OVER p AS low, max(h) OVER p AS high FROM x WINDOW p AS (PARTITION BY depth, h >> ({HASH_BITS} - depth))),
f AS (SELECT * FROM b WHERE shard_bytes <= {limit} OR low = high QUALIFY row_number() OVER (PARTITION BY rid ORDER BY depth) = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> ({HASH_BITS} - depth)), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS shard_depth,
  CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_docs AS BIGINT) AS shard_docs, shard_bytes <= {limit} AS fits FROM f
"""


QUERIES = {"op5_sharding": op5_sharding, "small_shards": small_shards}
SQL = {"op5_sharding": _sql(LIMIT), "small_shards": _sql(SMALL_LIMIT)}
