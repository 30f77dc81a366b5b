"""Repeated passages by a run-length index: removes every byte that a LENGTH-byte string which also starts elsewhere covers.

A suffix index of the whole corpus in one task would not scale, so the windows of LENGTH bytes are first dealt out. Each
window has an anchor, the least hash of its SEED_BYTES-byte strings; the anchor depends on the window's content alone, so equal
windows have equal anchors. Windows with the same anchor in a row form a segment, of under 2 * LENGTH bytes. From there on:

* anchors that occur once can hold no repeat and are dropped; they are counted by a map-side combined aggregate;
* segments that are equal as a whole (128-bit digest) are one text of the index, told to have copies: their suffixes would stand side
  by side with equal symbols before them, in one run. What is found in it is joined back to all of them, never gathered;
* the distinct segments are dealt by anchor to buckets of about BUCKET_BYTES. Each bucket's text gets a run-compressed
  Burrows-Wheeler transform with the suffix positions sampled at run ends, and the matching statistics of the text against the
  rest of itself are streamed from those samples: the longest match of a position is that of the sample before it, less the
  distance to it, so only one common prefix per run is ever compared. Windows that start at a match of LENGTH or more are repeats;
* an anchor with over CROWD distinct segments (a passage with thousands of surroundings) would make one bucket too large. Its segments
  are cut into stretches of WIDTHS[0] windows, aligned by the anchor: equal stretches are repeats, and a stretch goes on to be cut finer
  only if others share its core, the bytes that all its windows have. The last width is one window, so the results are the same. This
  route compares digests and has no index: it is the exact way for anchors that no task could hold.

Texts are UTF-8 bytes; null counts as empty. Matches never cross documents. Rows repeated in id and text are documents of their own,
and so repeat each other; their segments are counted in every row, but fetched from one. Only doc_id and text of the input are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from scholia.durable import broadcast_if_small
from scholia.llm.common import anew, free, stored, table

LENGTH, SEED_BYTES = 400, 64
BUCKET_BYTES, CROWD, WIDTHS = 1 << 20, 1024, (64, 8, 1)
#: Texts of a batch are hashed together, up to so many bytes; longer ones are taken in pieces.
CHUNK = 4 << 20
_PLACE = np.uint64((1 << 28) - 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)])) if n else np.ones(0, np.uint64)


_BYTES = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED_BYTES bytes from each place on."""
    n = len(data)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers(_INVERSE, n), dtype=np.uint64)])
    return _mix((sums[SEED_BYTES:] - sums[:-SEED_BYTES]) * _powers(_BASE, n - SEED_BYTES + 1))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = len(values) - width + 1
    rows = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text of LENGTH bytes or more: its number, and its segments' first window, windows, anchor, and the anchor's distance.

    A text of over CHUNK bytes comes in pieces, the windows of which follow upon each other.
    """
    group: list[tuple[int, int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        for start in range(0, len(t) - LENGTH + 1, CHUNK):
            end = min(start + CHUNK + LENGTH - 1, len(t))
            if group and size + end - start > CHUNK:
                yield from _segments(texts, group)
                group, size = [], 0
            group.append((i, start, end))
            size += end - start
    if group:
        yield from _segments(texts, group)


def _segments(texts: list[bytes], group: list[tuple[int, int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data = np.frombuffer(b"".join([texts[i][a:b] for i, a, b in group]), np.uint8)
    hashes = seed_hashes(data)
    places = (_least((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), LENGTH - SEED_BYTES + 1) & _PLACE).astype(np.int64)
    start = 0
    for i, a, b in group:
        own = places[start : start + b - a - LENGTH + 1]
        first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        yield i, first + a, np.diff(np.append(first, len(own))), hashes[own[first]], own[first] - start - first
        start += b - a


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
        at, out, size = [], [], 0

        def flush() -> pa.RecordBatch:
            rows = np.repeat(at, [len(o[0]) for o in out])
            lo, n, off, anchor, digest = (np.concatenate(x) for x in zip(*out))
            columns = [ids.take(pa.array(rows)), pa.array(keys[rows]), *(pa.array(x.astype(np.int32)) for x in (lo, n, off)), pa.array(anchor.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "lo", "n", "off", "anchor", "s1", "s2"])

        for i, lo, n, anchor, off in segments(texts):
            t = texts[i]
            digests = b"".join([xxh3_128_digest(t[a : a + c + LENGTH - 1]) for a, c in zip(lo.tolist(), n.tolist())])
            at.append(i)
            out.append((lo, n, off, anchor, np.frombuffer(digests, np.int64).reshape(-1, 2)))
            size += len(lo)
            if size > 50_000:
                yield flush()
                at, out, size = [], [], 0
        if out:
            yield flush()


def _order(high: np.ndarray, low: np.ndarray | None, bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows by high, then low (numbers of `bits` bits): their order, and where it comes to other numbers than before.

    Where number and row fit 64 bits together they are sorted as one number, which is several times faster than an order alone.
    """
    key = high if low is None else high << np.uint64(width) | low
    n = len(key)
    place = max(n - 1, 1).bit_length()
    if bits + place <= 64:
        both = np.sort(key << np.uint64(place) | np.arange(n, dtype=np.uint64))
        order, key = (both & np.uint64((1 << place) - 1)).astype(np.int64), both >> np.uint64(place)
    else:
        order = np.argsort(key)
        key = key[order]
    return order, np.concatenate([np.ones(min(n, 1), bool), key[1:] != key[:-1]])


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Sorts all suffixes of numbers below 256 by doubling; only suffixes that still tie are sorted again."""
    n, h = len(data), 5
    wide = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(h, np.uint64)])  # an end sorts first
    key = np.zeros(n, np.uint64)
    for i in range(h):
        key = key * np.uint64(257) + wide[i : n + i]
    order, apart = _order(key, None, 41, 0)
    rank = np.zeros(n + 1, np.uint32)  # from 1; 0 for what is past the end
    todo, at, width = np.arange(n), order, max(n, 1).bit_length()
    while True:
        rank[at] = np.maximum.accumulate(np.where(apart, todo, 0)) + 1
        again = ~(apart & np.append(apart[1:], True))
        todo, at = todo[again], at[again]
        if not len(todo):
            return order
        by, apart = _order(rank[at].astype(np.uint64), rank[np.minimum(at + h, n)].astype(np.uint64), 2 * width, width)
        at = at[by]
        order[todo] = at
        h *= 2


class RunIndex:
    """The runs of a text's Burrows-Wheeler transform, with suffix positions at their ends: three numbers a run, however long the text.

    first[i] is the suffix at the start of run i and last[i] the one before it in suffix order, the end of run i - 1; longest[i] is
    their common prefix, or 0 if that is shorter than LENGTH.
    """

    def __init__(self, data: np.ndarray) -> None:
        order = suffix_array(data)
        before = np.where(order > 0, data[order - 1].astype(np.int16), -1)
        heads = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.size = len(data)
        self.first, self.last = order[heads], order[heads - 1]
        self.longest = common_prefixes(data, self.first, self.last)

    def statistics(self) -> np.ndarray:
        """For each position of the text the longest match that also starts elsewhere, streamed from the samples in the order of the text.

        A position between samples matches its neighbour in suffix order by one less than the position before it: both go on with
        the same run. So its match ends where that of the sample before it does, towards the suffix before as well as the one behind.
        """
        out = np.zeros(self.size, np.int64)
        for sample in (self.first, self.last):
            end = np.zeros(self.size, np.int64)
            end[sample] = sample + self.longest
            np.maximum(out, np.maximum.accumulate(end) - np.arange(self.size), out=out)
        return out


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, least: int = LENGTH) -> np.ndarray:
    """Lengths of the common prefixes of suffixes; 0 stands for what is shorter than `least`. Only what still agrees is compared on."""
    n, out, step = len(data), np.zeros(len(a), np.int64), 16
    words = np.concatenate([data, np.zeros(8, np.uint8)])
    live = np.flatnonzero(np.maximum(a, b) + least <= n)
    for i in range(0, least, step):  # a few bytes of each stretch weed out nearly all
        live = live[words[a[live] + i] == words[b[live] + i]]
    length = np.zeros(len(live), np.int64)
    limit = n - np.maximum(a[live], b[live])
    going = np.arange(len(live))
    while len(going):
        same = words[a[live[going]] + length[going]] == words[b[live[going]] + length[going]]
        going = going[same & (length[going] < limit[going])]
        length[going] += 1
        going = going[length[going] < limit[going]]
    out[live] = np.where(length >= least, length, 0)
    return out


def marked(parts: list[bytes], least: int = LENGTH, copied: np.ndarray | None = None) -> list[np.ndarray]:
    """For each part whether a string of `least` bytes that starts there also starts elsewhere in the parts, of which some stand for several."""
    data = np.full(sum(map(len, parts)) + len(parts), 0, np.uint16)
    at = np.cumsum([0, *(len(p) + 1 for p in parts)])
    for p, i in zip(parts, at):
        data[i : i + len(p)] = np.frombuffer(p, np.uint8).astype(np.uint16) + 1  # 0 parts the parts
    match = RunIndex(data).statistics()
    for n in np.flatnonzero(copied) if copied is not None else ():
        match[at[n] : at[n + 1] - 1] = np.maximum(match[at[n] : at[n + 1] - 1], np.arange(len(parts[n]), 0, -1))  # to the end of the part, in its copy
    found = match >= least
    return [found[i : i + max(0, len(p) - least + 1)] for p, i in zip(parts, at)]  # windows that cross a part's end don't count


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


_PLACES = ["doc_id", "key", "lo", "n", "off"]


def _search(group: pa.Table) -> pa.Table:
    """The repeated stretches of a bucket's segments."""
    found = marked(group.column("text").to_pylist(), copied=group.column("twin").to_numpy(zero_copy_only=False).astype(bool))
    rows, starts, sizes = [], [], []
    for i, flags in enumerate(found):
        for a, b in zip(*_runs(flags)):
            rows.append(i)
            starts.append(a)
            sizes.append(b - a)
    taken = group.select(["doc_id", "key", "lo", "twin", "anchor", "s1", "s2"]).take(pa.array(rows, pa.int64()))
    return taken.append_column("at", pa.array(starts, pa.int32())).append_column("n", pa.array(sizes, pa.int32()))


def _stretches(width: int):
    """Cuts segments into stretches of `width` windows by their distance from the anchor, each with digests of its core and of its bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "single", "lo", "n", "off", "text", "c1", "c2", "s1", "s2"]
        for batch in batches:
            rows, out, digests = [], [], []
            for i, (lo, off, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist())):
                n = len(text) - LENGTH + 1
                for j in range((off - n + 1) // width, off // width + 1):
                    near, far = off - j * width, off - j * width - width + 1  # places of the windows nearest to the anchor and farthest from it
                    first, last = max(far, 0), min(near, n - 1)
                    part = text[first : last + LENGTH]
                    rows.append(i)
                    out.append((lo + first, last - first + 1, off - first, part))
                    digests.append(xxh3_128_digest(text[near : far + LENGTH]) + xxh3_128_digest(part))
            at, d = pa.array(rows, pa.int64()), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 4)
            places = [pa.array([x[k] for x in out], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(4).take(at), *places, pa.array([x[3] for x in out], pa.binary()), *(pa.array(d[:, k]) for k in range(4))], names)

    return cut


def _crowded(rows: DataFrame, kind: str) -> DataFrame:
    """Repeated windows among the segments (doc_id, key, lo, off, single, text) of crowded anchors, by ever finer stretches."""
    found = None
    for width in WIDTHS:
        cut = stored(rows.select("doc_id", "key", "lo", "off", "single", "text").mapInArrow(_stretches(width), f"doc_id {kind}, key long, single boolean, lo int, n int, off int, text binary, c1 long, c2 long, s1 long, s2 long"))
        same = cut.groupBy("s1", "s2").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("doc_id", "key", "lo", "n", "off", "single", "text", "c1", "c2")))
        same = stored(same)
        twins = same.where("times > 1").select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"))
        whole = cut.where("single").join(twins, (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2"))).select("doc_id", "key", "lo", "n")
        found = whole if found is None else found.unionByName(whole)
        cores = same.groupBy("c1", "c2").agg(F.count("*").alias("kinds")).where("kinds > 1").select(anew("c1").alias("_c1"), F.col("c2").alias("_c2"))
        rows = same.join(cores, (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2"))).withColumn("single", F.col("single") & (F.col("times") == 1))
    return found


_ASKED = {"lo": pa.int32(), "off": pa.int32(), "twin": pa.bool_(), "anchor": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "crowded": pa.bool_()}


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments asked for."""
    for batch in batches:
        ids, keys = batch.column(0), batch.column(1)
        for i, (text, asked) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist())):
            n = pa.array(np.full(len(asked), i))
            parts = pa.array([text[x["lo"] : x["lo"] + x["n"] + LENGTH - 1] for x in asked], pa.binary())
            columns = [pa.array([x[c] for x in asked], kind) for c, kind in _ASKED.items()]
            yield pa.RecordBatch.from_arrays([ids.take(n), keys.take(n), *columns, parts], ["doc_id", "key", *_ASKED, "text"])


def _once_each(texts: DataFrame) -> DataFrame:
    """The texts (doc_id, key, text) with one row of those that are repeated in id and text; only such rows are shuffled."""
    again = stored(texts.groupBy("doc_id", "key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")))
    if again.isEmpty():
        return texts
    again = broadcast_if_small(again)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    return texts.join(again, same, "left_anti").unionByName(texts.join(again, same, "left_semi").dropDuplicates(["doc_id", "key"]))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), lo, n: stretches of windows (first window start, number) that also occur elsewhere."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").where(F.octet_length("text") >= LENGTH)
    every = stored(texts.mapInArrow(_cut_up, f"doc_id {kind}, key long, lo int, n int, off int, anchor long, s1 long, s2 long"))
    # in the joins below both sides have exchanges of their own (anew, stored), so that Spark can split a frequent anchor
    again = every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select(anew("anchor").alias("_anchor"))
    shared = stored(every.join(again, F.col("anchor") == F.col("_anchor")).drop("_anchor"))
    free(every)
    counted = stored(shared.groupBy("anchor", "s1", "s2").agg(F.count("*").alias("c"), *(F.first(x).alias(x) for x in _PLACES)))
    of = counted.groupBy("anchor").agg(F.count("*").alias("kinds")).select(anew("anchor").alias("_anchor"), (F.col("kinds") > CROWD).alias("crowded"))
    asked = counted.join(of, F.col("anchor") == F.col("_anchor")).select(*_PLACES, "anchor", "s1", "s2", (F.col("c") > 1).alias("twin"), "crowded")
    total = counted.agg(F.sum(F.col("n") + LENGTH)).first()[0] or 0
    by_doc = asked.groupBy("doc_id", "key").agg(F.collect_list(F.struct("n", *_ASKED)).alias("asked")).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    read = _once_each(texts).join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("doc_id", "key", "text", "asked")
    parts = stored(read.mapInArrow(_fetch, f"doc_id {kind}, key long, lo int, off int, twin boolean, anchor long, s1 long, s2 long, crowded boolean, text binary"))
    free(counted)
    dealt = parts.where("NOT crowded").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(max(1, math.ceil(total / BUCKET_BYTES)))))
    found = stored(dealt.groupBy("bucket").applyInArrow(_search, f"doc_id {kind}, key long, lo int, twin boolean, anchor long, s1 long, s2 long, at int, n int"))
    single = found.where("NOT twin").select("doc_id", "key", (F.col("lo") + F.col("at")).alias("lo"), "n")
    crowd = parts.where("crowded")
    crowds = not crowd.isEmpty()
    whole = found.where("twin").select(*(F.col(c).alias(f"_{c}") for c in ("anchor", "s1", "s2", "at", "n")))
    if crowds:
        whole = whole.unionByName(crowd.where("twin").select(*(F.col(c).alias(f"_{c}") for c in ("anchor", "s1", "s2")), F.lit(0).alias("_at"), (F.length("text") - LENGTH + 1).alias("_n")))
    same = (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("anchor") == F.col("_anchor"))
    copies = shared.join(whole, same).select("doc_id", "key", (F.col("lo") + F.col("_at")).alias("lo"), F.col("_n").alias("n"))
    out = single.unionByName(copies)
    if not crowds:
        free(parts)
    return out.unionByName(_crowded(crowd.withColumn("single", ~F.col("twin")), kind)) if crowds else out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, spans, digests = [], [], [], []
        for text, found in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            text = text or b""
            flags = np.zeros(len(text) + 1, np.int32)
            for x in found or ():
                flags[x["lo"]] += 1
                flags[x["lo"] + x["n"] + LENGTH - 1] -= 1
            gone = flags.cumsum()[:-1] > 0
            sizes.append(len(text))
            removed.append(int(gone.sum()))
            spans.append(len(_runs(gone)[0]))
            digests.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes() if found else text).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, found: each row with its stretches of repeated windows, array of (lo, n) or null."""
    docs = docs.select("doc_id", "text")
    by_doc = repeats(docs).distinct().groupBy("doc_id", "key").agg(F.collect_list(F.struct("lo", "n")).alias("found")).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    return docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left").select("doc_id", "text", "found")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_repeats(table(spark, sf_dir, "documents"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


QUERIES = {"op3_repeats": op3_repeats}
SQL: dict[str, str] = {}
