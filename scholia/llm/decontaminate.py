"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words joined by single spaces. An item of m characters may be found with up to
m // BUDGET edits; cut into one piece more than that, at least one piece must be unharmed wherever the item is found. All
pieces are searched at once by an Aho-Corasick automaton, and the hits are verified by Myers' bit-parallel distance over the
stretch of text around them; hits of one item that put its start at places within its budget of each other share a stretch.

The benchmark is the query set, in blocks of BLOCK_BYTES on average. A benchmark of one block is searched where documents are
read, and nothing is shuffled. Of a larger one, one block at a time is read by the driver and searched in a job of its own, whose
hits are written to the shared folder; so no more than a block is held by the driver or by a task, and only hits are shuffled.

Documents are searched whole. Null and empty texts match nothing. Items of under MIN_CHARS characters are matched without edits,
as whole words; wordless items are ignored, and so are items without an id, but for `clean`, which has no use for ids. Rows
repeated are searched row by row; only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import stored, table

BUDGET, MIN_CHARS = 20, 30
#: The items of a block are sent to the executors with its search; a block has so many bytes of text at most, on average.
BLOCK_BYTES = 4 << 20
HITS = "array<struct<item_id:bigint,distance:int>>"
_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget(item: str) -> int:
    return len(item) // BUDGET if len(item) >= MIN_CHARS else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item in k + 1 pieces of nearly equal length, with their offsets."""
    cuts = [round(i * len(item) / (k + 1)) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, k: int) -> int:
    """The least edit distance of the pattern to any substring of the text, or k + 1 if it is above k."""
    m, masks = len(pattern), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        best = min(best, score)
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may start anywhere: no carry into the lowest bit
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return min(best, k + 1)


class Matcher:
    """Finds the items of a block: a list of (item_id, normal text)."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items, self.automaton, places = items, ahocorasick.Automaton(), {}
        for n, (_, item) in enumerate(items):
            if len(item) < MIN_CHARS:
                item = f" {item} "
            for offset, piece in pieces(item, budget(item)):
                places.setdefault(piece, []).append((n, offset))
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[dict]:
        """The items found and their least distances, by item_id."""
        text, found, starts = f" {normal(text)} ", {}, {}
        for end, (length, at) in self.automaton.iter(text) if len(self.items) and len(text) > 2 else ():
            for n, offset in at:
                starts.setdefault(n, []).append(end - length + 1 - offset)
        for n, places in starts.items():
            number, item = self.items[n]
            k = budget(item)
            for first, last in _close(places, k) if k else [(places[0], places[0])]:
                if found.get(number) == 0:
                    break
                stretch = text[max(0, first - k) : last + len(item) + k]
                d = 0 if k == 0 or item in stretch else myers(item, stretch, k)
                if d <= k and d < found.get(number, k + 1):
                    found[number] = d
        return [{"item_id": i, "distance": d} for i, d in sorted(found.items())]


def _close(places: list[int], k: int) -> list[tuple[int, int]]:
    """The first and last of each run of places that are at most k apart."""
    runs: list[tuple[int, int]] = []
    for p in sorted(set(places)):
        if runs and p - runs[-1][1] <= k:
            runs[-1] = runs[-1][0], p
        else:
            runs.append((p, p))
    return runs


def _search(items: list[tuple[int, str]]):
    @F.pandas_udf(HITS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items)
        for texts in batches:
            yield pd.Series([matcher.find(t) for t in texts], dtype=object)

    return search


def _block(items: DataFrame, number: int, blocks: int) -> list[tuple[int, str]]:
    part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number).collect()
    return sorted({(i, w) for i, t in part if (w := normal(t))})


def matched(docs: DataFrame, benchmark: DataFrame, nameless: bool = False) -> DataFrame:
    """row (the documents' columns) and m, the items found in its text: array of (item_id, distance). Items without an id count as -1, if at all."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.fillna(-1, ["item_id"]) if nameless else items.where(F.col("item_id").isNotNull())
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    if blocks == 1:
        return rows.select("row", _search(_block(items, 0, 1))(F.col("t")).alias("m"))
    keyed = rows.select("id", F.xxhash64("t").alias("key"), "t")
    hits = [stored(keyed.select("id", "key", _search(_block(items, n, blocks))(F.col("t")).alias("m")).where(F.size("m") > 0)) for n in range(blocks)]
    hits = reduce(DataFrame.unionByName, hits).groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.flatten(F.collect_list("m")).alias("m"))
    found = rows.join(hits, F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("t") == F.col("_key")), "left")
    return found.select("row", F.coalesce("m", F.expr(f"CAST(array() AS {HITS})")).alias("m"))


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (array), distance (the least, null if clean): one row per input row."""
    rows = matched(docs.select("doc_id", "text"), benchmark).select(F.col("row.doc_id").alias("doc_id"), "m")
    ids = F.array_sort(F.array_distinct(F.transform("m", lambda x: x["item_id"])))
    return rows.select("doc_id", (F.size("m") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.array_min(F.transform("m", lambda x: x["distance"])).alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, whole rows, in which no item is found."""
    rows = matched(docs, benchmark, nameless=True).where(F.size("m") == 0)
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
SQL: dict[str, str] = {}
