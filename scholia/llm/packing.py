"""Packing of tokenized documents into sequences of at most CAPACITY tokens, by minimum bin slack.

A document's tokens are its text's, as a public tokenizer gives them, and an end token. Only documents longer than a sequence are cut,
into whole sequences and a rest. What is then packed are lengths, of which there are at most CAPACITY different ones: the plan is made
from a table of how many pieces have each length, which is as small for any corpus. For one sequence after the other, a dynamic
program over sets of reachable sums, held as the bits of one integer, finds the fullest combination of lengths that are left; it is
taken as often as the counts allow, and removed. Among equally full combinations one with the longest piece that is left is taken. Where
no length fills the gaps, this leaves the long pieces for the end; so a second plan takes the fullest combination with the longest piece
that is left, and the one of fewer sequences counts.

Spark then deals pieces to the plan: a piece's number among those of its length is its place in its input partition, counted while
tokens are made, and a sum over the partitions before; the plan's slots are searched for that number. No length's pieces are ever gathered.
The pieces are written to the shared folder, since they are read twice; of a retried task only one result counts.

White space parts words for the tokenizer, so words are tokenized once while they are remembered, and texts are taken in stretches: a
task holds one batch of texts and the words it remembers. Null counts as empty: its document is the end token alone. Rows repeated
and null ids are documents like any other; columns other than doc_id and text are not read. A table without rows gives none.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.llm.common import stored, table

CAPACITY, END = 4096, 1
#: Bytes of an output batch, bytes of text that are taken at a time, bytes of words that a task remembers, and a word's beside its letters.
BATCH_BYTES, STRETCH, MEMORY, ENTRY = 8 << 20, 8 << 20, 256 << 20, 200
_BLANK = re.compile(r"[ \t\n\r\f\v]")
#: Fixed value: how the tokenizer whose file has this pattern parts words. For visible ASCII in lower case the shorter one is the same.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_ASCII = re.compile(r"[!-~]+")


class Words:
    """Token ids of texts, as little-endian 32-bit numbers, for a tokenizer that drops white space and never joins what it parts.

    Words are cut into the tokenizer's own parts, and both are remembered: parts of visible ASCII by their name, as each is a word of the
    same ids, others behind a blank. All are forgotten when they take more than MEMORY bytes.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        split = (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.easy = split == PATTERN and [n["type"] for n in (file["normalizer"] or {}).get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in file["added_tokens"]) or "(?!)")
        self.known: dict[str, bytes] = {}
        self.size = 0

    @staticmethod
    def of(path: str) -> Words:
        """The words that a Python worker remembers from task to task."""
        import tokenizers

        shared = tokenizers.__dict__.setdefault("_remembered_words", {})  # a module's, since this class travels with each task
        if path not in shared:
            shared[path] = Words(path)
        return shared[path]

    def _part(self, key: str, part: str) -> bytes:
        ids = [t.id for t in self.tokenizer.model.tokenize(part)]
        self.known[key] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _learn(self, words: list[str]) -> None:
        self.size += sum(map(len, words))
        known, get, hard, whole = self.known, self.known.get, [], []
        for w in words:
            if "<" in w and self.special.search(w):
                whole.append(w)
            elif self.easy and _ASCII.fullmatch(w):
                parts = _ASCII_PATTERN.findall(w.lower())
                known[w] = b"".join([get(p) or self._part(p, p) for p in parts]) if len(parts) > 1 else get(parts[0]) or self._part(parts[0], parts[0])
            elif self.easy and w.split() == [w]:
                hard.append(w)
            else:
                whole.append(w)  # with white space that is not ASCII, perhaps
        text = self.tokenizer.normalizer.normalize_str(" ".join(hard)) if hard else ""
        ends = np.cumsum([len(w) + 1 for w in text.split(" ")])
        if len(ends) != len(hard):  # what the tokenizer takes for white space, and Python doesn't
            whole += hard
        else:
            parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            at = ends.searchsorted(np.array([start for _, (start, _) in parts], np.int64), "right")
            found: list[list[bytes]] = [[] for _ in hard]
            for i, (part, _) in zip(at.tolist(), parts):
                found[i].append(get(key := " " + part) or self._part(key, part))
            known.update(zip(hard, map(b"".join, found)))
        for w, e in zip(whole, self.tokenizer.encode_batch(whole, add_special_tokens=False) if whole else ()):
            known[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and end among them. A word's occurrences are counted by Arrow and filled in by numpy."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.known.get, different))
        if None in got:
            self._learn([w for w, ids in zip(different, got) if ids is None])
            got = list(map(self.known.__getitem__, different))
        code = coded.indices.to_numpy(zero_copy_only=False)
        size = np.array(list(map(len, got)), np.int64) // 4
        pool = np.frombuffer(b"".join(got), "<u4")
        each = size[code]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
        ids = pool[np.repeat((np.cumsum(size) - size)[code] - ends[:-1], each) + np.arange(ends[-1])]
        if self.size + ENTRY * len(self.known) > MEMORY:
            self.known, self.size = {}, 0
        offsets = words.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]


def stretches(text: str) -> list[str]:
    """The text in parts of about STRETCH characters, parted at white space."""
    out, start = [], 0
    while len(text) - start > STRETCH and (at := _BLANK.search(text, start + STRETCH)):
        out.append(text[start : at.start()])
        start = at.end()
    return [*out, text[start:]]


def tokens(words: Words, texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's ids. Texts are taken together up to STRETCH bytes, longer ones in stretches."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // STRETCH
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-2))
    for a, b in zip(edges, edges[1:]):
        for i, j in ((a, b - 1), (b - 1, b)):  # the last text of a group may be a long one
            if j - i == 1 and sizes[i] > STRETCH:
                yield np.concatenate([words(pa.array([s]))[0] for s in stretches(texts[int(i)].as_py())])
            elif j > i:
                ids, ends = words(texts.slice(i, j - i))
                yield from np.split(ids, ends[1:-1])


def _pieces(tokenizer: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(tokenizer)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in batches:
            rows, out, size = [], [], 0

            def flush() -> pa.RecordBatch:
                columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[k] for o in out], pa.int64()) for k in (1, 2)), pa.array([o[3] for o in out], pa.binary()), pa.array([part] * len(out), pa.int32()), pa.array([o[4] for o in out], pa.int64())]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

            for row, ids in enumerate(tokens(words, b.column(1).cast(pa.string()).fill_null(""))):
                ids = np.append(ids, np.uint32(end)).astype("<u4", copy=False)
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity].tobytes()
                    n = len(own) // 4
                    rows.append(row)
                    out.append((piece, start, n, own, seen[n]))
                    seen[n] += 1
                    size += len(own)
                    if size > BATCH_BYTES:
                        yield flush()
                        rows, out, size = [], [], 0
            if out:
                yield flush()

    return run


def pieces(docs: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (32-bit little-endian), part, nth: the pieces, and which of its length each is in its partition."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end, capacity), f"doc_id {kind}, piece int, start long, length long, ids binary, part int, nth long"))


def fullest(counts: dict[int, int], capacity: int, first: int = 0) -> list[int]:
    """The lengths, with repeats, of the fullest combination of those counted that fits; `first` is in it anyway. Longer ones come first.

    Bit s of a number says that a sum s can be reached. A length's count is taken as bundles of 1, 2, 4, ... pieces.
    """
    reach = 1 << first
    full, most = (1 << capacity + 1) - 1, 1 << capacity
    steps: list[tuple[int, int]] = []  # the sums reached before a bundle, and its tokens with its length
    bundles: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        left, bundle = min(counts[length] - (length == first), (capacity - first) // length), 1
        while left > 0 and not reach & most:
            take = min(bundle, left)
            steps.append((reach, take * length))
            bundles.append((length, take))
            reach |= reach << take * length & full
            left -= take
            bundle *= 2
        if reach & most:
            break
    total, out = reach.bit_length() - 1, [first] if first else []
    for (before, tokens), (length, take) in zip(reversed(steps), reversed(bundles)):
        if not before >> total & 1:
            out += [length] * take
            total -= tokens
    return sorted(out, reverse=True)


@dataclass
class Plan:
    """Slots: pieces number low to high - 1 of a length go to `each` at a time to the sequences from `sequence` on, the first at `offset`."""

    length: np.ndarray
    low: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.low, self.length))
        start = np.searchsorted(self.length[order], length)
        out = np.empty(len(length), np.int64)
        for n in np.unique(length):  # of a batch
            at = np.flatnonzero(length == n)
            end = np.searchsorted(self.length[order], n, "right")
            out[at] = start[at[0]] + np.searchsorted(self.low[order][start[at[0]] : end], number[at], "right") - 1
        slot = order[out]
        beyond = number - self.low[slot]
        return self.sequence[slot] + beyond // self.each[slot], self.offset[slot] + beyond % self.each[slot] * length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The better of two rules: always the fullest combination, or always the fullest with the longest piece that is left."""
    return min((_plan(counts, capacity, rule) for rule in (False, True)), key=lambda p: p.sequences)


def _plan(counts: dict[int, int], capacity: int, seeded: bool) -> Plan:
    """Minimum bin slack over counted lengths: at most some thousands of combinations, each taken as often as it can be."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    slots, sequence = [], 0
    while left:
        longest = max(left)
        found = fullest(left, capacity, longest)
        if sum(found) < capacity and not seeded:
            other = fullest(left, capacity)
            found = other if sum(other) > sum(found) else found
        lengths, each = np.unique(found, return_counts=True)
        times = min(left[n] // c for n, c in zip(lengths.tolist(), each.tolist()))
        offset = 0
        for n, c in zip(lengths[::-1].tolist(), each[::-1].tolist()):
            slots.append((n, used[n], sequence, c, offset))
            offset += n * c
            used[n] += times * c
            left[n] -= times * c
            if not left[n]:
                del left[n]
        sequence += times
    columns = np.array(slots, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=sequence)


def _placed(made: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, length = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("number", "length"))
            sequence, offset = made.place(length, number)
            keep = b.drop_columns(["number"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(sequence), pa.array(offset)], [*keep.schema.names, "sequence_id", "offset"])

    return run


def placed(made: DataFrame, *columns: str, capacity: int = CAPACITY) -> DataFrame:
    """From pieces(): length and these columns of each piece, its sequence_id, and its offset there. Other columns aren't shuffled."""
    by_part = stored(made.groupBy("length", "part").agg(F.count("*").alias("c")))
    counts = {r["length"]: r["c"] for r in by_part.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    before = F.sum("c").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    rows = made.select("length", "part", "nth", *columns).join(before, ["length", "part"]).select("length", *columns, (F.col("before") + F.col("nth")).alias("number"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("number").schema)
    return rows.mapInArrow(_placed(plan(counts, capacity)), f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: every piece of every document and its place."""
    return placed(pieces(docs, tokenizer, end, capacity), "doc_id", "piece", "start", "ids", capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (32-bit little-endian), lengths: the sequences themselves, each of at most the capacity."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "length"))).alias("_of"))
    return rows.select("sequence_id", F.expr("aggregate(_of.ids, x'', (a, b) -> a || b)").alias("ids"), F.col("_of.length").alias("lengths"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    rows = placed(made.withColumn("ids_crc32", F.crc32("ids")), "doc_id", "piece", "start", "ids_crc32")
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op13_packing": op13_packing}
SQL: dict[str, str] = {}
