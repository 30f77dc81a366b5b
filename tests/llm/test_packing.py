"""Packed sequences against the tokenizer itself, and plans against all combinations."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scholia.llm import packing
from scholia.llm.common import table
from tests.conftest import SF
from tests.llm.conftest import DOCS

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't  'stop\x85ing ΣΑΣ", "x<|endoftext|>y <|startoftext|>", "é é ẞ İ Ã© Ã", "a\x1cb c\x1f d\x00e", " 　\xa0", "\"'s ''s 's's", "😀👍🏽 漢字かな", "ab" * 5000, "  ", "", "A1b22,c.!?", "﻿x"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def made(words, texts):
    return [ids.tolist() for ids in packing.tokens(words, pa.array(texts, pa.string()))]


def ids_of(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("memory", [packing.MEMORY, 2000])
def test_words_are_the_tokenizers(spark, tokenizer, monkeypatch, memory):
    monkeypatch.setattr(packing, "MEMORY", memory)
    texts = [r["text"] or "" for r in table(spark, SF, "documents").select("text").collect()] + ODD
    words = packing.Words(PATH)
    for _ in range(2):
        assert made(words, texts) == ids_of(tokenizer, texts)
    words.easy = False
    assert made(words, texts[-40:]) == ids_of(tokenizer, texts[-40:])


@given(st.text(max_size=40))
@example("\xa00")
@example("a\u180e0 \u3000b\u2028")
@settings(max_examples=300, deadline=None)
def test_words_of_any_text(text):
    assert made(packing.Words.of(PATH), ["a", text, ""])[1] == ids_of(Tokenizer.from_file(PATH), [text])[0]


@pytest.mark.parametrize("stretch", [1, 50, 400])
def test_long_texts_in_stretches(tokenizer, monkeypatch, stretch):
    monkeypatch.setattr(packing, "STRETCH", stretch)
    text = "  ".join(f"wörd{i} and, so on" for i in range(200)) + "x" * 300
    texts = ["", text, "a b", "", text[:90], "c", text[50:], ""]
    assert made(packing.Words(PATH), texts) == ids_of(tokenizer, texts)


def check(rows, texts, capacity, tokenizer) -> int:
    """All pieces of all documents, and sequences without gaps; returns their number."""
    want = Counter()
    for (i, _), ids in zip(texts, ids_of(tokenizer, [t or "" for _, t in texts])):
        ids = [*ids, packing.END]
        for p, s in enumerate(range(0, len(ids), capacity)):
            want[i, p, s, tuple(ids[s : s + capacity])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        assert r["length"] * 4 == len(r["ids"])
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("capacity", [4096, 100, 7])
def test_every_piece_has_one_place(docs, rows, tokenizer, capacity):
    texts = [(r[0], r[1]) for r in rows] + [(100 + i, t) for i, t in enumerate(ODD)]
    more = docs.sparkSession.createDataFrame([(i, t, "en", "s", 0) for i, t in texts[len(rows) :]], DOCS)
    packed = packing.pack(docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more), PATH, capacity=capacity)
    found = packed.collect()
    n = check(found, texts, capacity, tokenizer)
    total = sum(r["length"] for r in found)
    assert n <= -(-total // capacity) * 1.1 + 1
    made = packing.sequences(packed).collect()
    assert len(made) == n and sum(len(r["ids"]) for r in made) == 4 * total
    assert all(sum(r["lengths"]) * 4 == len(r["ids"]) <= 4 * capacity for r in made)


def test_no_documents(none):
    assert packing.pack(none, PATH).count() == 0


def test_query_carries_checksums(spark, tokenizer):
    rows = packing.op13_packing(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    for r in rows[::7]:
        ids = [*ids_of(tokenizer, [texts[r["doc_id"]]])[0], 1][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 4096)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=4), st.integers(12, 20))
def test_fullest_combination(counts, capacity):
    """The dynamic program finds what trying all combinations finds."""
    best = max(s for s in (sum(n * k for n, k in zip(counts, take)) for take in product(*(range(c + 1) for c in counts.values()))) if s <= capacity)
    found = packing.fullest(counts, capacity)
    assert sum(found) == best and all(found.count(n) <= counts[n] for n in set(found))
    longest = max(counts)
    found = packing.fullest(counts, capacity, longest)
    assert longest in found and sum(found) <= capacity and all(found.count(n) <= counts[n] for n in set(found))


def best_fit(counts, capacity):
    free, n = [], 0
    for x in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        i = bisect.bisect_left(free, x)
        room = free.pop(i) if i < len(free) else capacity
        n += room == capacity
        if room > x:
            bisect.insort(free, room - x)
    return n


@pytest.mark.parametrize("counts", [{3000: 100, 2000: 100, 1500: 300, 700: 50, 100: 40}, {n: 5 for n in range(1000, 2300, 11)}, {1366: 300, 1365: 300, 2049: 50, 2047: 60}, {n: 50 for n in range(1, 4096, 37)}, {1: 7}, {4095: 3, 1: 1}, {}])
def test_no_more_sequences_than_best_fit(counts):
    assert packing.plan(counts).sequences <= best_fit(counts, 4096)


def test_plan_of_very_many_pieces():
    """The plan grows with the lengths, not with the pieces."""
    counts = {n: 10**9 + n for n in range(1, 4097, 37)}
    made = packing.plan(counts)
    assert len(made.length) < 20_000
    total = sum(n * c for n, c in counts.items())
    assert made.sequences <= -(-total // 4096) * 1.01
    length = np.repeat(np.array(list(counts)), 3)
    number = np.array([[0, c // 2, c - 1] for c in counts.values()]).ravel()
    sequence, offset = made.place(length, number)
    assert (sequence >= 0).all() and (sequence < made.sequences).all() and (offset + length <= 4096).all()
