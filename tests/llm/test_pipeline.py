"""The pipeline's stages against brute force on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from scholia.llm import decontaminate, quality_model, sharding, source_mix
from scholia.llm.common import stored, table
from tests.conftest import SF, rows_of, rows_of_sql
from tests.llm.test_native import water
from tests.llm.test_near_copies import slow_roots


def shard_of(hashes: dict, sizes: dict, limit: int) -> dict:
    """Splits buckets of (row, hash) by bits, one bucket at a time: row -> bits."""
    found, todo = {}, [("", list(hashes))]
    while todo:
        bits, rows = todo.pop()
        if sum(sizes[r] for r in rows) <= limit or len({hashes[r] for r in rows}) == 1:
            found |= dict.fromkeys(rows, bits)
            continue
        for b in "01":
            if own := [r for r in rows if hashes[r].startswith(bits + b)]:
                todo.append((bits + b, own))
    return found


def test_stages_in_order(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stored(stage(spark, kept, SF))
        assert kept.columns == columns
        if name == "quality":
            model = quality_model.train(before, table(spark, SF, "labels"))
            good = {r["doc_id"] for r in before.select("doc_id", quality_model.scorer(model)(F.col("text")).alias("s")).collect() if r["s"] >= 0.3}
            assert {r["doc_id"] for r in kept.collect()} == good
        if name == "near_duplicates":
            rows = sorted(before.select("doc_id", "text").collect())
            least = {root: r["doc_id"] for root, r in reversed(list(zip(slow_roots([r["text"] for r in rows]), rows)))}
            assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
        if name == "benchmark":
            matcher = decontaminate.Matcher(sorted((r["item_id"], decontaminate.normal(r["text"])) for r in table(spark, SF, "benchmark").collect()))
            assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in before.collect() if not matcher.find(r["text"])}
        if name == "mixing":
            rows, n = before.collect(), lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            sizes = Counter()
            for r in rows:
                sizes[r["source"]] += n(r["text"])
            targets, want = water(dict(sizes)), Counter()
            for r in rows:
                rate = targets[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0.0
                draw = int(hashlib.md5(f"{source_mix.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
                want[tuple(r)] += math.floor(rate) + (draw < rate - math.floor(rate))
            assert Counter(tuple(r) for r in kept.collect()) == +want
        assert 0 < kept.select("doc_id").distinct().count() <= before.select("doc_id").distinct().count()
    out = corpus_pipeline.run(spark, SF)
    rows = [tuple(r[c] for c in columns) for r in out.collect()]
    assert out.columns == [*columns, *sharding.SHARD_COLUMNS] and Counter(rows) == Counter(map(tuple, kept.collect()))


@pytest.mark.parametrize("limit", [sharding.LIMIT, 5000])
def test_last_stage_splits_like_one_bucket_at_a_time(spark, monkeypatch, limit):
    monkeypatch.setattr(sharding.assign, "__defaults__", (limit,))
    docs = table(spark, SF, "documents")
    got = corpus_pipeline.shards(spark, docs, SF).collect()
    hashes = {r["doc_id"]: f"{int(hashlib.md5(f"{r['doc_id']}:{r['text'] or ''}".encode()).hexdigest()[:15], 16):060b}" for r in docs.collect()}
    sizes = {r["doc_id"]: len((r["text"] or "").encode()) for r in docs.collect()}
    want = shard_of(hashes, sizes, limit)
    assert {r["doc_id"]: r["shard"] for r in got} == want and len(got) == len(want)
    assert limit > 5000 or len(set(want.values())) > 20 and any(not r["fits"] for r in got)


def _queries():
    from scholia.llm import registry

    return registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(_queries()[1]))
def test_equals_sql(spark, duck, name):
    queries, sql = _queries()
    df = queries[name](spark, SF)
    columns, expected = rows_of_sql(duck, sql[name])
    assert sorted(df.columns) == columns and rows_of(df) == expected


def test_ten_operators():
    names = _queries()[0]
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
