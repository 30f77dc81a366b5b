"""Small corpora with the cases that every operator must bear."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abdeghilmnorstuvé") for _ in range(r.randint(1, 9))) for _ in range(n))


def corpus() -> list[tuple]:
    """Plain texts, copies, near copies, shared passages, nulls in all columns, empty and long texts, repeated rows."""
    passage = words(99, 90)
    rows = [(i, words(i, 40 + 7 * i), "en", f"s{i % 3}", 0) for i in range(20)]
    rows += [(20, rows[3][1], "en", "s0", 0), (21, rows[3][1] + " more", "de", "s1", 0)]
    rows += [(22 + i, f"{words(200 + i, 15)} {passage} {words(300 + i, 10)}", "en", "s2", 0) for i in range(4)]
    rows += [(30, None, None, None, None), (31, "", "en", "", 0), (32, " \n\t ", "en", "s0", 3), (33, words(33, 6000), "en", "s1", 0), (34, "x" * 3000, "en", "s0", 0)]
    rows += [(35, "abc " * 400, "en", "s0", 0), (36, "One line.\nOne line.\nOne line.\n" * 9, "en", "s0", 0), (None, words(40, 120), "en", "s1", 0), (None, None, None, None, None)]
    rows += [rows[5], rows[5], (37, words(1, 47) + "\u00a0\u2003naïve ẞ 漢字 😀", "fr", "s1", 0)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus over several partitions, with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).repartition(3, F.xxhash64("doc_id", "text")).withColumns({n: F.lit("clash") for n in ("_h", "key", "_size", "shard", "fp", "w", "score", "spans", "anchor", "c", "n", "_of", "_leaf", "_key")})


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
