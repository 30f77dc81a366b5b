"""Quality classifier: histogram gradient-boosted trees over document statistics.

Labels are learned from at most MAX_ROWS labelled documents, chosen by the hash of their id; that bound keeps the fit on
the driver small, whatever the corpus holds. Every document is then scored where it is read, by trees that are flattened
into arrays and traversed level by level with numpy. The inputs of a score come from the text alone.

Texts: null counts as empty and gets a score like any other. A doc_id labelled both ways equally often is no example; null
labels and labels of unknown documents are ignored. Without examples of both classes every document gets the share of good
labels, or 1.0 where there is none. Repeated rows are scored row by row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import table

MAX_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, MIN_ROWS, RIDGE = 60, 4, 32, 0.15, 20, 1.0

_NOT_WORD = re.compile(r"[^\w\s]")
_SYMBOLS = "#*$%&|<>@~^\\{}[]="
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = (
    "log_words", "word_length", "unique_words", "top_word", "top_pair", "repeated_triples", "symbols", "bangs", "upper", "digits", "stops", "commas",
    "log_lines", "line_length", "duplicate_lines", "bars", "not_ascii", "short_words", "long_words", "ends_with_stop", "symbol_tails", "words_a_sentence",
)


def features(text: str | None) -> list[float]:
    """The statistics of one text, in the order of FEATURES."""
    text = text or ""
    words, n_chars = text.split(), max(len(text), 1)
    n = max(len(words), 1)
    count = text.count
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    triples = len(words) - 2 - len(set(zip(words, words[1:], words[2:]))) if len(words) > 2 else 0
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = list(map(len, words))
    stops = count(".")
    return [
        np.log1p(len(words)), sum(lengths) / n, len(counts) / n, max(counts.values(), default=0) / n, max(pairs.values(), default=0) / n, triples / n,
        sum(map(count, _SYMBOLS)) / n, count("!") / n, sum(map(count, _UPPER)) / n_chars, sum(map(count, "0123456789")) / n_chars, stops / n, count(",") / n,
        np.log1p(len(lines)), len(text) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), count("|") / n,
        (len(text.encode("utf-8", "surrogatepass")) - len(text)) / n_chars, sum(x < 3 for x in lengths) / n, sum(x > 12 for x in lengths) / n,
        float(text.rstrip()[-1:] in (".", "!", "?")), sum(not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'" for w in words) / n, len(words) / (stops + 1),
    ]


@dataclass
class Trees:
    """Complete trees of equal depth in arrays: node i of a tree has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosts logistic loss; splits are searched over histograms of each feature's quantile bins."""
    inner = 2**depth - 1
    good = float(y.mean()) if len(y) else 1.0
    if len(y) == 0 or good in (0.0, 1.0):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 30.0 if good == 1.0 else -30.0)
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log(good / (1 - good)))
    raw = np.full(n, base)
    out_f, out_c, out_l = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    offset = np.arange(k) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            flat = ((node - first)[:, None] * (k * BINS) + offset + binned).ravel()
            size = width * k * BINS
            hist = [np.bincount(flat, np.repeat(v, k), size).reshape(width, k, BINS).cumsum(2) for v in (g, h, np.ones(n))]
            gl, hl, nl = hist
            gt, ht, nt = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < MIN_ROWS) | (nt - nl < MIN_ROWS)] = -1
            gain[:, :, -1] = -1
            best = gain.reshape(width, -1).argmax(1)
            for i, b in enumerate(best):
                f, c = divmod(int(b), BINS)
                if gain[i, f, c] > 1e-9 and c < len(edges[f]):
                    out_f[t, first + i], out_c[t, first + i] = f, edges[f][c]
            node = 2 * node + 1 + (x[np.arange(n), out_f[t, node]] > out_c[t, node])
        leaf = node - inner
        sums = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        out_l[t] = -RATE * sums[0] / (sums[1] + RIDGE)
        raw += out_l[t][leaf]
    return Trees(out_f, out_c, out_l, base)


def held_out(doc_id: Column) -> Column:
    """One document of five, by the checksum of its id; never trained on. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features_udf() -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    return of


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Fits on at most max_rows labelled documents that are not held out."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("q"))
    marks = marks.where("q <> 0.5").select("doc_id", (F.col("q") > 0.5).cast("double").alias("y"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # bounded, so that the broadcast is, too
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("doc_id", "y", _features_udf()(F.col("text")).alias("x"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_rows).toPandas()  # twice: for repeated rows
    rows["x0"] = rows["x"].map(tuple)
    rows = rows.sort_values(["doc_id", "x0"])
    x = np.array(rows["x0"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["y"].to_numpy(float))


def scorer(model: Trees):
    """A column function: text -> score from 0 to 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(x))

    return score


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op4_quality_model": op4_quality_model}
SQL: dict[str, str] = {}
