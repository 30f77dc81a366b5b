"""Secret scans: patterns of known kinds, and a character Markov model for the rest; DataFrame operations alone.

Two first-order Markov models, of random strings and of ordinary identifiers, are estimated from labelled samples; a token
whose log-likelihood ratio per character pair favours random strings is a secret of kind ``markov``, unless it overlaps a
span of a known kind. Texts are scanned where they are read, whole, without any shuffle. A text of n matches takes n * sqrt(n)
steps, each a copied number.

Positions are code points, ends exclusive. Null and empty texts have no spans. Repeated rows are scanned row by row. Only
doc_id and text of the input are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import table

#: kind -> pattern; assign's value is its group 2 and must have 6 characters. \x20 and the classes are ASCII in Java, too.
PATTERNS = {
    "assign": r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
VALUE_LENGTH = 6
KINDS = (*PATTERNS, "markov")
#: What the model judges: tokens of at least this many characters.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = len(ALPHABET) + 1
THRESHOLD = 0.6

#: Parts of ordinary identifiers, for the default samples.
PARTS = (
    "get set user name file path config value index count total order item list data table column row field type class object method function return "
    "import export module package server client request response handler manager service factory builder parser writer reader stream buffer thread "
    "process message event listener controller model view template document section paragraph sentence word letter number string integer boolean "
    "default option setting parameter argument variable constant static public private protected internal external interface abstract final check "
    "create update delete insert select from where group having limit offset begin commit rollback transaction connection session account customer "
    "international information understanding development environment government communication responsibility organisation administration "
    "Verantwortung Entwicklung Gesellschaft Wissenschaft Bundesregierung Geschwindigkeit responsabilidad desarrollo organización administración "
    "développement gouvernement environnement responsable particulièrement essentiellement"
).split()


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """The default labelled samples (text, random): digests in three encodings, and identifiers in four styles."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample"), i.cast("string")), 256)
    packed = F.regexp_replace(F.base64(F.unhex(digest)), r"\s", "")
    text = F.when(i % 4 == 0, digest).when(i % 4 == 1, F.upper(F.substring(F.regexp_replace(packed, "[^A-Za-z0-9]", ""), 1, 32))).otherwise(packed)
    random = spark.range(n).select(text.alias("text"), F.lit(1).alias("random"))
    parts = F.split(F.lit(" ".join(PARTS)), " ")
    part = lambda salt: F.element_at(parts, (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(PARTS))) + 1).cast("int"))
    three = [part(s) for s in (1, 2, 3)]
    named = F.when(i % 4 == 0, F.concat_ws("_", *three)).when(i % 4 == 1, F.concat(three[0], *map(F.initcap, three[1:]))).when(i % 4 == 2, F.upper(F.concat_ws("_", *three)))
    named = named.otherwise(F.concat(*map(F.lower, three)))
    return random.unionByName(spark.range(n).select(named.alias("text"), F.lit(0).alias("random")))


def _pair_array(text: Column) -> Column:
    """A token's neighbouring characters, each pair as first * WIDTH + second + 1; 0 stands for characters beyond ALPHABET."""
    place = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.zip_with(F.slice(place, F.lit(1), F.greatest(F.size(place) - 1, F.lit(0))), F.slice(place, F.lit(2), F.greatest(F.size(place) - 1, F.lit(0))), lambda a, b: a * WIDTH + b + 1)


def train(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of characters, random over ordinary: WIDTH**2 numbers, whatever the samples' size."""
    pairs = labelled.where(F.col("text").isNotNull() & F.col("random").isNotNull()).select("random", F.explode(_pair_array(F.col("text"))).alias("p"))
    counts = pairs.groupBy("p").agg(F.sum(F.col("random")).alias("r"), F.sum(1 - F.col("random")).alias("o")).collect()
    random, ordinary = [0.5] * (WIDTH * WIDTH), [0.5] * (WIDTH * WIDTH)
    for p, r, o in counts:
        random[p - 1] += r
        ordinary[p - 1] += o
    ratio = []
    for first in range(WIDTH):
        own = slice(first * WIDTH, (first + 1) * WIDTH)
        a, b = sum(random[own]), sum(ordinary[own])
        ratio += [math.log(x / a) - math.log(y / b) for x, y in zip(random[own], ordinary[own], strict=True)]
    return ratio


def score(token: Column, ratio: list[float]) -> Column:
    """The mean log-likelihood ratio over a token's pairs; null for tokens of under two characters."""
    numbers = F.split(F.lit(",".join(f"{x:.5f}" for x in ratio)), ",").cast("array<double>")  # folded into one literal
    pairs = _pair_array(token)
    return F.when(F.length(token) > 1, F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.element_at(numbers, p)) / (F.length(token) - 1))


SPANS = "array<struct<start:int,rank:int,end:int,kind:string,text:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The merge of each value with all before it. In blocks of the root of their number, since an array that grows is copied at each step."""

    def fold(xs: Column) -> Column:
        add = lambda s, x: F.concat(s, F.array(F.coalesce(merge(F.get(s, F.size(s) - 1), x), x)))
        return F.aggregate(xs, F.expr("CAST(array() AS array<int>)"), add)

    def in_blocks(xs: Column, width: Column) -> Column:
        at = F.sequence(F.lit(0), F.ceil(F.size(xs) / width).cast("int") - 1)
        return _let(F.transform(at, lambda i: fold(F.slice(xs, i * width + 1, width))), joined)

    def joined(blocks: Column) -> Column:
        last = F.transform(blocks, lambda b: F.element_at(b, -1))
        before = F.concat(F.array(F.lit(None).cast("int")), F.slice(fold(last), F.lit(1), F.size(blocks) - 1))
        return F.flatten(F.zip_with(blocks, before, lambda b, h: F.transform(b, lambda x: F.coalesce(merge(h, x), x))))

    return _let(values, lambda xs: F.when(F.size(xs) > 0, _let(F.ceil(F.sqrt(F.size(xs))).cast("int"), lambda w: in_blocks(xs, w))).otherwise(xs))


def _spans(kind: str, found: Column, between: Column) -> Column:
    """Array of (start, rank, end, kind, text): the matches, placed by the lengths of what stands between them."""
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.length(b) + F.length(m))
    one = lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), e.alias("end"), F.lit(kind).alias("kind"), m.alias("text"))
    return F.zip_with(_running(steps, lambda a, b: a + b), found, one)


def _apart(base: Column, tokens: Column) -> Column:
    """The tokens that overlap no base span. Both in order of start; a span overlaps one behind it if it reaches over its start."""
    is_base = lambda x: x["rank"] < KINDS.index("markov")

    def judged(every: Column) -> Column:
        reach = _running(F.transform(every, lambda x: F.when(is_base(x), x["end"]).otherwise(0)), F.greatest)
        ahead = F.reverse(_running(F.reverse(F.transform(every, lambda x: F.when(is_base(x), x["start"]).otherwise(2**31 - 1))), F.least))
        rows = F.arrays_zip(every.alias("x"), reach.alias("reach"), ahead.alias("ahead"))
        free = F.filter(rows, lambda r: ~is_base(r["x"]) & (r["reach"] <= r["x"]["start"]) & (r["ahead"] >= r["x"]["end"]))
        return F.transform(free, lambda r: r["x"])

    return _let(F.array_sort(F.concat(base, tokens)), judged)


def scan(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans: array of (start, rank, end, kind, text), in order of start, then kind."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    patterns = PATTERNS | {"markov": TOKEN}
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"m_{k}": F.when(F.col("text").rlike(p), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    value = F.when(F.size("m_assign") > 0, F.regexp_extract_all("text", F.lit(PATTERNS["assign"]), F.lit(2))).otherwise(none)
    rows = rows.withColumn("v_assign", value)
    empty = F.expr(f"CAST(array() AS {SPANS})")
    rows = rows.withColumns({f"s_{k}": F.when(F.size(f"m_{k}") > 0, _spans(k, F.col(f"m_{k}"), F.split("text", p, -1))).otherwise(empty) for k, p in patterns.items()})
    long = F.filter(F.zip_with("s_assign", "v_assign", lambda s, v: F.struct(s.alias("s"), F.length(v).alias("n"))), lambda x: x["n"] >= VALUE_LENGTH)
    rows = rows.withColumn("base", F.array_sort(F.concat(F.transform(long, lambda x: x["s"]), "s_access", "s_hex")))
    free = F.when(F.size("s_markov") == 0, empty).when(F.size("base") == 0, F.col("s_markov")).otherwise(_apart(F.col("base"), F.col("s_markov")))
    rows = rows.withColumn("free", free).withColumn("more", F.filter("free", lambda t: score(t["text"], ratio) > threshold))
    return rows.select("doc_id", F.array_sort(F.concat("base", "more")).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"), train(samples(spark)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op6_secrets": op6_secrets}
SQL: dict[str, str] = {}
