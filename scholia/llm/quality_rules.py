"""Quality rules: a ledger that holds every rule's failure as a bit beside its measurements.

Each rule is evaluated once per document. Policies are versioned masks over the ledger's bits, so a policy can change,
or a rule be ablated, by bitwise work on the ledger alone, without a second look at any text.

Texts: null counts as empty (no words, fails ``too_few_words``). Repeated rows are measured row by row and all stay.
Columns of the input other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "longest_word")

#: name -> failure as SQL over the measures; a rule's place is its bit and must never change.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_phrases": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "n_words > 0 AND 10 * n_symbols > 4 * n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)",
    "duplicate_lines": "n_lines > 0 AND 10 * n_dup_lines > 5 * n_lines",
    "shouting": "word_chars > 0 AND 2 * n_upper > word_chars",
    "giant_word": "longest_word > 1000",
}
BITS = {name: i for i, name in enumerate(RULES)}


def mask(*rules: str) -> int:
    return sum(1 << BITS[r] for r in rules)


#: version -> bits that reject a document.
POLICIES: dict[str, int] = {
    "base": mask("too_few_words", "repeated_phrases"),
    "v1": mask("too_few_words", "repeated_phrases", "symbol_heavy", "duplicate_lines"),
    "v2": mask(*RULES),
}
DEFAULT_POLICY = "v2"
SYMBOLS = "#*$%&|<>"


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() splits at exactly \x20 and \x09-\x0D
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    seen: set[str] = set()
    n_lines = dup_lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            n_lines += 1
            dup_lines += line in seen
            seen.add(line)
    repeat = 0
    if len(words) > 2:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            once: set[tuple] = set()
            twice = {w for w in windows if w in once or once.add(w)}
            end = 0
            for i, w in enumerate(windows):
                if w in twice:
                    repeat += i + 3 - max(i, end)
                    end = i + 3
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    longest = max((len(w) for w in words), default=0)
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), dup_lines, repeat, n_lines, upper, longest


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = list(zip(*(measure(t) for t in batch.column(1).to_pylist()), strict=True)) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and fail_bits (long): one row per input row; no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_measured, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.expr(f"CASE WHEN {rule} THEN {1 << BITS[name]}L ELSE 0L END") for name, rule in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return rows.withColumn("fail_bits", total)


def rejected(policy: str = DEFAULT_POLICY, bits: Column | None = None) -> Column:
    """Whether a policy rejects what has these bits."""
    bits = F.col("fail_bits") if bits is None else bits
    return bits.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0


def ablations(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that stay once it is dropped.

    The ledger is first counted by fail_bits, at most 2**len(RULES) rows whatever the corpus holds.
    """
    by_bits = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    bits, of = F.col("fail_bits"), F.lit(POLICIES[policy]).cast("long")
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for n, i in BITS.items() if POLICIES[policy] >> i & 1))).alias("r")
    without = of.bitwiseAND(F.bitwise_not(F.col("r.bit")))
    hit = bits.bitwiseAND(F.col("r.bit")) != 0
    free = bits.bitwiseAND(without) == 0
    return (
        by_bits.select("fail_bits", "n", rules).groupBy(F.col("r.rule").alias("rule"))
        .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(hit & free, F.col("n")).otherwise(0)).alias("n_only"), F.sum(F.when(free, F.col("n")).otherwise(0)).alias("n_kept_without"))
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rejected("base").alias("base_failed"), (~rejected(DEFAULT_POLICY)).alias("kept"), (~rejected("v1")).alias("kept_v1"), "fail_bits",
    )


OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
u AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
p AS (SELECT rid, i, a, lead(a) OVER x AS b, lead(a, 2) OVER x AS c FROM u WINDOW x AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS c FROM p WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c >= 2) GROUP BY rid),
l AS (SELECT rid, line, count(*) AS c FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line),
ll AS (SELECT rid, sum(c - 1) AS n_dup_lines, sum(c) AS n_lines FROM l GROUP BY rid),
m AS (
  SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, coalesce(list_max(list_transform(ws, lambda x: strlen(x))), 0) AS longest_word
  FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN ll USING (rid)),
b AS (SELECT *, {" | ".join(f"(CASE WHEN {rule} THEN {1 << BITS[name]} ELSE 0 END)" for name, rule in RULES.items())} AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (fail_bits & {POLICIES["base"]}) <> 0 AS base_failed,
  (fail_bits & {POLICIES[DEFAULT_POLICY]}) = 0 AS kept, (fail_bits & {POLICIES["v1"]}) = 0 AS kept_v1, CAST(fail_bits AS BIGINT) AS fail_bits FROM b
"""


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the default policy rejects, alone or with others, from the ledger's bits."""
    return ablations(ledger(table(spark, sf_dir, "documents")))


_OF = POLICIES[DEFAULT_POLICY]
_EACH = ", ".join(f"('{n}', {1 << i})" for n, i in BITS.items() if _OF >> i & 1)
ABLATIONS_SQL = f"""
WITH o AS ({OP2_SQL}), r(rule, bit) AS (VALUES {_EACH})
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & bit <> 0 AND fail_bits & ({_OF} - bit) = 0) AS n_only, count(*) FILTER (fail_bits & ({_OF} - bit) = 0) AS n_kept_without FROM o, r GROUP BY rule
"""

QUERIES = {"op2_quality_rules": op2_quality_rules, "rule_ablations": rule_ablations}
SQL = {"op2_quality_rules": OP2_SQL, "rule_ablations": ABLATIONS_SQL}
