"""Column statistics, correlations, trends and regularity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numeric_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each numeric column: field, count, missing, min, max, mean, stdev (0.0 for a single value). One pass for all."""
    one = lambda c: F.struct(
        F.lit(c).alias("field"), F.count(c).alias("count"), (F.count("*") - F.count(c)).alias("missing"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"),
        F.round(F.avg(c), 3).alias("mean"), F.round(F.when(F.count(c) > 1, F.stddev_samp(c)).when(F.count(c) == 1, 0.0), 3).alias("stdev"),
    )
    return rows.agg(F.array(*map(one, columns)).alias("s")).select(F.inline("s"))


def value_stats(rows: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The most frequent values of a select or multi-select column, and how many tags and different tags there are."""
    kind = dict(rows.dtypes)[column]
    flat = rows.select(F.explode(column).alias("v")) if kind.startswith("array") else rows.select(F.col(column).alias("v")).where("v IS NOT NULL")
    counts = flat.groupBy("v").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total_tags"), F.count("*").alias("unique"))
    return counts.orderBy(F.desc("n"), "v").limit(top).crossJoin(F.broadcast(total)).select(F.lit(column).alias("field"), F.col("v").cast("string").alias("value"), "n", "total_tags", "unique")


def column_stats(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row per field of a table whose fields are known at run time only: (field, type, count, missing, low, high, detail).

    All aggregates are generated into one pass. Numbers and dates tell their ends, checkboxes how many are true, all others how many
    are filled; frequent values and words need a pass each (value_stats, top_keywords).
    """

    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        filled = c.isNotNull() & (c != "") if kind in ("title", "rich_text") else c.isNotNull()
        low, high, detail = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
        if kind in ("number", "date"):
            low, high = F.min(c).cast("string"), F.max(c).cast("string")
            detail = F.avg(c) if kind == "number" else detail
        if kind == "checkbox":
            detail = F.count_if(c).cast("double")
        return F.struct(F.lit(name).alias("field"), F.lit(kind).alias("type"), F.count_if(filled).alias("count"), F.count_if(~filled).alias("missing"), low.alias("low"), high.alias("high"), detail.alias("detail"))

    return rows.agg(F.array(*(one(n, k) for n, k in fields.items())).alias("s")).select(F.inline("s"))


def correlation_label(r: Column) -> Column:
    strength = F.when(F.abs(r) >= 0.7, "strong").when(F.abs(r) >= 0.4, "moderate").otherwise("weak")
    return F.concat(strength, F.when(r >= 0, " positive").otherwise(" negative"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's r of all pairs of columns, over rows where both are known; at least three of them, and no constant column.

    All pairs come from one pass; r is covariance over deviations, as corr() fails on constant columns.
    """

    def one(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.when((F.count_if(both) >= 3) & (spread > 0), F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))).alias("r"), F.count_if(both).alias("n"))

    found = rows.agg(F.array(*(one(a, b) for a, b in combinations(columns, 2))).alias("s")).select(F.inline("s")).where("r IS NOT NULL")
    return found.select("field_a", "field_b", F.round("r", 3).alias("pearson_r"), correlation_label(F.col("r")).alias("strength"), F.col("n").alias("sample_size"))


def trend(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Whether each key's values, in order, rise or fall: the halves' means differ by over a quarter of the deviation; four values at least."""
    w = Window.partitionBy(key)
    placed = rows.where(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    halves = placed.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.when(first, F.col(value))).alias("a"), F.avg(F.when(~first, F.col(value))).alias("b"), F.stddev_samp(value).alias("s"))
    delta, least = F.col("b") - F.col("a"), F.col("s") * 0.25
    return halves.select(key, "n", F.when(F.col("n") < 4, "insufficient data").when(delta > least, "increasing").when(delta < -least, "decreasing").otherwise("stable").alias("trend"))


def consistency(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """How regularly each key's entries come: mean gap in days, a score from 0 to 100, and a label.

    The mean gap is the span over the number of gaps, so one aggregate is enough.
    """
    days = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 86_400_000_000
    spans = rows.where(F.col(ts).isNotNull()).groupBy(key).agg(F.count("*").alias("entries"), days.alias("days"))
    gap = F.when(F.col("entries") > 1, F.col("days") / (F.col("entries") - 1))
    score = F.when(F.col("entries") > 1, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * (1.0 - (gap - 1.0) / 6.0)))).otherwise(0.0)
    label = F.when(F.col("entries") < 2, "insufficient data").when(F.col("score") >= 80, "excellent").when(F.col("score") >= 60, "good").when(F.col("score") >= 40, "moderate").otherwise("irregular")
    return spans.withColumns({"gap_days": gap, "score": score}).select(key, "entries", F.round("gap_days", 2).alias("gap_days"), F.round("score").alias("score"), label.alias("label"))


def gaps(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Each row with the seconds since the one before it of its key."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return rows.withColumn("gap_s", (micros(F.col(ts)) - micros(F.lag(ts).over(w))) / 1_000_000)


def parameter_distribution(rows: DataFrame, group: str, number: str, paper: str) -> DataFrame:
    """For each group the numbers found: how many, in how many papers, mean and ends."""
    return rows.where(F.col(number).isNotNull()).groupBy(group).agg(F.count("*").alias("values"), F.countDistinct(paper).alias("papers"), F.avg(number).alias("mean"), F.min(number).alias("low"), F.max(number).alias("high"))


def by_dominant_unit(rows: DataFrame, category: str, number: str, unit: str, paper: str) -> DataFrame:
    """For each category its most used unit (least name among equals) and, in that unit, the numbers' ends and most frequent value."""
    units = rows.groupBy(category, unit).agg(F.count("*").alias("_n"))
    best = units.groupBy(category).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(unit).alias("u")))["u"].alias("_u"))
    total = rows.groupBy(category).agg(F.count("*").alias("count"), F.countDistinct(paper).alias("papers"))
    own = rows.join(best, category).where(F.col(unit) == F.col("_u"))
    modes = own.groupBy(category, number).agg(F.count("*").alias("_m")).groupBy(category).agg(F.min(F.struct((-F.col("_m")).alias("m"), F.col(number).alias("v")))["v"].alias("mode"))
    ends = own.groupBy(category).agg(F.first("_u").alias("unit"), F.min(number).alias("low"), F.max(number).alias("high"))
    return total.join(ends, category).join(modes, category).withColumn("range", F.col("high") - F.col("low"))


def top_keywords(rows: DataFrame, words: Column, top: int = 10) -> DataFrame:
    """The most frequent of the words that a column of arrays gives; least words first among equals."""
    return rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "word").limit(top)
