"""Joins: fallback keys, nearest neighbours within a page, substring and fuzzy matches, drift of schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.durable import broadcast_if_small, cut, is_small
from scholia.operators.titles import similar_before

#: Names that are compared with each row; beyond, names are joined on equal keys.
MANY = 1000


def lookup_or(rows: DataFrame, known: DataFrame, first: str, second: str, known_id: str, name: str = "match") -> DataFrame:
    """Each row with the id of the known row of the same `first` key, or else of the same folded `second`; least ids win.

    Both lookups are plain equi-joins on keys made unique beforehand, so neither multiplies rows.
    """
    fold = lambda c: F.lower(F.trim(c))
    by_first = known.where(F.col(first).isNotNull()).groupBy(F.col(first).alias("_a")).agg(F.min(known_id).alias("_ia"))
    by_second = known.where(F.col(second).isNotNull()).groupBy(fold(F.col(second)).alias("_b")).agg(F.min(known_id).alias("_ib"))
    rows = rows.join(by_first, F.col(first) == F.col("_a"), "left").join(by_second, fold(F.col(second)) == F.col("_b"), "left")
    return rows.withColumn(name, F.coalesce("_ia", "_ib")).drop("_a", "_b", "_ia", "_ib")


def nearest_box(captions: DataFrame, boxes: DataFrame, page: list[str], max_gap: float = 80, min_overlap: float = 0.2) -> DataFrame:
    """caption, box, gap: for each caption the nearest box of its page that overlaps it sideways and is near enough.

    Both sides have columns id, x0, y0, x1, y1. The page is an equi-join key, so a page's boxes meet its captions only.
    """
    c = captions.select(*page, *(F.col(x).alias(f"c_{x}") for x in ("id", "x0", "y0", "x1", "y1")))
    b = boxes.select(*page, *(F.col(x).alias(f"b_{x}") for x in ("id", "x0", "y0", "x1", "y1")))
    overlap = F.greatest(F.lit(0.0), F.least("c_x1", "b_x1") - F.greatest("c_x0", "b_x0"))
    width = F.least(F.col("c_x1") - F.col("c_x0"), F.col("b_x1") - F.col("b_x0"))
    gap = F.greatest(F.lit(0.0), F.greatest(F.col("c_y0") - F.col("b_y1"), F.col("b_y0") - F.col("c_y1")))
    near = c.join(b, page).where((width > 0) & (overlap >= min_overlap * width)).withColumn("gap", gap).where(F.col("gap") <= max_gap)
    return near.groupBy(*page, F.col("c_id").alias("caption")).agg(F.min(F.struct("gap", "b_id")).alias("m")).select(*page, "caption", F.col("m.b_id").alias("box"), F.col("m.gap").alias("gap"))


def first_containing(rows: DataFrame, text: str, names: DataFrame, name: str, order: str, prefix: int = 6) -> DataFrame:
    """Each row with the first name, in order, whose first characters its text holds.

    A short list of names (up to MANY) is sent to all rows; a longer one is joined on the stretches of the texts that are as long as a key.
    """
    n = names.select(F.col(name).alias("_name"), F.col(order).alias("_order"), F.lower(F.substring(name, 1, prefix)).alias("_key"))
    key = [c for c in rows.columns if c != text]
    if is_small(n, MANY):
        hits = rows.join(F.broadcast(n), F.lower(F.col(text)).contains(F.col("_key")), "left")
    else:
        sizes = [r[0] for r in n.select(F.length("_key").alias("k")).where("k > 0").distinct().orderBy("k").collect()]  # up to `prefix` numbers
        low = F.lower(F.col(text))

        def stretches(k: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - k + 1, F.lit(1))), lambda i: F.substr(low, i, F.lit(k)))

        parts = F.array_distinct(F.flatten(F.array(*map(stretches, sizes), F.array(F.lit("")))))
        hits = rows.select(*key, F.explode_outer(F.when(low.isNotNull(), parts)).alias("_part")).join(n, F.col("_part") == F.col("_key"), "left")
    return hits.groupBy(*key).agg(F.min(F.when(F.col("_name").isNotNull(), F.struct("_order", "_name")))["_name"].alias(name))


def best_overlap(rows: DataFrame, key: str, terms: Column, items: DataFrame, item: str, item_terms: Column) -> DataFrame:
    """key, item, jaccard: for each row the item whose set of terms is most like its own (the least of equals); null and 0.0 without any.

    Items are a stated query set: their terms are joined to the rows' terms and common ones counted per row and item, so only pairs
    with a term in common are made. `key` and `item` are unique; both sides' terms are arrays.
    """
    d = rows.select(F.col(key).alias("_row"), F.array_distinct(terms).alias("w"))
    q = items.select(F.col(item).alias("_item"), F.array_distinct(item_terms).alias("w"))
    one = q.select("_item", F.size("w").alias("m"), F.explode("w").alias("_t"))
    both = d.select("_row", F.size("w").alias("n"), F.explode("w").alias("_t")).join(broadcast_if_small(one), "_t")
    common = both.groupBy("_row", "_item").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    jaccard = F.col("c") / (F.col("n") + F.col("m") - F.col("c"))
    best = common.groupBy("_row").agg(F.min(F.struct((-jaccard).alias("less"), "_item")).alias("b"))
    return d.select("_row").join(best, "_row", "left").select(F.col("_row").alias(key), F.col("b._item").alias(item), F.coalesce(-F.col("b.less"), F.lit(0.0)).alias("jaccard"))


def schema_drift(expected: DataFrame, found: DataFrame, name: str, kind: str) -> DataFrame:
    """name, status: fields missing, unexpected or of another type, by folded name."""
    e = expected.select(F.lower(name).alias("n"), F.col(kind).alias("e"))
    f = found.select(F.lower(name).alias("n"), F.col(kind).alias("f"))
    status = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("e") != F.col("f"), "changed")
    return e.join(f, "n", "full_outer").select(F.col("n").alias(name), status.alias("status")).where("status IS NOT NULL")


def resolve_field(asked: DataFrame, fields: DataFrame, word: str, alias: str, name: str, order: str) -> DataFrame:
    """Each asked word with a field: the one of that alias, else of that ordinal, else one that holds it or is held by it."""
    f = fields.select(F.lower(alias).alias("_alias"), F.lower(name).alias("_low"), F.col(name).alias("_name"), F.col(order).cast("int").alias("_order"))
    w = F.lower(F.trim(word))
    rank = F.when(w == F.col("_alias"), 0).when(w == F.col("_order").cast("string"), 1).when(w.contains(F.col("_low")) | F.col("_low").contains(w), 2)
    hits = asked.select(word).distinct().crossJoin(broadcast_if_small(f, MANY)).withColumn("_rank", rank)  # a form's fields: dozens
    return hits.groupBy(word).agg(F.min(F.when(F.col("_rank").isNotNull(), F.struct("_rank", "_order", "_name")))["_name"].alias("field"))


def fuzzy_keep_first(rows: DataFrame, block: Column | None, order: str, text: str, ratio: float = 0.9) -> DataFrame:
    """Greedy keep-first: a row is dropped if its text is over `ratio` similar to one kept before it, of its block if blocks are given.

    Equal texts are merged by an aggregate. All pairs of lengths that are near enough are looked at (`titles.similar_before`), so none is
    missed. Then rounds decide the order: what has no undecided similar one before it is kept, and those similar to it behind it are
    dropped. A text with many similar ones is first held against a few; if all of these were dropped, it asks again for what is
    left. `order` is unique; null texts count as empty, case does not count.
    """
    if not 0 < ratio < 1:
        raise ValueError("a ratio between 0 and 1")
    block = (F.lit("") if block is None else F.coalesce(block.cast("string"), F.lit(""))).alias("block")
    keyed = rows.select(block, F.lower(F.coalesce(text, F.lit(""))).alias("t"), F.col(order).alias("o"))
    titles = cut(keyed.groupBy("block", "t").agg(F.min("o").alias("o")))
    new = cut(similar_before(titles.withColumn("z", F.lit(True)), ratio))
    some = lambda df: df.select(F.col("b").alias("o")).distinct()
    edges, more, dropped = new.where("a IS NOT NULL").distinct(), some(new.where("a IS NULL")), some(new.limit(0))
    while True:
        waiting = some(edges).union(more)
        kept = edges.select(F.col("a").alias("o")).distinct().join(waiting, "o", "left_anti")
        gone = cut(some(edges.join(kept.withColumnRenamed("o", "a"), "a", "left_semi")))
        if not gone.isEmpty():
            dropped = cut(dropped.union(gone))
            more = cut(more.join(gone, "o", "left_anti"))
            edges = cut(edges.join(gone.withColumnRenamed("o", "b"), "b", "left_anti").join(gone.withColumnRenamed("o", "a"), "a", "left_anti"))
        elif not more.isEmpty():  # what waits for none that is undecided asks again, among what is not dropped
            asking = cut(more.join(some(edges), "o", "left_anti").withColumn("z", F.lit(True)))
            left = titles.join(dropped, "o", "left_anti").join(asking, "o", "left").withColumn("z", F.coalesce("z", F.lit(False)))
            new = cut(similar_before(left, ratio, again=True))
            edges = cut(edges.union(new.where("a IS NOT NULL")).distinct())
            more = cut(more.join(asking, "o", "left_anti").union(some(new.where("a IS NULL"))))
        else:
            break
    first = titles.select(F.col("o").alias("_o")).join(dropped.withColumnRenamed("o", "_o"), "_o", "left_anti")
    return rows.join(first, F.col(order) == F.col("_o"), "left_semi")
