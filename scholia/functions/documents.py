"""Documents and page regions as columns: assembly, flattening of typed fields, boxes, region filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assemble(sections: DataFrame, document: str, position: str, title: str, *texts: str) -> DataFrame:
    """One text per document: `## title`, then the first of its texts that is not empty, sections in order and divided by rules."""
    body = F.coalesce(*(F.nullif(F.trim(t), F.lit("")) for t in texts), F.lit(""))
    part = F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), body)
    parts = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), part.alias("t"))))
    return sections.groupBy(document).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n---\n\n").alias("text"))


def flatten(pages: DataFrame, properties: str, fields: dict[str, str]) -> DataFrame:
    """Typed columns out of a map of field names to texts; names and types are known at run time only."""
    kinds = {"number": "double", "checkbox": "boolean", "date": "date"}
    value = lambda name, kind: F.nullif(F.trim(F.col(properties)[name]), F.lit(""))
    columns = [value(n, k).try_cast(kinds[k]).alias(n) if k in kinds else F.split(value(n, k), r"\s*,\s*").alias(n) if k == "multi_select" else value(n, k).alias(n) for n, k in fields.items()]
    return pages.select(*[c for c in pages.columns if c != properties], *columns)


def scaled(box: Column, dpi: Column | float) -> Column:
    """A box in points from one in pixels."""
    return F.struct(*((box[c] * 72.0 / dpi).alias(c) for c in ("x0", "y0", "x1", "y1")))


def is_garbage_region(box: Column, page_width: Column, page_height: Column, least: float = 0.02, aspect: float = 7.0, margin: float = 0.07) -> Column:
    """Whether a region is too small, too long, or within a page's head or foot.

    Bounds are rounded to nine places: 0.07 * 800 is 56.00000000000001 in binary, and a region that ends at 56 is not within the head.
    """
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    small = (w <= 0) | (h <= 0) | (w * h < F.round(least * page_width * page_height, 9))
    long = F.greatest(w, h) > F.round(aspect * F.least(w, h), 9)
    return small | long | (box["y1"] < F.round(margin * page_height, 9)) | (box["y0"] > F.round((1 - margin) * page_height, 9))


def changes(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The rows in which a key's value differs from the one before; the first counts as a change."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    return rows.withColumns({"_b": before, "_f": first}).where(F.col("_f") | ~F.col("_b").eqNullSafe(F.col(value))).drop("_b", "_f")
