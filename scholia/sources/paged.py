"""A data source over a paged service that filters for itself: Spark's conditions go into the requests.

Conditions on the key become bounds, so partitions outside of them are not made and their pages not asked for. Conditions that the
service knows (equality, one of a list, bounds, prefixes) are sent with each request; whatever else there is Spark applies to the rows that come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

#: A condition that is sent along: column, operator, value (for "in" a tuple).
Condition = tuple[str, str, object]
#: fetch(cursor, stop, size, conditions): up to `size` rows with cursor < key < stop that meet the conditions, in order of the key, which comes first.
Fetch = Callable[[int, int, int, list[Condition]], list[tuple]]
OPERATORS = {D.EqualTo: "=", D.In: "in", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<=", D.StringStartsWith: "prefix"}
PAGE = 100


class _Range(D.InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class PagedReader(D.DataSourceReader):
    """Ranges of the key in parallel, each page by page with a cursor."""

    def __init__(self, key: str, fetch: Fetch, known: frozenset[str], low: int, high: int, parts: int, size: int) -> None:
        self.key, self.fetch, self.known = key, fetch, known
        self.low, self.high, self.parts, self.size = low, high, parts, size
        self.sent: list[Condition] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            kind, name = OPERATORS.get(type(f)), getattr(f, "attribute", ())
            if kind and name == (self.key,) and kind != "prefix":
                self._narrow(kind, f.value)
                if kind == "in":
                    yield f  # the bounds hold more than the list
            elif kind and kind in self.known and len(name) == 1:
                self.sent.append((name[0], kind, f.value))
            elif not (isinstance(f, D.IsNotNull) and name == (self.key,)):
                yield f

    def _narrow(self, kind: str, value) -> None:
        values = [v for v in (value if kind == "in" else [value]) if v is not None]
        if not values:
            self.high = self.low
            return
        if kind in ("=", "in", ">=", ">"):
            self.low = max(self.low, min(values) + (kind == ">"))
        if kind in ("=", "in", "<=", "<"):
            self.high = min(self.high, max(values) + (kind != "<"))

    def partitions(self) -> list[D.InputPartition]:
        step = max(1, -(-(self.high - self.low) // self.parts))
        return [_Range(a, min(a + step, self.high)) for a in range(self.low, self.high, step)] or [_Range(self.low, self.low)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        cursor = partition.start - 1
        while cursor < partition.stop - 1:
            rows = self.fetch(cursor, partition.stop, self.size, self.sent)
            yield from rows
            if len(rows) < self.size:
                return
            cursor = rows[-1][0]


def register(spark: SparkSession, name: str, schema: str, fetch: Fetch, known: Iterable[str] = ("=", "in", ">", ">=", "<", "<=", "prefix")) -> None:
    """Makes spark.read.format(name) read the service. Its options: high (the keys' end), low, partitions, pageSize (PAGE at most)."""
    key, operators = schema.split()[0], frozenset(known)

    class Source(D.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> D.DataSourceReader:
            of = self.options.get
            return PagedReader(key, fetch, operators, int(of("low", 0)), int(of("high", 0)), int(of("partitions", 4)), max(1, min(PAGE, int(of("pageSize", PAGE)))))

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
