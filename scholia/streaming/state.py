"""Keyed state in the order of time: entries that expire, journals with deadlines, and values that are pushed when they change.

Each operator is a small Step over one key's rows. Rows wait in the state until the watermark has passed them and are then handed to the
step in the order of their time and number, deadlines in between; so results don't depend on how rows are dealt to batches, or on a
restart. What waits is bounded by the watermark's delay, what a step keeps by its own rule. Deadlines are event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: A row of a key: time in microseconds, its number, its kind.
Row = tuple[int, int, str]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_WAITING = "time BIGINT, number BIGINT, kind STRING"


class Step:
    """What happens to one key. States are tuples of `schema`, outputs tuples of `out` (both in Spark's notation), times microseconds."""

    schema: str
    out: str

    def row(self, state: tuple | None, row: Row) -> tuple[tuple | None, list[tuple]]:
        """The state and the outputs after a row."""
        raise NotImplementedError

    def deadline(self, state: tuple) -> int | None:
        """When the state is to be looked at again; a row of that very time comes first."""
        return None

    def due(self, state: tuple, now: int) -> tuple[tuple | None, list[tuple]]:
        """The state and the outputs after its deadline."""
        raise NotImplementedError


class Expiring(Step):
    """The entry of a key lives for `ttl` after the last row of kind `opens`; rows of kind `asks` find it or not.

    Outputs: (number, 'found', entry) or (number, 'missing', null) for each row that asks, and (entry, 'expired', entry) once an entry's time is up.
    """

    schema, out = "entry BIGINT, opened BIGINT", "number BIGINT, outcome STRING, entry BIGINT"

    def __init__(self, opens: str, asks: str, ttl_hours: float) -> None:
        self.opens, self.asks, self.ttl = opens, asks, int(ttl_hours * 3_600_000_000)

    def row(self, state: tuple | None, row: Row) -> tuple[tuple | None, list[tuple]]:
        time, number, kind = row
        if kind == self.opens:
            return (number, time), []
        if kind == self.asks:
            return state, [(number, "found", state[0]) if state else (number, "missing", None)]
        return state, []

    def deadline(self, state: tuple) -> int:
        return state[1] + self.ttl

    def due(self, state: tuple, now: int) -> tuple[None, list[tuple]]:
        return None, [(state[0], "expired", state[0])]


class Journal(Step):
    """Submissions wait for their confirmation: the next confirming row that comes before another submission and within `patience`.

    Outputs: (submission, 'written', confirmation), and (submission, 'unconfirmed', null) once its patience is over: what may have been
    written twice. A written or unconfirmed submission leaves the state at once, so a key holds what `patience` covers.
    """

    schema, out = "numbers ARRAY<BIGINT>, times ARRAY<BIGINT>, open BOOLEAN", "submission BIGINT, outcome STRING, confirmation BIGINT"

    def __init__(self, submits: str, confirms: str, patience_hours: float) -> None:
        self.submits, self.confirms, self.patience = submits, confirms, int(patience_hours * 3_600_000_000)

    def row(self, state: tuple | None, row: Row) -> tuple[tuple | None, list[tuple]]:
        time, number, kind = row
        numbers, times, open_ = state or ([], [], False)
        if kind == self.submits:
            return ([*numbers, number], [*times, time], True), []
        if kind == self.confirms and open_:
            rest = (list(numbers[:-1]), list(times[:-1]), False)
            return rest if rest[0] else None, [(numbers[-1], "written", number)]
        return state, []

    def deadline(self, state: tuple) -> int:
        return state[1][0] + self.patience

    def due(self, state: tuple, now: int) -> tuple[tuple | None, list[tuple]]:
        numbers, times, open_ = state
        rest = (list(numbers[1:]), list(times[1:]), open_ and len(numbers) > 1)
        return rest if rest[0] else None, [(numbers[0], "unconfirmed", None)]


class Changes(Step):
    """Outputs (number, value) for a key's first row and for each that differs from the one before it."""

    schema, out = "value STRING", "number BIGINT, value STRING"

    def row(self, state: tuple | None, row: Row) -> tuple[tuple, list[tuple]]:
        _, number, value = row
        return (value,), [] if state and state[0] == value else [(number, value)]


class _InOrder(StatefulProcessor):
    def __init__(self, step: Step, key: str) -> None:
        self.step, self.columns = step, [key, *(c.split()[0] for c in step.out.split(", "))]

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.step.schema)
        self.waiting = handle.getListState("waiting", _WAITING)

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for batch in rows for r in zip(batch["time_"].tolist(), batch["number_"].tolist(), batch["kind_"].tolist())]
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= now]
        later = rows[len(due) :]
        before = state = tuple(self.state.get()) if self.state.exists() else None
        out: list[tuple] = []
        for row in [*due, None]:
            while state is not None and (at := self.step.deadline(state)) is not None and (at < row[0] if row else at <= now):
                state, found = self.step.due(state, at)
                out += found
            if row:
                state, found = self.step.row(state, row)
                out += found
        if due:
            if later:
                self.waiting.put(later)
                self._wake(later[0][0])
            else:
                self.waiting.clear()
        if state is None and before is not None:
            self.state.clear()
        elif state is not None and state != before:
            self.state.update(state)
        if state is not None and (at := self.step.deadline(state)) is not None:
            self._wake(at)
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=self.columns)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, step: Step, kind: str, number: str = "event_id", time: str = "ts", late: str = "2 days") -> DataFrame:
    """The step's outputs for each key's rows in the order of time and number. Rows later than `late` behind the newest are dropped; null keys are a key."""
    # Spark hands on no names that begin with an underscore
    rows = stream.select(F.col(key).alias("key_"), F.col(time).alias("at_"), F.unix_micros(time).alias("time_"), F.col(number).cast("long").alias("number_"), F.col(kind).cast("string").alias("kind_"))
    rows = rows.where("at_ IS NOT NULL AND number_ IS NOT NULL").withWatermark("at_", late)
    return rows.groupBy("key_").transformWithStateInPandas(_InOrder(step, key), f"`{key}` {stream.schema[key].dataType.simpleString()}, {step.out}", "append", "EventTime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers need: on disk, with changes alone in the checkpoint."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
