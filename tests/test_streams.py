"""Keyed state and restarts against plain models over rows in the order of time."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.errors import StreamingQueryException

from scholia.streaming import state as T
from scholia.streaming import streams as S

HOUR = dt.timedelta(hours=1)


def rows_of(n: int, seed: int) -> list[tuple]:
    r, at = random.Random(seed), dt.datetime(2024, 3, 1)
    rows = []
    for i in range(n):
        at += dt.timedelta(minutes=r.choice([0, 7, 40, 200]))  # some at the same time
        rows.append((i, at, r.choice([1, 2, None]), r.choice(["signup", "view", "purchase"]), 0.0, "{}"))
    return rows


def files(spark, path, rows, parts, seed):
    """The rows in files of about equal times, shuffled inside and over neighbouring files."""
    r = random.Random(seed)
    keyed = sorted(rows, key=lambda x: x[0] + r.uniform(0, len(rows) / parts / 2))
    size = -(-len(keyed) // parts)
    for i in range(0, len(keyed), size):
        spark.createDataFrame(keyed[i : i + size], S.EVENTS).coalesce(1).write.mode("append").parquet(path)


def model(rows, step, mark):
    """The step over each key's rows up to the mark, deadlines in between."""
    micros = lambda t: int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    own, out = defaultdict(list), Counter()
    for i, at, key, kind, *_ in rows:
        own[key].append((micros(at), i, kind))
    end = micros(mark)
    for key, of in own.items():
        events, state = sorted(e for e in of if e[0] <= end), None
        while True:
            at = step.deadline(state) if state is not None else None
            if at is not None and at <= end and (not events or at < events[0][0]):
                state, found = step.due(state, at)
            elif events:
                state, found = step.row(state, events.pop(0))
            else:
                break
            out.update((key, *f) for f in found)
    return out


@pytest.mark.parametrize("step", [T.Expiring("signup", "view", 3), T.Journal("signup", "purchase", 5), T.Changes()], ids=lambda s: type(s).__name__)
def test_steps_see_rows_in_order(spark, tmp_path, step):
    """However rows are dealt to batches within the watermark, nulls as a key among them."""
    rows = rows_of(120, 5)
    files(spark, str(tmp_path / "in"), rows, 4, 3)
    with T.state_store(spark):
        got = S.resumed(T.in_order(S.events(spark, str(tmp_path / "in"), "*.parquet", 1), "user_id", step, "event_type", late="2 days"), str(tmp_path / "run"), [], "append")
    want = model(rows, step, max(r[1] for r in rows) - 48 * HOUR)
    assert Counter(map(tuple, got.collect())) == want and want


def test_journal_counts_by_hand():
    at = lambda h: int(h * 3_600_000_000)
    step = T.Journal("s", "c", 2)
    state, out = step.row(None, (at(0), 1, "s"))
    state, more = step.row(state, (at(1), 2, "s"))
    assert (out, more) == ([], []) and step.deadline(state) == at(2)
    state, out = step.row(state, (at(1.5), 3, "c"))
    assert out == [(2, "written", 3)]
    state, out = step.row(state, (at(1.6), 4, "c"))
    assert out == []
    state, out = step.due(state, at(2))
    assert out == [(1, "unconfirmed", None)] and state is None


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    """A run that dies after a batch was written but not committed: the batch is run again in its place, and no earlier one is."""
    rows = rows_of(80, 9)
    for i in range(0, 80, 20):
        spark.createDataFrame(rows[i : i + 20], S.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ran = []

    def dies(number):
        ran.append(number)
        if len(ran) == 3:
            raise RuntimeError("stopped")

    def run(after):
        stream = S.events(spark, str(tmp_path / "in"), "*.parquet", 1).select("event_id", "event_type")
        return S.resumed(stream, str(tmp_path / "run"), [], "append", after)

    with pytest.raises(StreamingQueryException):
        run(dies)
    got = run(ran.append)
    assert ran == [0, 1, 2, 2, 3]
    assert Counter(map(tuple, got.collect())) == Counter((r[0], r[3]) for r in rows)
    more = rows_of(100, 9)[80:]
    spark.createDataFrame(more, S.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert Counter(map(tuple, run(ran.append).collect())) == Counter((r[0], r[3]) for r in [*rows, *more])
    assert ran == [0, 1, 2, 2, 3, 4]


def test_state_survives_a_stop(spark, tmp_path):
    """Counters of a stream that dies in the middle equal those of one that doesn't."""
    rows = [(i, at, 1 if key is None else key, kind, v, p) for i, at, key, kind, v, p in rows_of(60, 4)]
    for i in range(0, 60, 20):
        spark.createDataFrame(rows[i : i + 20], S.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: S.skip_counters(S.events(spark, str(tmp_path / "in"), "*.parquet", 1), "view", "purchase")

    def dies(number):
        if number == 1:
            raise RuntimeError("stopped")

    with pytest.raises(StreamingQueryException):
        S.resumed(stream(), str(tmp_path / "run"), ["user_id"], after=dies)
    got = S.resumed(stream(), str(tmp_path / "run"), ["user_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.settled(stream(), ["user_id"]).collect()))


def test_unclosed_rows_come_once(spark, tmp_path):
    at = dt.datetime(2024, 3, 1)
    event = lambda i, hours, user, kind: (i, at + hours * HOUR, user, kind, 0.0, "{}")
    batches = [[event(1, 0, 1, "signup"), event(2, 1, 2, "signup"), event(3, 2, 1, "purchase")], [event(4, 60, 3, "signup"), event(5, 61, 9, "purchase")], [event(6, 130, 3, "purchase"), event(7, 131, 4, "signup")]]
    run = lambda: S.resumed(S.closed(*(S.events(spark, str(tmp_path / "in"), "*.parquet", 1).where(f"event_type = '{k}'") for k in ("signup", "purchase")), "user_id", "12 HOURS", how="leftOuter"), str(tmp_path / "run"), [], "append")
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, S.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen.append(sorted(map(tuple, run().collect()), key=repr))
    assert seen[0] == [(1, 1, 3)]
    assert seen[1] == [(1, 1, 3)]  # the watermark is at 12 hours, the deadline of the second at 13
    assert seen[2] == [(1, 1, 3), (2, 2, None), (3, 4, None)]
