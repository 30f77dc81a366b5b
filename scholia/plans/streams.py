"""Streams over the event files, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.catalog import load
from scholia.durable import new_folder
from scholia.registry import query
from scholia.streaming import state as T
from scholia.streaming import streams as S


@query("stream_windows", """SELECT CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS start_us, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(38, 6))) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = S.settled(S.windows(S.events(spark, sf), "event_type", late="40 days"), ["start", "event_type"])
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("stream_sliding", """WITH w AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s, event_type FROM events) SELECT CAST(epoch_us(s) AS BIGINT) AS start_us, event_type, count(*) AS n FROM w GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    out = S.settled(S.windows(S.events(spark, sf), "event_type", "2 days", "1 day", "40 days"), ["start", "event_type"])
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    # in batch and stream alike; a stream gives sessions once they are closed, so the batch form is the one compared
    rows = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.sessions(rows, "user_id").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("stream_distinct", """SELECT DISTINCT user_id, event_type FROM events""")
def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return S.settled(S.distinct(S.events(spark, sf), ["user_id", "event_type"], "40 days").select("user_id", "event_type"), [], "append")


@query("stream_last_value", """SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id""")
def stream_last_value(spark: SparkSession, sf: str) -> DataFrame:
    return S.settled(S.last_values(S.events(spark, sf), "user_id", "event_type", "event_id"), ["user_id"])


@query("stream_closed", """SELECT a.user_id AS k, a.event_id AS open_id, b.event_id AS close_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR""")
def stream_closed(spark: SparkSession, sf: str) -> DataFrame:
    a, b = S.events(spark, sf).where("event_type = 'signup'"), S.events(spark, sf).where("event_type = 'purchase'")
    return S.settled(S.closed(a, b, "user_id", "12 HOURS", "40 days"), [], "append")


@query("stream_state_counter", """WITH e AS (SELECT user_id, event_type, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS answers FROM events),
g AS (SELECT user_id, answers, count(*) FILTER (event_type = 'view') AS skips FROM e GROUP BY user_id, answers), l AS (SELECT user_id, max(answers) AS answers, sum(skips // 3) AS auto, arg_max(skips % 3, answers) AS skips FROM g GROUP BY user_id)
SELECT user_id, CAST(skips AS INTEGER) AS skips, CAST(answers AS INTEGER) AS answers, CAST(auto AS INTEGER) AS auto_skips FROM l""")
def stream_state_counter(spark: SparkSession, sf: str) -> DataFrame:
    return S.settled(S.skip_counters(S.events(spark, sf), "view", "purchase"), ["user_id"])


def _restarted(spark: SparkSession, sf: str, step: T.Step) -> DataFrame:
    """The step over the events by user, in two runs on one checkpoint: the second half of the time is there only after the first run has ended."""
    run = new_folder(spark, "run")
    with T.state_store(spark):
        for at in S.in_parts(load(spark, sf, "events"), 2):
            out = S.resumed(T.in_order(S.events(spark, at, "*.parquet"), "user_id", step, "event_type"), run, [], "append")
    return out


#: What has been handed over when all events are read: up to the watermark, two days behind the newest, in whole milliseconds.
_PASSED = "p AS (SELECT epoch_ms(max(epoch_us(ts)) // 1000 - 172800000) AS mark FROM events)"


@query("stream_expiring", f"""WITH {_PASSED}, e AS (SELECT * FROM events, p WHERE ts <= mark),
o AS (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM e WHERE event_type = 'signup'),
a AS (SELECT user_id, event_id, event_type, ts, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER u AS entry, max(CASE WHEN event_type = 'signup' THEN ts END) OVER u AS opened FROM e WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id AS number, CASE WHEN ts - opened <= INTERVAL 12 HOUR THEN 'found' ELSE 'missing' END AS outcome, CASE WHEN ts - opened <= INTERVAL 12 HOUR THEN entry END AS entry FROM a WHERE event_type = 'view'
UNION ALL SELECT user_id, event_id, 'expired', event_id FROM o, p WHERE (next IS NULL OR next - ts > INTERVAL 12 HOUR) AND ts + INTERVAL 12 HOUR <= mark""")
def stream_expiring(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's last sign-up is an entry for twelve hours: views find it or not, and it is dropped by a timer."""
    return _restarted(spark, sf, T.Expiring("signup", "view", 12))


@query("stream_journal", f"""WITH {_PASSED}, e AS (SELECT * FROM events, p WHERE ts <= mark AND event_type IN ('signup', 'purchase')),
s AS (SELECT *, lead(event_type) OVER u AS next_type, lead(ts) OVER u AS next_ts, lead(event_id) OVER u AS next_id FROM e WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
j AS (SELECT user_id, event_id AS submission, ts, mark, next_id, next_type = 'purchase' AND next_ts - ts <= INTERVAL 24 HOUR AS written FROM s WHERE event_type = 'signup')
SELECT user_id, submission, CASE WHEN written THEN 'written' ELSE 'unconfirmed' END AS outcome, CASE WHEN written THEN next_id END AS confirmation FROM j WHERE written OR ts + INTERVAL 24 HOUR <= mark""")
def stream_journal(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups are submissions that the user's next purchase confirms within a day, unless another comes between."""
    return _restarted(spark, sf, T.Journal("signup", "purchase", 24))


@query("stream_changes", f"""WITH {_PASSED} SELECT user_id, event_id AS number, event_type AS value FROM events, p WHERE ts <= mark
QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type""")
def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What is pushed: a user's kind of event, whenever it is another than before."""
    return _restarted(spark, sf, T.Changes())


@query("stream_unclosed", """WITH p AS (SELECT min(m) - INTERVAL 2 DAY AS mark FROM (SELECT max(ts) AS m FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY event_type)),
c AS (SELECT a.user_id AS k, a.event_id AS open_id, a.ts, b.event_id AS close_id FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR WHERE a.event_type = 'signup')
SELECT k, open_id, close_id FROM c, p WHERE close_id IS NOT NULL OR ts + INTERVAL 12 HOUR < mark""")
def stream_unclosed(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups with the purchases of the next twelve hours, and those without any once these have passed; a restart comes between."""
    run = new_folder(spark, "run")
    for at in S.in_parts(load(spark, sf, "events"), 2):
        a, b = (S.events(spark, at, "*.parquet").where(F.col("event_type") == kind) for kind in ("signup", "purchase"))
        out = S.resumed(S.closed(a, b, "user_id", "12 HOURS", how="leftOuter"), run, [], "append")
    return out


@query("new_files", """SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0""")
def new_files(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of files that come to a folder between two runs; a third run finds nothing new."""
    docs, at, run = load(spark, sf, "documents").select("doc_id", "text"), new_folder(spark, "inbox"), new_folder(spark, "run")
    found = []
    for part in ("doc_id % 3 <> 0", "doc_id % 3 = 0", "false"):
        docs.where(part).write.mode("append").json(at)
        found.append(S.discovered(spark, at, f"{run}", "json", "doc_id BIGINT, text STRING", "*.json"))
    return found[1].unionByName(found[2]).select("doc_id", "text")


@query("expired_jobs", """SELECT event_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 15 DAY""")
def expired_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """What has been open for longer than its time to live."""
    return load(spark, sf, "events").where("event_type = 'signup' AND ts < TIMESTAMP_NTZ '2024-01-30 00:00:00' - INTERVAL 15 DAYS").select("event_id")
