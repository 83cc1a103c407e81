"""Queries of streams over several runs, with cursors and timers, and their SQL."""

import uuid

from pyspark.sql import functions as F

from hearth.plans.registry import query
from hearth.session import shared_dir, table
from hearth.streaming import cursors as C
from hearth.streaming import events as X
from hearth.streaming import presence as P


@query("SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN event_id * 2 ELSE event_id END AS value, CAST(CASE WHEN event_id <= (SELECT max(event_id) // 2 FROM events) THEN 0 ELSE 1 END AS BIGINT) AS batch FROM events")
def cursor_runs(spark, sf_dir):
    """Two runs over a growing table: the first sees half of the events, the second all, and each does what is new."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    half = events.agg(F.floor(F.max("event_id") / 2)).first()[0]
    work = lambda rows: rows.withColumn("value", F.when(F.col("event_id") % 2 == 0, F.col("event_id") * 2).otherwise(F.col("event_id")))
    sink = C.CursorSink(spark, f"{shared_dir(spark)}/hearth-cursor-{uuid.uuid4().hex}", "event_id bigint, user_id bigint, value bigint")
    for seen in (events.filter(F.col("event_id") <= half), events, events):
        C.advance(sink, seen, "event_id", work)
    return sink.rows().select("event_id", "user_id", "value", "batch")


def _quarters(rows):
    """Conditions that part the rows' time into four."""
    low, high = rows.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    part = F.least(F.lit(3), F.floor((F.unix_micros("ts") - low) * 4 / F.lit(max(1, high - low))))
    return [part == i for i in range(4)], part


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_repeated_import(spark, sf_dir):
    """Four exports, each with what the one before it had once more: every event comes out once."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "event_type", "ts")
    _, part = _quarters(rows)
    return X.run_in_slices(rows, [part.isin(i - 1, i) for i in range(4)], lambda s: X.first_of_each(s, "event_id", "60 days").select("event_id", "user_id", "event_type"))


@query(
    """WITH S AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id, date_trunc('milliseconds', ts) AS ts FROM events),
  G AS (SELECT id, ts, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM S WINDOW w AS (PARTITION BY id ORDER BY ts))
  SELECT id, 'listed' AS state, ts AS at FROM G WHERE before IS NULL OR ts > before + INTERVAL 3 DAY
  UNION ALL SELECT id, 'unlisted', ts + INTERVAL 3 DAY FROM G WHERE coalesce(after > ts + INTERVAL 3 DAY, ts + INTERVAL 3 DAY < (SELECT max(ts) - INTERVAL 1 DAY FROM S))"""
)
def stream_presence(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    with P.rocksdb(spark):
        told = X.run_in_slices(rows, _quarters(rows)[0], P.presence)
    return told.withColumn("at", F.col("at").cast("timestamp_ntz"))
