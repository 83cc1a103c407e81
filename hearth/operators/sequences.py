"""Ordered rows: bursts of one sender, repeated values, sliding counts, digests since a cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bursts(messages: DataFrame, gap_minutes: float) -> DataFrame:
    """chat, ordinal, sender, ts -> chat, burst, sender, n, first and last ts.

    A burst ends when another sender writes or the gap is exceeded; order is the ordinal, never the time alone.
    """
    w = Window.partitionBy("chat").orderBy("ordinal")
    # microseconds, as a gap of a part of a second counts
    apart = F.expr("timestampdiff(MICROSECOND, before_ts, ts)") > gap_minutes * 60_000_000
    rows = messages.withColumns({"before": F.lag("sender").over(w), "before_ts": F.lag("ts").over(w)})
    rows = rows.withColumn("starts", F.when(F.col("before").isNull() | (F.col("before") != F.col("sender")) | apart, 1).otherwise(0))
    rows = rows.withColumn("burst", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("chat", "burst").agg(F.first("sender").alias("sender"), F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def changed_only(points: DataFrame) -> DataFrame:
    """id, pos, price without points that repeat the price before."""
    before = F.lag("price").over(Window.partitionBy("id").orderBy("pos"))
    return points.withColumn("before", before).filter("before is null or before <> price").drop("before")


def sliding_count(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Events of a key in the given time up to each event."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    w = Window.partitionBy(key).orderBy("us").rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return events.withColumn("us", micros).withColumn("recent", F.count("*").over(w)).drop("us")


def digest(rows: DataFrame, points: DataFrame, since: str) -> DataFrame:
    """New rows by instant, price changes by day after the cursor's day, so changes of that day itself are left out."""
    at = F.lit(since).cast("timestamp_ntz")
    new = rows.filter(F.col("first_seen") >= at).select("id", F.lit("new").alias("kind"), F.col("price_month_idr").alias("price"))
    before = F.lag("price").over(Window.partitionBy("id").orderBy("pos"))
    moved = points.withColumn("before", before).filter((F.col("before") != F.col("price")) & (F.col("day") > at.cast("date")))
    return new.unionByName(moved.select("id", F.lit("price").alias("kind"), "price"))
