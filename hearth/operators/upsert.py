"""Keyed snapshots: upsert with rules for each column, removal by staleness, guards and refresh slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a source's non-null value overwrites, and those that it only fills.
FACTS = ("title", "price_month_idr", "availability", "build_m2")
FILLED = ("land_m2", "furniture_quality")


def upsert(existing: DataFrame, incoming: DataFrame, now: str, facts=FACTS, filled=FILLED) -> DataFrame:
    """Existing rows by id with the batch merged in; action is inserted, updated, unchanged or absent.

    Facts overwrite where the batch has a value; filled columns keep what people set; merged rows keep their
    availability; a price that changes adds a point to the history; last_seen always moves for rows of the batch.
    """
    e, i = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for p, df in (("e", existing), ("i", incoming)))
    both = e.join(i, F.col("e_id") == F.col("i_id"), "full_outer")
    old, new, absent = F.col("e_id").isNotNull(), F.col("i_id").isNotNull(), F.col("i_id").isNull()
    merged = F.col("e_merged_into").isNotNull()

    def fact(c: str) -> Column:
        taken = F.coalesce(f"i_{c}", f"e_{c}")
        return F.when(merged, F.coalesce(f"e_{c}", f"i_{c}")).otherwise(taken) if c == "availability" else taken

    values = {c: fact(c) for c in facts} | {c: F.coalesce(f"e_{c}", f"i_{c}") for c in filled}
    changed = [~F.col(f"e_{c}").eqNullSafe(v) for c, v in values.items()]
    any_change = changed[0]
    for c in changed[1:]:
        any_change = any_change | c
    action = F.when(absent, "absent").when(~old, "inserted").when(any_change, "updated").otherwise("unchanged")
    new_price = F.col("i_price_month_idr").isNotNull() & ~F.col("i_price_month_idr").eqNullSafe(F.col("e_price_month_idr"))
    point = F.array(F.struct(F.lit(now).cast("date").alias("day"), F.col("i_price_month_idr").alias("price")))
    history = F.coalesce("e_history", F.array().cast("array<struct<day:date,price:bigint>>"))
    back = old & new & ~merged & F.col("e_availability").isin("gone", "unlisted") & ~F.col("i_availability").isin("gone", "unlisted")
    return both.select(
        F.coalesce("e_id", "i_id").alias("id"),
        *[v.alias(c) for c, v in values.items()],
        F.when(new_price, F.concat(history, point)).otherwise(history).alias("history"),
        F.when(new, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("e_last_seen")).alias("last_seen"),
        F.when(F.coalesce(back, F.lit(False)), None).otherwise(F.col("e_removed_at")).alias("removed_at"),
        F.coalesce("e_merged_into", "i_merged_into").alias("merged_into"),
        action.alias("action"),
    )


def mark_unlisted(rows: DataFrame, clean_sources: list[str], now: str, days: int = 3) -> DataFrame:
    """Rows of sources that were read without an error and that they no longer list become unlisted."""
    stale = F.col("source").isin(*clean_sources) & (F.col("availability") == "available") & (F.col("last_seen") < F.expr(f"TIMESTAMP_NTZ'{now}' - INTERVAL {days} DAYS"))
    return rows.withColumn("availability", F.when(stale, "unlisted").otherwise(F.col("availability"))).withColumn("removed_at", F.when(stale & F.col("removed_at").isNull(), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("removed_at")))


def silent_sources(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Sources with live rows that list none: an error rather than an empty market."""
    live = existing.filter("availability = 'available'").groupBy("source").agg(F.count("*").alias("live"))
    return live.join(batch.select("source").distinct(), "source", "left_anti")


def refresh_day(key: Column) -> Column:
    """A day of the week from 0 to 6, spread by the key's SHA-1."""
    return (F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") % 7).cast("int")


def merge_values(keep: DataFrame, gone: DataFrame, filled: list[str]) -> DataFrame:
    """The keeper's values, its gaps filled from the rows merged into it (smallest id first)."""
    lost = gone.groupBy(F.col("merged_into").alias("id")).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"g_{c}") for c in filled])
    out = keep.join(lost, "id", "left")
    return out.select("id", *[F.coalesce(c, f"g_{c}").alias(c) for c in filled])
