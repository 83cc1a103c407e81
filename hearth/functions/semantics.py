"""The rules that all operators share: rounding, medians, bands, calendar keys and the predicates of a live row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.config import BRIEF, Brief

LOCAL_HOURS = 8


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) if digits == 0 else F.floor(x * scale + 0.5) / float(scale)


def nearest_rank(p: float, column: str, kind: str = "bigint", where: str | None = None) -> Column:
    """The nearest-rank percentile: an element of the data, null without any."""
    only = f" FILTER (WHERE {where})" if where else ""
    return F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY {column}){only} AS {kind})")


def price_box(column: str = "price_month_idr", kind: str = "bigint") -> list[Column]:
    return [F.count(column).alias("n"), *[nearest_rank(p, column, kind).alias(n) for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))]]


def local_day(ts: Column) -> Column:
    """The calendar day eight hours east of UTC, all year."""
    return (ts + F.expr(f"INTERVAL {LOCAL_HOURS} HOURS")).cast("date")


def local_month(ts: Column) -> Column:
    return F.date_format(local_day(ts), "yyyy-MM")


def iso_week(day: Column) -> Column:
    """YYYY-Www with the year of the ISO week."""
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def banded(x: Column, edges: list[tuple[float, str]], last: str, unknown: str | None = None) -> Column:
    """The label of the first edge above x; last beyond all; unknown for null."""
    out = reduce(lambda c, e: c.when(x < e[0], e[1]), edges, F.when(x.isNull(), F.lit(unknown)))
    return out.otherwise(last)


def price_band(x: Column) -> Column:
    return banded(x, [(30_000_000, "<30"), (40_000_000, "30-40"), (50_000_000, "40-50")], "50+")


def beach_band(x: Column) -> Column:
    return banded(x, [(1, "0-1"), (2, "1-2"), (4, "2-4")], "4+", "unknown")


def br_group(bedrooms: Column) -> Column:
    return F.when(bedrooms >= 4, "4+").when(bedrooms >= 1, bedrooms.cast("string"))


def not_gone() -> Column:
    return F.coalesce(F.col("availability") != "gone", F.lit(True))


def on_market() -> Column:
    return ~F.coalesce(F.col("availability").isin("gone", "unlisted"), F.lit(False))


def not_merged() -> Column:
    return F.col("merged_into").isNull()


def live_by_person() -> Column:
    return on_market() & (F.col("status") != "gone")


def in_band(brief: Brief = BRIEF) -> Column:
    """The aggregation band; what is unknown fails it."""
    inside = F.col("bedrooms").between(*brief.band_bedrooms) & F.col("price_month_idr").between(*brief.band_price) & F.col("area").isin(*brief.areas)
    return F.coalesce(inside, F.lit(False))


def market_base(listings: DataFrame, brief: Brief = BRIEF) -> DataFrame:
    """Rows of the market metrics: removed ones stay, merged ones go."""
    return listings.filter(not_merged() & in_band(brief))


def with_total(df: DataFrame, key: str = "area", total: str = "all") -> DataFrame:
    """Every row once under its key and once under the total."""
    return df.withColumn(key, F.explode(F.array(F.col(key), F.lit(total))))


def month_spine(spark: SparkSession, months: int, today: str) -> DataFrame:
    start = F.add_months(F.trunc(F.lit(today).cast("date"), "month"), -(months - 1))
    return spark.range(1).select(F.explode(F.sequence(start, F.lit(today).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))


def week_spine(spark: SparkSession, weeks: int, today: str) -> DataFrame:
    end = F.lit(today).cast("date")
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(end, 7 * (weeks - 1)), end, F.expr("INTERVAL 7 DAYS"))).alias("d")).select(iso_week(F.col("d")).alias("week"))


def day_spine(spark: SparkSession, days: int, end: str) -> DataFrame:
    last = F.lit(end).cast("date")
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
