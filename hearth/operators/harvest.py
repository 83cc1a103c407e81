"""What a collecting run decides: the best record of several, the queue of work, what to read again, what fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_records(rows: DataFrame, key: list[str], text: str = "text", truncated: str = "truncated") -> DataFrame:
    """One record for each key: whole texts before cut ones, then the longest, then the first text in order."""
    rank = F.struct((~F.coalesce(truncated, F.lit(False))).alias("whole"), F.coalesce(F.length(text), F.lit(-1)).alias("size"), text)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), rank).alias("r")).select(*key, "r.*")


def work_queue(groups: DataFrame, done: DataFrame, today: str, first_days: int = 30, overlap_days: int = 2) -> DataFrame:
    """key, position -> key, since, kind, place: those read before come first (the longest ago first), from a little
    before their last day; new ones follow in the list's order, from further back."""
    rows = groups.join(done.select("key", F.col("day").cast("date").alias("day")), "key", "left")
    since = F.coalesce(F.date_sub("day", overlap_days), F.date_sub(F.lit(today).cast("date"), first_days))
    order = Window.orderBy(F.col("day").isNull(), "day", "position", "key")  # a curated list: hundreds of rows
    return rows.select("key", since.alias("since"), F.when(F.col("day").isNull(), "first").otherwise("again").alias("kind"), F.row_number().over(order).cast("long").alias("place"))


def detail_reason(rows: DataFrame, now: str, ttl_days: int = 7) -> DataFrame:
    """Why a row's detail page is read again: new, changed price, stale, its weekly day; null if it isn't."""
    age = F.datediff(F.lit(now).cast("date"), F.col("detail_at").cast("date"))
    reason = (
        F.when(F.col("detail_at").isNull(), "new")
        .when(~F.col("card_price").eqNullSafe(F.col("price")) & F.col("card_price").isNotNull(), "price")
        .when(age >= ttl_days, "stale")
        .when(F.col("refresh_day") == F.weekday(F.lit(now).cast("date")), "weekly")
    )
    return rows.withColumn("reason", reason)


def within_bytes(rows: DataFrame, budget: int, group: str, order: list, size: str = "bytes") -> DataFrame:
    """The rows of each group whose running size stays within the budget, in order."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__used", F.sum(size).over(before)).filter(F.col("__used") <= budget).drop("__used")


def viewing_flags(viewings: DataFrame, key: str) -> DataFrame:
    """Red flags that people's scores give: low quiet and privacy, construction near by; sorted and distinct."""
    flag = F.array_compact(F.array(F.when(F.col("quiet") <= 2, "quiet_low"), F.when(F.col("privacy") <= 2, "privacy_low"), F.when(F.col("construction") >= 4, "construction")))
    return viewings.select(key, F.explode(flag).alias("flag")).groupBy(key).agg(F.array_sort(F.collect_set("flag")).alias("flags"))


def assessed_state(states: DataFrame, key: str, state: str, order: tuple[str, ...] = ("not_yet", "partly", "done")) -> DataFrame:
    """The furthest state that was reached: never downgraded."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(state))
    return states.groupBy(key).agg(F.max_by(state, place).alias(state))


def earliest(rows: DataFrame, late: DataFrame, key: str, column: str) -> DataFrame:
    """Late data may pull a first date back, never forward."""
    found = late.groupBy(key).agg(F.min(column).alias("__late"))
    return rows.join(found, key, "left").withColumn(column, F.least(column, "__late")).drop("__late")


def merged_lists(rows: DataFrame, key: str, column: str) -> DataFrame:
    """The union of array columns, sorted."""
    return rows.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(column))
