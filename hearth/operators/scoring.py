"""Scoring of rows against a brief, and learning of weights from feedback."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.config import BRIEF, Brief
from hearth.functions.semantics import half_up

# Shares and limits of the score.
BEACH_FULL_KM = 1
LAND_ZERO, LAND_FULL = 200, 500
PRICE_ZERO_LOW, PRICE_FULL_LOW, PRICE_FULL_HIGH, PRICE_ZERO_HIGH = 30_000_000, 50_000_000, 70_000_000, 80_000_000
VIEW_SHARE = {"ocean": 1.0, "rice": 1.0, "river": 0.7, "jungle": 0.5}
STYLE_SHARE = {"joglo": 1.0, "bamboo": 1.0, "tropical": 0.7}
POCKET_PENALTY = 10
FULL_OR_HALF = ("living_open", "airy", "kitchen_full", "aircon")
FULL_ONLY = ("pool", "garden", "workspace", "joglo")


def ramp(x: Column, zero: float, full: float) -> Column:
    """0 at zero, 1 at full and between them on a line."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - zero) / float(full - zero)))


def factors(brief: Brief = BRIEF) -> dict[str, Column]:
    price = F.col("price_month_idr")
    return {
        "beach": F.coalesce(ramp(F.col("beach_km"), brief.beach_km_max * 2, BEACH_FULL_KM), F.lit(0.5)),
        "land": F.when(F.col("land_m2") > 0, ramp(F.col("land_m2"), LAND_ZERO, LAND_FULL)).otherwise(0.5),
        "price": F.when(price > 0, F.least(ramp(price, PRICE_ZERO_LOW, PRICE_FULL_LOW), ramp(price, PRICE_ZERO_HIGH, PRICE_FULL_HIGH))).otherwise(0.5),
    }


def share_of(column: str, shares: dict[str, float], weight: int) -> Column:
    return reduce(lambda c, x: F.when(F.col(column) == x[0], int(weight * x[1] + 0.5)).otherwise(c), shares.items(), F.lit(0))


def points(brief: Brief = BRIEF) -> Column:
    w = brief.weights
    parts = [F.floor(f * w[name] + 1e-9) for name, f in factors(brief).items()]
    parts += [F.when(F.col(k) == 1, w[k]).when(F.col(k).isNull(), w[k] // 2).otherwise(0) for k in FULL_OR_HALF]
    parts += [F.when(F.col(k) == 1, w[k]).otherwise(0) for k in FULL_ONLY]
    parts += [share_of("view_kind", VIEW_SHARE, w["view"]), share_of("style", STYLE_SHARE, w["style"])]
    half, quality = w["furniture"] // 2, F.col("furniture_quality")
    parts.append(F.when(F.col("furnished") == 1, F.when(quality >= 3, w["furniture"]).when(quality.isNull(), half).otherwise(0)).when(F.col("furnished").isNull(), half).otherwise(0))
    in_pocket = reduce(lambda c, p: c | F.coalesce(F.contains(F.lower("sub_area"), F.lit(p.lower())), F.lit(False)), brief.pockets, F.lit(False))
    return reduce(add, parts) - F.when(in_pocket, POCKET_PENALTY).otherwise(0)


def fit_score(brief: Brief = BRIEF) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(points(brief) * 100 / float(sum(brief.weights.values()))))).cast("int")


def fails(brief: Brief = BRIEF) -> Column:
    """Names of the hard filters that a row fails; an unknown value fails."""
    rooms = F.col("bedrooms").between(1, 3) & (F.col("bedrooms") + F.coalesce("extra_rooms", F.lit(0)) >= 2)
    tests = {"rooms": rooms, "budget": F.col("price_month_idr").between(brief.budget_min, brief.budget_max), "area": F.col("area").isin(*brief.areas), "style": F.coalesce(F.col("style") != "balinese_old", F.lit(True))}
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in tests.items()]))


def reasons() -> Column:
    """Short strings for people."""
    million = half_up(F.col("price_month_idr") / 1e6, 1)
    shown = F.when(million == F.floor(million), F.floor(million).cast("string")).otherwise(million.cast("string"))
    rooms = F.concat(F.col("bedrooms").cast("string"), F.lit("BR"), F.when(F.col("extra_rooms") > 0, F.concat(F.lit(" +"), F.col("extra_rooms").cast("string"))).otherwise(""))
    view = reduce(lambda c, x: F.when(F.col("view_kind") == x[0], x[1]).otherwise(c), {"ocean": "ocean view", "rice": "ricefield view", "river": "river view", "jungle": "jungle view"}.items(), F.lit(None).cast("string"))
    has = lambda c: F.when(F.col(c) == 1, c)
    return F.array_compact(F.array(rooms, F.when(F.col("area") != "other", F.col("area")), F.concat(F.col("beach_km").cast("string"), F.lit(" km to beach")), F.concat(shown, F.lit(" M/mo")), has("pool"), has("garden"), view, has("joglo"), has("workspace")))


def score_rows(listings: DataFrame, brief: Brief = BRIEF) -> DataFrame:
    """id, scope, fit_score, over_budget, flagged, fails and reasons, in one projection."""
    failed = fails(brief)
    rows = listings.withColumns({"failed": failed, "fit_score": fit_score(brief)})
    rows = rows.withColumn("scope", F.when(F.size("failed") == 0, "in_filter").otherwise("market")).withColumn("over_budget", F.coalesce(F.col("price_month_idr") > brief.budget_max, F.lit(False)))
    kept = ~F.col("availability").isin("gone", "unlisted") & ~F.col("status").isin("gone", "rejected")
    flagged = (F.col("scope") == "in_filter") & (F.col("fit_score") >= brief.flag_threshold) & ~F.col("over_budget") & kept
    return rows.select("id", "scope", "fit_score", "over_budget", flagged.cast("int").alias("flagged"), F.concat_ws(",", "failed").alias("fails"), F.concat_ws(", ", reasons()).alias("reasons"))


def learned_weights(feedback: DataFrame, weights: dict[str, int], cap: int = 20) -> DataFrame:
    """feedback: feature, negative -> feature, delta, weight. Complaints add 2, praise adds 1, up to the cap."""
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    delta = feedback.groupBy("feature").agg(F.sum(F.when(F.col("negative"), 2).otherwise(1)).alias("delta"))
    old = F.try_element_at(known, F.col("feature"))
    return delta.filter(old.isNotNull()).select("feature", "delta", F.greatest(old, F.least(F.lit(cap), old + F.col("delta"))).cast("int").alias("weight"))
