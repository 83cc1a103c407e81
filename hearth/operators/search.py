"""Filtered search: predicates that unknown values pass or fail, orders with unknown values last, pages, verdicts."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.config import REMOVAL_REASONS, STATUSES
from hearth.functions.semantics import half_up

#: Feature name -> condition.
FEATURES = {
    "pool": "pool = 1",
    "garden": "garden = 1",
    "joglo": "joglo = 1",
    "aircon": "aircon = 1",
    "kitchen_full": "kitchen_full = 1",
    "workspace": "workspace = 1",
    "living_open": "living_open = 1",
    "ocean_view": "view_kind = 'ocean'",
    "rice_view": "view_kind = 'rice'",
}
ORDERS = {
    "fit": [("stored_fit", True), ("price_month_idr", False)],
    "price": [("price_month_idr", False)],
    "beach": [("beach_km", False)],
    "new": [("first_seen", True)],
    "size": [("build_m2", True), ("land_m2", True)],
    "removed": [("gone_at", True)],
}


def removed_at() -> Column:
    """When a row left the market: the stored stamp, or when it was last seen."""
    return F.coalesce("removed_at", F.when(F.col("availability").isin("gone", "unlisted") | (F.col("status") == "gone"), F.col("last_seen")))


def removed_reason() -> Column:
    seen = F.when(F.col("availability") == "unlisted", "unlisted").when(F.col("availability") == "gone", "delisted").when(F.col("status") == "gone", "taken")
    return F.coalesce("removed_reason", seen)


def at_most(column: str, value) -> Column:
    """Unknown passes."""
    return F.col(column).isNull() | (F.col(column) <= value)


def at_least(column: str, value) -> Column:
    return F.col(column).isNull() | (F.col(column) >= value)


def contains_text(text: str, columns=("title", "description", "sub_area", "ref")) -> Column:
    """Substring, ASCII case ignored; % and _ are plain characters."""
    like = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return reduce(or_, [F.coalesce(F.col(c).ilike(like), F.lit(False)) for c in columns])


def known(values: list[str], allowed: list[str], what: str) -> list[str]:
    wrong = sorted(set(values) - set(allowed))
    if wrong:
        raise ValueError(f"unknown {what}: {', '.join(wrong)}")
    return values


def terms(wanted: list[str]) -> Column:
    """monthly, yearly and sale; all three are no filter. Without sale, rows for sale go."""
    rent, sale = [t for t in known(wanted, ["monthly", "yearly", "sale"], "term") if t != "sale"], "sale" in wanted
    if len(rent) == 2 and sale:
        return F.lit(True)
    offers = [F.lit(True)] if len(rent) == 2 else [F.col("term").isin(rent[0], "both")] if rent else []
    offers += [F.col("for_sale") == 1] if sale else []
    out = reduce(or_, offers)
    return out if sale else out & (F.col("for_sale") == 0)


def predicate(
    scope: str = "in_filter", status: list[str] | None = None, area: list[str] | None = None, price: tuple | None = None, beach: float | None = None,
    land: tuple | None = None, build: tuple | None = None, bedrooms: list[int] | None = None, features: list[str] | None = None, style: list[str] | None = None,
    furnished: int | None = None, term: list[str] | None = None, source: str | None = None, flagged: bool = False, q: str | None = None,
    first_seen_since: str | None = None, removed: str = "hide", reason: list[str] | None = None, removed_since: str | None = None,
) -> Column:
    """One condition from the given filters; ranges are (least, most), either may be None."""
    out = [F.lit(True)]
    if scope != "all":
        out.append(F.col("scope") == known([scope], ["in_filter", "market"], "scope")[0])
    if status is None:
        out.append(~F.col("status").isin("rejected", "gone"))
    elif status != ["all"]:
        out.append(F.col("status").isin(*known(status, STATUSES, "status")))
    for column, values in (("area", area), ("bedrooms", bedrooms), ("style", style)):
        if values:
            out.append(F.col(column).isin(*values))
    if price:  # a row without a price fails
        out += [F.col("price_month_idr") >= price[0]] * (price[0] is not None) + [F.col("price_month_idr") <= price[1]] * (price[1] is not None)
    for column, bounds in (("beach_km", (None, beach)), ("land_m2", land), ("build_m2", build)):
        if bounds:
            out += [at_least(column, bounds[0])] * (bounds[0] is not None) + [at_most(column, bounds[1])] * (bounds[1] is not None)
    out += [F.expr(FEATURES[f]) for f in known(features or [], list(FEATURES), "feature")]
    if furnished is not None:
        out.append(F.col("furnished") == furnished)
    if term:
        out.append(terms(term))
    if source:
        out.append(F.col("source") == source)
    if flagged:
        out.append(F.col("flagged") == 1)
    if q and q.strip():
        out.append(contains_text(q.strip()))
    if first_seen_since:
        out.append(F.col("first_seen") >= F.lit(first_seen_since).cast("timestamp_ntz"))
    gone = F.col("availability").isin("gone", "unlisted") | (F.col("status") == "gone")
    if known([removed], ["hide", "show", "only"], "removed") == ["hide"]:
        out.append(~gone)
    else:
        out += [gone] * (removed == "only") + [F.col("merged_into").isNull()]
    if reason:
        out.append(removed_reason().isin(*known(reason, REMOVAL_REASONS, "reason")))
    if removed_since:
        out.append(removed_at() >= F.lit(removed_since).cast("timestamp_ntz"))
    return reduce(and_, out)


def ordered(rows: DataFrame, order: str = "fit", live_first: bool = False) -> DataFrame:
    """A named order: unknown values last, then the larger id."""
    rows = rows.withColumn("gone_at", removed_at()) if order == "removed" else rows
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in ORDERS[order]]
    live = [F.when(F.col("availability").isin("gone", "unlisted") | (F.col("status") == "gone"), 1).otherwise(0)] if live_first else []
    return rows.orderBy(*live, *keys, F.desc("id"))


def page(rows: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    return ordered(rows, order).offset(offset).limit(limit)


def within(lat: float, lng: float, km: float) -> Column:
    """Near a point, in squared degrees: no trigonometry per row."""
    import math

    squeeze = math.cos(math.radians(lat))
    return ((F.col("lat") - lat) ** 2 + ((F.col("lng") - lng) * squeeze) ** 2) <= (km / 111.32) ** 2


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lng2 - lng1) / 2) ** 2
    return 2 * 6371 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def latest_verdicts(votes: DataFrame) -> DataFrame:
    """votes: item, voter, verdict, at, seq -> the last of each voter on each item."""
    last = F.max_by(F.struct("verdict", "at"), F.struct("at", "seq")).alias("v")
    return votes.groupBy("item", "voter").agg(last).select("item", "voter", "v.verdict", "v.at")


def my_and_theirs(verdicts: DataFrame, me: int, team: Column) -> DataFrame:
    """item, mine, other: the caller's verdict, and the last one of a team mate."""
    mine = F.max(F.when(F.col("voter") == me, F.col("verdict"))).alias("mine")
    other = F.max_by(F.when((F.col("voter") != me) & team, F.col("verdict")), F.when((F.col("voter") != me) & team, F.struct("at", "voter"))).alias("other")
    return verdicts.groupBy("item").agg(mine, other)


def verdict_mode() -> dict[str, Column]:
    """Mode -> condition on mine and other."""
    m, o = F.col("mine"), F.col("other")
    said = lambda v: F.coalesce(m == v, F.lit(False)) | F.coalesce(o == v, F.lit(False))
    return {
        "match": (m == "yes") & (o == "yes"),
        "waiting_other": m.isNotNull() & (m != "no") & o.isNull(),
        "waiting_me": m.isNull() & o.isNotNull(),
        "disagree": m.isNotNull() & o.isNotNull() & (m != o),
        "yes": said("yes"),
        "maybe": said("maybe"),
        "no": said("no"),
        "not_no": ~said("no"),
        "unvoted": m.isNull() & o.isNull(),
    }


def value_fields(listings: DataFrame) -> DataFrame:
    """Price per m², gap to the area's median of it, and what a year saves."""
    priced = listings.filter("price_month_idr is not null and build_m2 > 0").withColumn("m2", F.col("price_month_idr") / F.col("build_m2"))
    live = priced.filter(~F.col("availability").isin("gone", "unlisted"))
    medians = live.groupBy("area").agg(half_up(F.median("m2")).alias("area_m2"))
    rows = priced.join(F.broadcast(medians), "area", "left")  # a row for each area
    gap = half_up(F.try_divide((F.col("m2") - F.col("area_m2")) * 100, F.col("area_m2")))
    saves = F.when(F.col("price_year_idr") > 0, half_up((1 - F.col("price_year_idr") / (F.col("price_month_idr") * 12)) * 100))
    return rows.select("id", half_up(F.col("m2")).alias("price_per_m2"), "area_m2", gap.alias("vs_area_pct"), saves.alias("yearly_saving_pct"))


def overlay(listings: DataFrame, states: DataFrame, team: int) -> DataFrame:
    """A team's own status over the shared rows; the home team (0) sees the rows' own."""
    own = states.filter(F.col("team") == team).select("id", F.col("status").alias("own_status"))
    return listings.join(own, "id", "left").withColumn("status", F.coalesce("own_status", F.col("status") if team == 0 else F.lit("new"))).drop("own_status")


def nearest_of(rows: DataFrame, points: list[tuple[str, float, float]], road_factor: float = 1.3) -> DataFrame:
    """id, nearest point's name, km: the points (name, lat, lng) are a short list, so nothing is joined or shuffled."""
    each = F.array(*[F.struct(haversine_km(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng)).alias("km"), F.lit(name).alias("name")) for name, lat, lng in points])
    best = F.array_min(each)
    return rows.select("id", best["name"].alias("name"), half_up(best["km"] * road_factor, 1).alias("km"))
