"""Market metrics: price boxes, trends, flows, premiums, discounts and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.config import ACTIVE_STATUSES, BRIEF, LEAD_BUCKETS, PREMIUM_FEATURES, PRICE_BANDS, STATUSES, Brief
from hearth.functions.semantics import beach_band, br_group, half_up, in_band, iso_week, local_day, local_month, market_base, month_spine, nearest_rank, not_gone, on_market, price_band, price_box, week_spine


def market_rows(listings: DataFrame, brief: Brief = BRIEF) -> DataFrame:
    return listings.filter(not_gone() & in_band(brief))


def price_box_by(listings: DataFrame, key: Column | str, brief: Brief = BRIEF) -> DataFrame:
    """n, p25, median, p75 and rows in the filter for each key."""
    return market_rows(listings, brief).groupBy(key).agg(*price_box(), F.count_if(F.col("scope") == "in_filter").alias("n_in_filter"))


def feature_premium(listings: DataFrame, brief: Brief = BRIEF) -> DataFrame:
    """Median price with and without each feature; unknown counts as without neither."""
    rows = market_rows(listings, brief).unpivot(["price_month_idr"], PREMIUM_FEATURES, "feature", "has")
    return rows.groupBy("feature").agg(
        nearest_rank(0.5, "price_month_idr", where="has = 1").alias("median_with"),
        nearest_rank(0.5, "price_month_idr", where="has = 0").alias("median_without"),
        F.count_if(F.col("has") == 1).alias("n_with"),
        F.count_if(F.col("has") == 0).alias("n_without"),
    )


def shortlist_vs_median(listings: DataFrame, brief: Brief = BRIEF) -> DataFrame:
    medians = price_box_by(listings, "area", brief).select("area", F.col("median").alias("area_median"))
    rows = listings.filter(F.col("status").isin(*ACTIVE_STATUSES) & not_gone())
    delta = half_up(F.try_divide((F.col("price_month_idr") - F.col("area_median")) * 100.0, F.col("area_median")), 1)
    return rows.join(medians, "area", "left").select("id", "area", "price_month_idr", "area_median", delta.alias("delta_pct"))


def price_trend(listings: DataFrame, months: int = 6, brief: Brief = BRIEF) -> DataFrame:
    """month x bedrooms group x area, and all areas together."""
    spine = F.broadcast(month_spine(listings.sparkSession, months, brief.today))
    rows = market_base(listings, brief).select(local_month(F.col("first_seen")).alias("month"), br_group(F.col("bedrooms")).alias("br"), "area", "price_month_idr")
    rows = rows.filter("br is not null").join(spine, "month", "left_semi")
    sets = rows.groupingSets([["month", "br", "area"], ["month", "br"]], "month", "br", "area")
    return sets.agg(F.grouping("area").alias("g"), *price_box()).select("month", F.when(F.col("g") == 1, "all").otherwise(F.col("area")).alias("area"), "br", "n", "median", "p25", "p75")


def supply_flow(listings: DataFrame, weeks: int = 13, brief: Brief = BRIEF) -> DataFrame:
    """week x area (with events) and all areas: new, removed, net; weeks without events have zeros."""
    spine = F.broadcast(week_spine(listings.sparkSession, weeks, brief.today))
    base = market_base(listings, brief)
    new = base.select(iso_week(local_day(F.col("first_seen"))).alias("week"), "area", F.lit(1).alias("n"), F.lit(0).alias("r"))
    out = base.filter(~on_market()).select(iso_week(local_day(F.coalesce("removed_at", "last_seen"))).alias("week"), "area", F.lit(0).alias("n"), F.lit(1).alias("r"))
    events = new.unionByName(out).join(spine, "week", "left_semi")
    counts = events.groupingSets([["week", "area"], ["week"]], "week", "area").agg(F.grouping("area").alias("g"), F.sum("n").alias("new"), F.sum("r").alias("removed"))
    counts = counts.select("week", F.when(F.col("g") == 1, "all").otherwise(F.col("area")).alias("area"), "new", "removed")
    # areas: the brief's at most, and "all"
    areas = counts.select("area").distinct()
    every = spine.crossJoin(F.broadcast(areas))
    filled = every.join(counts, ["week", "area"], "left").fillna(0, ["new", "removed"])
    return filled.select("week", "area", "new", "removed", (F.col("new") - F.col("removed")).alias("net"))


def _days_listed() -> Column:
    return F.greatest(F.lit(0), F.floor(F.expr("timestampdiff(SECOND, first_seen, last_seen)") / 86400))


def time_on_market(listings: DataFrame, brief: Brief = BRIEF) -> DataFrame:
    """Days from first to last seen of removed rows, by area and by price band."""
    rows = market_base(listings, brief).filter(~on_market()).withColumn("days", _days_listed()).withColumn("band", price_band(F.col("price_month_idr")))
    sets = rows.groupingSets([["area"], ["band"]], "area", "band")
    return sets.agg(F.grouping("area").alias("g"), *price_box("days")).select(F.when(F.col("g") == 0, "area").otherwise("price_band").alias("kind"), F.coalesce("area", "band").alias("key"), "n", F.col("median").alias("median_days"), "p25", "p75")


def stale_share(listings: DataFrame, days: int = 30, brief: Brief = BRIEF) -> DataFrame:
    now = F.lit(f"{brief.today} 00:00:00").cast("timestamp_ntz")
    old = F.expr(f"timestampdiff(SECOND, first_seen, TIMESTAMP_NTZ'{brief.today} 00:00:00')") > days * 86400
    rows = market_base(listings, brief).filter(on_market() & (F.col("first_seen") <= now + F.expr("INTERVAL 100 YEARS")))
    out = rows.agg(F.count("*").alias("n_live"), F.count_if(old).alias("n_live_over"))
    return out.withColumn("share", half_up(F.try_divide(F.col("n_live_over"), F.col("n_live")), 3))


def price_drops(base: DataFrame, points: DataFrame, since: str) -> DataFrame:
    """Each fall between consecutive prices since a day. base: id, area; points: id, pos, day, price."""
    before = F.lag("price").over(Window.partitionBy("id").orderBy("pos"))
    falls = points.withColumn("before", before).filter((F.col("before") > 0) & (F.col("price") < F.col("before")) & (F.col("day") >= F.lit(since).cast("date")))
    pct = half_up((F.col("before") - F.col("price")) / F.col("before") * 100, 1)
    return falls.join(base.select("id", "area"), "id").select("id", "area", "before", "price", pct.alias("pct"), "day")


def per_m2(listings: DataFrame, least_m2: int = 20, brief: Brief = BRIEF) -> DataFrame:
    """Medians per square metre and per bedroom, by area, bedrooms group, both and neither."""
    rows = market_base(listings, brief).filter(F.col("build_m2") > least_m2)
    rows = rows.withColumns({"br": br_group(F.col("bedrooms")), "m2": F.col("price_month_idr") / F.col("build_m2"), "room": F.when(F.col("bedrooms") > 0, F.col("price_month_idr") / F.col("bedrooms"))})
    sets = rows.groupingSets([["area"], [], ["br", "area"], ["br"]], "area", "br")
    medians = [half_up(nearest_rank(0.5, c, "double")).alias(n) for c, n in (("m2", "median_per_build_m2"), ("room", "median_per_bedroom"))]
    out = sets.agg(F.grouping("area").alias("ga"), F.grouping("br").alias("gb"), F.count("*").alias("n"), *medians, nearest_rank(0.5, "price_month_idr").alias("median_price"))
    return out.select(F.when(F.col("ga") == 1, "all").otherwise(F.col("area")).alias("area"), F.when(F.col("gb") == 1, "all").otherwise(F.col("br")).alias("br"), "n", "median_per_build_m2", "median_per_bedroom", "median_price")


def yearly_discount(listings: DataFrame, brief: Brief = BRIEF) -> DataFrame:
    ratio = F.try_divide(F.col("price_year_idr") / 12, F.col("price_month_idr"))
    rows = market_base(listings, brief).filter(F.col("term") == "both").withColumn("ratio", ratio).filter((F.col("ratio") > 0) & (F.col("ratio") <= 5))
    sets = rows.groupingSets([["area"], []], "area")
    return sets.agg(F.grouping("area").alias("g"), F.count("*").alias("n"), half_up((1 - nearest_rank(0.5, "ratio", "double")) * 100, 1).alias("median_discount_pct")).select(F.when(F.col("g") == 1, "all").otherwise(F.col("area")).alias("area"), "n", "median_discount_pct")


def beach_premium(listings: DataFrame, brief: Brief = BRIEF) -> DataFrame:
    rows = market_base(listings, brief).select(br_group(F.col("bedrooms")).alias("br"), beach_band(F.col("beach_km")).alias("band"), "price_month_idr")
    return rows.filter("br is not null").groupBy("br", "band").agg(F.count("*").alias("n"), nearest_rank(0.5, "price_month_idr").alias("median"))


def included(inclusions: Column, key: str) -> Column:
    """True if any matching line says included, false if lines match and none does, null without a line."""
    lines = F.filter(F.map_entries(F.from_json(inclusions, "map<string,string>")), lambda e: e["key"].rlike(f"(?i){key}"))
    yes = F.exists(lines, lambda e: e["value"].rlike("(?i)included|yes") & ~e["value"].rlike(r"(?i)\bnot\b|\bno\b|excluded"))
    return F.when(F.size(lines) > 0, yes)


def inclusions_premium(listings: DataFrame, brief: Brief = BRIEF) -> DataFrame:
    rows = market_base(listings, brief).filter("inclusions is not null and inclusions <> ''")
    rows = rows.select("price_month_idr", included(F.col("inclusions"), "electric").alias("electricity"), included(F.col("inclusions"), "cleaning|housekeeping|staff").alias("staff"))
    rows = rows.unpivot(["price_month_idr"], ["electricity", "staff"], "inclusion", "has")
    return rows.groupBy("inclusion").agg(
        nearest_rank(0.5, "price_month_idr", where="has").alias("median_with"),
        nearest_rank(0.5, "price_month_idr", where="not has").alias("median_without"),
        F.count_if("has").alias("n_with"),
        F.count_if(~F.col("has")).alias("n_without"),
    )


def source_share(listings: DataFrame, brief: Brief = BRIEF) -> DataFrame:
    rows = market_base(listings, brief).groupBy("source").agg(F.count("*").alias("listings"), F.count_if(F.col("scope") == "in_filter").alias("in_filter"), F.count_if(F.col("flagged") == 1).alias("flagged"))
    totals = rows.agg(F.sum("in_filter").alias("ti"), F.sum("flagged").alias("tf"))  # one row
    out = rows.crossJoin(F.broadcast(totals))
    share = lambda a, t: half_up(F.try_divide(F.col(a), F.col(t)) * 100, 1)
    return out.select("source", "listings", "in_filter", "flagged", share("in_filter", "ti").alias("share_in_filter_pct"), share("flagged", "tf").alias("share_flagged_pct"))


def budget_edges(brief: Brief = BRIEF, step: int = 10_000_000) -> list[tuple[int, int, str]]:
    """Bands of a step from the least to the largest budget, and one band of stretch."""
    cuts = [*range(brief.budget_min, brief.budget_max, step), brief.budget_max, brief.budget_max + step]
    return [(a, b, f"{round(a / 1e6)}-{round(b / 1e6)}") for a, b in zip(cuts, cuts[1:])]


def budget_bands(listings: DataFrame, brief: Brief = BRIEF) -> DataFrame:
    edges = budget_edges(brief)
    price, band = F.col("price_month_idr"), F.lit(None).cast("string")
    for i, (low, high, name) in reversed(list(enumerate(edges))):
        inside = (price >= low) & ((price <= high) if i == len(edges) - 1 else (price < high))
        band = F.when(inside, name).otherwise(band)
    rows = market_base(listings, brief).filter(on_market() & F.col("bedrooms").between(1, 3)).withColumn("band", band).filter("band is not null")
    names = [n for _, _, n in edges]
    out = rows.groupBy("area").agg(*[F.count_if(F.col("band") == n).alias(n) for n in names], F.count("*").alias("n"))
    return out.select("area", *[F.col(f"`{n}`").alias(f"band_{n.replace('-', '_')}") for n in names], "n")


def lead_bucket(value: Column, today: str) -> Column:
    """now, within_1m, in_1_3m, later or unknown for an availability text or date."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    text = F.trim(F.regexp_replace(raw, "(?i)^from:\\s*", ""))
    ymd = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    dmy = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
    part = lambda i, n: F.lpad(F.regexp_extract(text, dmy, i), n, "0")
    iso = F.when(ymd != "", ymd).when(text.rlike(dmy), F.concat_ws("-", part(3, 4), part(2, 2), part(1, 2)))
    days = F.datediff(iso.try_cast("date"), F.lit(today).cast("date"))
    return (
        F.when(raw == "", "now")
        .when(raw.rlike("(?i)^(available|now|immediate(ly)?|ready|asap)$"), "now")
        .when(iso.isNull(), F.when(text.rlike("(?i)available|now"), "now").otherwise("unknown"))
        .when(days.isNull(), "unknown")
        .when(days <= 0, "now")
        .when(days <= 31, "within_1m")
        .when(days <= 92, "in_1_3m")
        .otherwise("later")
    )


def availability_lead(listings: DataFrame, brief: Brief = BRIEF) -> DataFrame:
    rows = market_base(listings, brief).filter(on_market()).select("area", lead_bucket(F.coalesce("available_from", "availability"), brief.today).alias("bucket"))
    sets = rows.groupingSets([["area"], []], "area")
    return sets.agg(F.grouping("area").alias("g"), *[F.count_if(F.col("bucket") == b).alias(b) for b in LEAD_BUCKETS], F.count("*").alias("n")).select(F.when(F.col("g") == 1, "all").otherwise(F.col("area")).alias("area"), *LEAD_BUCKETS, "n")


def negotiable_share(listings: DataFrame, brief: Brief = BRIEF) -> DataFrame:
    said = F.concat_ws(" ", "title", "description").rlike(r"(?i)negotiable|nego\b|bisa nego|harga nego")
    rows = market_base(listings, brief).filter(on_market()).groupBy("area").agg(F.count("*").alias("n_live"), F.count_if(said).alias("n_negotiable"))
    return rows.withColumn("share_pct", half_up(F.try_divide(F.col("n_negotiable"), F.col("n_live")) * 100, 1))


def spine_of(listings: DataFrame, column: str, values: list[str]) -> DataFrame:
    return listings.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(column))


def pipeline_counts(listings: DataFrame) -> DataFrame:
    """Rows by status in the fixed order, statuses without rows too."""
    order = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")).cast("int")
    counts = listings.groupBy("status").agg(F.count("*").alias("n"))
    return spine_of(listings, "status", STATUSES).join(F.broadcast(counts), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), order.alias("place"))


def by_source(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source").agg(
        F.count("*").alias("listings"),
        F.count_if(F.col("availability") == "gone").alias("gone"),
        F.count_if(F.col("scope") == "in_filter").alias("in_filter"),
        F.count_if(F.col("flagged") == 1).alias("flagged"),
        nearest_rank(0.5, "price_month_idr", where="availability <> 'gone'").alias("median_price"),
        F.max("last_seen").alias("last_seen"),
    )


def price_band_counts(listings: DataFrame) -> DataFrame:
    return spine_of(listings, "band", PRICE_BANDS).join(F.broadcast(listings.select(price_band(F.col("price_month_idr")).alias("band")).groupBy("band").agg(F.count("*").alias("n"))), "band", "left").fillna(0, ["n"])


