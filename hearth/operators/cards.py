"""Rows as people see them: pictures, removal, cards, masks, overlays of details over cards, notes on why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions.semantics import half_up
from hearth.operators.joins import anchor_distances
from hearth.operators.search import removed_at, removed_reason, value_fields

# The folder of stored pictures, wordings, and after how many hours a page is stale.
FOLDER, PAR, STALE_HOURS, LONG_ERRORS = "/images/", 3, 12, 2000
WORDINGS = ["under", "over", "par"]


def picture_urls(images: Column) -> Column:
    """Addresses of array<struct<src_url, file, dead>>: the stored file before the source's; dead pictures are left out."""
    alive = F.filter(images, lambda i: i.isNotNull() & ~F.coalesce(i["dead"], F.lit(False)))
    return F.array_compact(F.transform(alive, lambda i: F.coalesce(F.concat(F.lit(FOLDER), F.nullif(i["file"], F.lit(""))), F.nullif(i["src_url"], F.lit("")))))


def hero_url(hero_file: Column, images: Column) -> Column:
    """The chosen picture, else the first that can be shown."""
    return F.coalesce(F.concat(F.lit(FOLDER), F.nullif(hero_file, F.lit(""))), F.get(picture_urls(images), F.lit(0)))


def days_live() -> Column:
    """Days from the first to the last sighting of a removed row (to the tap, where a person took it away), rounded."""
    end = F.when(removed_reason() == "taken", removed_at()).otherwise(F.col("last_seen"))
    days = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 86_400_000_000
    return F.when(removed_at().isNotNull(), F.greatest(F.lit(0), half_up(days)).cast("long"))


def public_rows(rows: DataFrame, reasons: Column) -> DataFrame:
    """Rows without the raw payload, with hero, reasons, removal and days live."""
    extra = {"hero_url": hero_url(F.col("hero_file"), F.col("images")), "reasons": reasons, "days_live": days_live(), "gone_at": removed_at(), "gone_reason": removed_reason()}
    return rows.withColumns(extra).drop("raw")


def card_rows(public: DataFrame) -> DataFrame:
    """Without pictures and description, with the number of pictures."""
    return public.withColumn("photo_count", F.size(picture_urls(F.col("images")))).drop("images", "description")


def masked(rows: DataFrame, owner: Column, names: list[str]) -> DataFrame:
    """Columns that only an owner sees are null for others."""
    return rows.withColumns({n: F.when(owner, F.col(n)) for n in names})


def overlaid(rows: DataFrame, names: list[str], over: str = "detail_", under: str = "card_", stale: Column | None = None, facts: tuple[str, ...] = ()) -> DataFrame:
    """Values of the detail over those of the card; a stale detail loses to the card's own facts; null never wins."""
    old = F.lit(False) if stale is None else F.coalesce(stale, F.lit(False))
    pick = lambda n: F.when(old & F.col(f"{under}{n}").isNotNull(), F.col(f"{under}{n}")).otherwise(F.coalesce(f"{over}{n}", f"{under}{n}")) if n in facts else F.coalesce(f"{over}{n}", f"{under}{n}")
    return rows.withColumns({n: pick(n) for n in names}).drop(*[f"{p}{n}" for p in (over, under) for n in names])


def detail_availability(gone: Column, own: Column, card_gone: Column | None = None) -> Column:
    """What the detail says of being gone; the card's own word for it stays, where it is given."""
    said = F.coalesce(gone, F.lit(False)) | (F.coalesce(card_gone, F.lit(False)) if card_gone is not None else F.lit(False))
    return F.when(said, "gone").otherwise(own)


def served_stale(pages: Column, now: Column) -> Column:
    """Whether one of array<struct<cached, at>> is a copy of unknown age, or of twelve hours or more."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    old = lambda p: p["cached"] & F.coalesce(micros(now) - micros(p["at"]) >= STALE_HOURS * 3_600_000_000, F.lit(True))
    return F.coalesce(F.exists(pages, old), F.lit(False))


def value_wording(pct: Column) -> Column:
    """under, over or par against the area, with a band of 3 % around it."""
    return F.when(pct.isNull(), F.lit(None)).when(pct < -PAR, WORDINGS[0]).when(pct > PAR, WORDINGS[1]).otherwise(WORDINGS[2])


def is_match(verdicts: Column) -> Column:
    """Two or more said yes."""
    return F.coalesce(F.size(F.filter(verdicts, lambda v: v == "yes")) >= 2, F.lit(False))


def near_misses(failed: Column, unknown: Column, score: Column, threshold: int, over_budget: Column) -> Column:
    """Why a row isn't flagged, in words: failed filters, unknown facts, the score, the budget."""
    return F.array_compact(
        F.array(
            F.when(F.size(failed) > 0, F.concat(F.lit("fails "), F.array_join(failed, ", "))),
            F.when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.array_join(unknown, ", "))),
            F.when(score < threshold, F.concat(F.lit("score "), score.cast("string"), F.lit(f" below {threshold}"))),
            F.when(over_budget, F.lit("over budget")),
        )
    )


def run_rows(runs: DataFrame) -> DataFrame:
    """Runs with their JSON parsed: sources as a list, counts as a map; very long error texts as their size; seconds taken."""
    long = F.length("errors") > LONG_ERRORS
    return runs.select(
        "run_id",
        F.from_json("sources", "array<string>").alias("sources"),
        F.from_json("counts", "map<string,bigint>").alias("counts"),
        F.when(long, F.lit(None)).otherwise(F.from_json("errors", "array<string>")).alias("errors"),
        F.when(long, F.length("errors")).alias("error_size"),
        (F.unix_seconds(F.col("finished_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))).alias("seconds"),
    )


def with_names(rows: DataFrame, people: DataFrame, by: str = "by") -> DataFrame:
    """Adds the name of the person who wrote a row. people (id, name)."""
    return rows.join(people.select(F.col("id").alias(by), F.col("name").alias("by_name")), by, "left")


def verdict_lists(verdicts: DataFrame, team: DataFrame) -> DataFrame:
    """item, verdicts: what each team mate said of an item, by person. team (voter)."""
    return verdicts.join(team, "voter", "left_semi").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("voter", "verdict"))).alias("verdicts"))


def tally(rows: DataFrame, key: str) -> DataFrame:
    """Counts of a key, the largest first, then by key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def scope_counts(rows: DataFrame) -> DataFrame:
    """One row of counters: all, live, in filter, flagged, new, gone."""
    live = ~F.coalesce(F.col("availability").isin("gone", "unlisted"), F.lit(False))
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(live).alias("live"),
        F.count_if(live & (F.col("scope") == "in_filter")).alias("in_filter"),
        F.count_if(live & (F.col("flagged") == 1)).alias("flagged"),
        F.count_if(live & (F.col("status") == "new")).alias("new"),
        F.count_if(~live).alias("gone"),
    )


def conventional_median(column: str) -> Column:
    """The middle value, or the mean of the two middle ones, rounded."""
    return half_up(F.median(column)).cast("long")


def flow_stages(assessed: Column, mine: Column, ratings: Column) -> dict[str, Column]:
    """The stages of work on a row: sort, contact, view and rate."""
    status = F.col("status")
    return {
        "sort": (status == "new") & mine.isNull(),
        "contact": status == "shortlist",
        "view": status.isin("contacted", "viewing_booked"),
        "rate": (status == "viewed") & ((ratings == 0) | (F.coalesce(assessed, F.lit("not_yet")) != "done")),
    }


def report_sections(rows: DataFrame, far_km: float = 4) -> DataFrame:
    """section, key, n: what a run's report tells: rows by source, area and scope, flagged ones, and those far from a beach."""
    far = F.coalesce(F.col("beach_km") > far_km, F.lit(False))
    keys = [("source", F.col("source")), ("area", F.col("area")), ("scope", F.col("scope")), ("flagged", F.when(F.col("flagged") == 1, F.col("area"))), ("far", F.when(far, F.col("area")))]
    each = F.array(*[F.struct(F.lit(name).alias("section"), key.alias("key")) for name, key in keys])
    return rows.select(F.explode(each).alias("s")).filter("s.key is not null").groupBy("s.section", "s.key").agg(F.count("*").alias("n"))


def dry_report(rows: DataFrame) -> DataFrame:
    """slug, area, n of a run that writes nothing."""
    return rows.groupBy("slug", "area").agg(F.count("*").alias("n"))


def tracked(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The wanted keys that a live row has."""
    return wanted.join(rows.filter(~F.coalesce(F.col("availability").isin("gone", "unlisted"), F.lit(False))), key, "left_semi")


def duplicate_cards(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b, score and a short card of each side: title, area, price, source."""
    side = lambda s: rows.select(F.col("id").alias(s), F.struct("title", "area", F.col("price_month_idr").alias("price"), "source").alias(f"card_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "score", "card_a", "card_b")


def sources_with_stats(sources: DataFrame, stats: DataFrame) -> DataFrame:
    """Sources that aren't archived, with their counts (zero without any)."""
    names = [c for c in stats.columns if c != "source"]
    return sources.filter("not archived").join(stats, "source", "left").fillna(0, names)


def with_shared(rows: DataFrame, market: DataFrame, verdicts: DataFrame, team: DataFrame, people: DataFrame, anchors: list[tuple[str, float, float]]) -> DataFrame:
    """Rows of a page with what the people of a team see on them: their verdicts, who set the status, value, anchors.

    market: all rows, whose medians the value is held against. verdicts: item, voter, verdict; people: id, name.
    """
    voted = verdict_lists(verdicts.join(rows.select(F.col("id").alias("item")), "item", "left_semi"), team).withColumnRenamed("item", "id")
    out = rows.join(voted, "id", "left").join(value_fields(market), "id", "left")
    out = out.join(people.select(F.col("id").alias("status_by"), F.col("name").alias("status_by_name")), "status_by", "left")
    none = F.array().cast(voted.schema["verdicts"].dataType)
    return anchor_distances(out.withColumn("verdicts", F.coalesce("verdicts", none)), anchors)
