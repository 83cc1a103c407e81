"""Queries of cards, overlays and counters, and their SQL."""

from pyspark.sql import functions as F

from hearth.operators import cards as C
from hearth.plans.cases import by_cases
from hearth.plans.registry import query
from hearth.session import table
from hearth.sources.listings import WITH_LISTINGS, listings

#: Pictures of a row: one stored, one at the source, one dead.
IMAGES = "array(named_struct('src_url', concat('http://x.example/', id), 'file', CASE WHEN linenumber % 2 = 0 THEN concat(id, '.jpg') END, 'dead', linenumber = 3), named_struct('src_url', CASE WHEN quantity % 2 = 0 THEN concat('http://y.example/', id) END, 'file', CAST(NULL AS STRING), 'dead', false))"
FIRST = "CASE WHEN linenumber = 3 THEN NULL WHEN linenumber % 2 = 0 THEN '/images/' || id || '.jpg' ELSE 'http://x.example/' || id END"
SECOND = "CASE WHEN quantity % 2 = 0 THEN 'http://y.example/' || id END"
GONE = "(availability IN ('gone', 'unlisted') OR status = 'gone')"
GONE_AT = f"coalesce(removed_at, CASE WHEN {GONE} THEN last_seen END)"
GONE_REASON = "coalesce(removed_reason, CASE WHEN availability = 'unlisted' THEN 'unlisted' WHEN availability = 'gone' THEN 'delisted' WHEN status = 'gone' THEN 'taken' END)"


@query(
    f"""{WITH_LISTINGS} SELECT id, CASE WHEN linenumber = 1 THEN '/images/hero.jpg' ELSE coalesce({FIRST}, {SECOND}) END AS hero_url, CAST(({FIRST}) IS NOT NULL AS INT) + CAST(({SECOND}) IS NOT NULL AS INT) AS photo_count,
 CASE WHEN {GONE_AT} IS NOT NULL THEN greatest(0, CAST(floor(epoch_us(CASE WHEN {GONE_REASON} = 'taken' THEN {GONE_AT} ELSE last_seen END) / 86400000000 - epoch_us(first_seen) / 86400000000 + 0.5) AS BIGINT)) END AS days_live, {GONE_REASON} AS gone_reason,
 CASE WHEN supplier % 2 = 0 THEN 'tel ' || supplier END AS contact FROM L"""
)
def cards(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumns({"images": F.expr(IMAGES), "hero_file": F.when(F.col("linenumber") == 1, "hero.jpg"), "raw": F.lit("{}"), "contact": F.expr("concat('tel ', CAST(supplier AS STRING))")})
    out = C.masked(C.card_rows(C.public_rows(rows, F.array(F.lit("x")))), F.col("supplier") % 2 == 0, ["contact"])
    return out.select("id", "hero_url", "photo_count", "days_live", "gone_reason", "contact")


_SIDES = "CASE WHEN linenumber % 2 = 0 THEN price_month_idr + 1000 END AS detail_price, price_month_idr AS card_price, CASE WHEN linenumber % 3 = 0 THEN 'detail' END AS detail_title, CASE WHEN linenumber <> 3 THEN title END AS card_title, linenumber > 4 AS stale"


@query(f"{WITH_LISTINGS}, S AS (SELECT id, {_SIDES}, availability, linenumber FROM L) SELECT id, CASE WHEN stale AND card_price IS NOT NULL THEN card_price ELSE coalesce(detail_price, card_price) END AS price, coalesce(detail_title, card_title) AS title, CASE WHEN linenumber = 2 OR linenumber = 5 THEN 'gone' ELSE availability END AS availability FROM S")
def detail_overlays(spark, sf_dir):
    rows = listings(spark, sf_dir).selectExpr("id", "availability", "linenumber", *_SIDES.split(", "))
    out = C.overlaid(rows, ["price", "title"], stale=F.col("stale"), facts=("price",))
    return out.select("id", "price", "title", C.detail_availability(F.col("linenumber") == 2, F.col("availability"), F.col("linenumber") == 5).alias("availability"))


by_cases("value_wordings", {"pct": "double"}, [(-3.1, "under"), (-3.0, "par"), (0.0, "par"), (3.0, "par"), (3.5, "over"), (None, None)], ["wording"], lambda r: {"id": F.col("id"), "wording": C.value_wording(F.col("pct"))})
by_cases("matches", {"verdicts": "array<string>"}, [(["yes", "yes"], True), (["yes", "no"], False), (["yes", "maybe", "yes"], True), ([""], False)], ["match"], lambda r: {"id": F.col("id"), "match": C.is_match(F.col("verdicts"))})
by_cases(
    "stale_pages", {"at": "string", "cached": "boolean"},
    [("2025-10-15 00:00:00", True, True), ("2025-10-15 00:00:01", True, False), (None, True, True), (None, False, False), ("2025-01-01 00:00:00", False, False)], ["stale"],
    lambda r: {"id": F.col("id"), "stale": C.served_stale(F.array(F.struct("cached", F.col("at").cast("timestamp").alias("at"))), F.lit("2025-10-15 12:00:00").cast("timestamp"))},
)


@query(f"{WITH_LISTINGS} SELECT id, concat_ws('; ', CASE WHEN bedrooms > 3 THEN 'fails rooms' END, CASE WHEN beach_km IS NULL THEN 'unknown beach' END, CASE WHEN stored_fit < 65 THEN 'score ' || stored_fit || ' below 65' END, CASE WHEN price_month_idr > 80000000 THEN 'over budget' END) AS notes FROM L")
def near_miss_notes(spark, sf_dir):
    name = lambda cond, n: F.array_compact(F.array(F.when(cond, n)))
    notes = C.near_misses(name(F.col("bedrooms") > 3, "rooms"), name(F.col("beach_km").isNull(), "beach"), F.col("stored_fit"), 65, F.col("price_month_idr") > 80_000_000)
    return listings(spark, sf_dir).select("id", F.array_join(notes, "; ").alias("notes"))


@query("SELECT event_id AS run_id, CAST(event_id % 3 AS BIGINT) AS listed, CASE WHEN event_id % 5 <> 0 THEN 'e' || (event_id % 7) END AS error, CASE WHEN event_id % 5 = 0 THEN 3005 END AS error_size, CAST(event_id % 600 AS BIGINT) AS seconds FROM events")
def parsed_runs(spark, sf_dir):
    text = {
        "sources": "'[\"a\",\"b\"]'",
        "counts": "concat('{\"listed\":', CAST(event_id % 3 AS STRING), '}')",
        "errors": "CASE WHEN event_id % 5 = 0 THEN concat('[\"', repeat('x', 3001), '\"]') ELSE concat('[\"e', CAST(event_id % 7 AS STRING), '\"]') END",
    }
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), *[F.expr(x).alias(n) for n, x in text.items()], F.col("ts").alias("started_at"), F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, event_id % 600)").alias("finished_at"))
    out = C.run_rows(rows)
    return out.select("run_id", F.col("counts")["listed"].alias("listed"), F.get("errors", F.lit(0)).alias("error"), "error_size", "seconds")


@query("SELECT o_orderkey AS id, c_name AS by_name FROM orders LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey")
def rows_with_names(spark, sf_dir):
    people = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return C.with_names(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("by")), people).select(F.col("o_orderkey").alias("id"), "by_name")


@query("SELECT item, string_agg(voter || '=' || verdict, ' ' ORDER BY voter, verdict) AS verdicts FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS item, user_id AS voter, event_type AS verdict FROM events WHERE user_id % 2 = 0) GROUP BY item")
def verdict_lists(spark, sf_dir):
    votes = table(spark, sf_dir, "events").select((F.get_json_object("props", "$.k").cast("long") % 20).alias("item"), F.col("user_id").alias("voter"), F.col("event_type").alias("verdict"))
    out = C.verdict_lists(votes, votes.select("voter").filter("voter % 2 = 0").distinct())
    return out.select("item", F.array_join(F.transform("verdicts", lambda v: F.concat_ws("=", v["voter"].cast("string"), v["verdict"])), " ").alias("verdicts"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def language_tally(spark, sf_dir):
    return C.tally(table(spark, sf_dir, "documents"), "lang")


@query(f"{WITH_LISTINGS}, V AS (SELECT *, availability NOT IN ('gone', 'unlisted') AS live FROM L) SELECT count(*) AS n, count(*) FILTER (WHERE live) AS live, count(*) FILTER (WHERE live AND scope = 'in_filter') AS in_filter, count(*) FILTER (WHERE live AND flagged = 1) AS flagged, count(*) FILTER (WHERE live AND status = 'new') AS \"new\", count(*) FILTER (WHERE NOT live) AS gone FROM V")
def scope_counters(spark, sf_dir):
    return C.scope_counts(listings(spark, sf_dir))


@query(f"{WITH_LISTINGS} SELECT area, CAST(floor(median(price_month_idr) + 0.5) AS BIGINT) AS median FROM L GROUP BY area")
def conventional_medians(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("area").agg(C.conventional_median("price_month_idr").alias("median"))


@query(f"{WITH_LISTINGS} SELECT count(*) FILTER (WHERE status = 'new' AND linenumber > 2) AS sort, count(*) FILTER (WHERE status = 'shortlist') AS contact, count(*) FILTER (WHERE status IN ('contacted', 'viewing_booked')) AS view, count(*) FILTER (WHERE status = 'viewed' AND (linenumber = 1 OR quantity % 2 = 0)) AS rate FROM L")
def flow_stage_counts(spark, sf_dir):
    stages = C.flow_stages(F.when(F.col("quantity") % 2 == 1, "done"), F.when(F.col("linenumber") <= 2, "yes"), F.when(F.col("linenumber") == 1, 0).otherwise(2))
    return listings(spark, sf_dir).agg(*[F.count_if(c).alias(n) for n, c in stages.items()])


@query("SELECT json_extract_string(props, '$.k') AS k, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1")
def imports_by_key(spark, sf_dir):
    key = F.get_json_object("props", "$.k").alias("k")
    return table(spark, sf_dir, "events").groupBy(key).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query(f"{WITH_LISTINGS}, S AS (SELECT 'source' AS section, source AS key FROM L UNION ALL SELECT 'area', area FROM L UNION ALL SELECT 'scope', scope FROM L UNION ALL SELECT 'flagged', area FROM L WHERE flagged = 1 UNION ALL SELECT 'far', area FROM L WHERE beach_km > 4) SELECT section, key, count(*) AS n FROM S GROUP BY 1, 2")
def report_sections(spark, sf_dir):
    return C.report_sections(listings(spark, sf_dir))


@query(f"{WITH_LISTINGS} SELECT style AS slug, area, count(*) AS n FROM L GROUP BY 1, 2")
def dry_report(spark, sf_dir):
    return C.dry_report(listings(spark, sf_dir).withColumnRenamed("style", "slug"))


@query(f"{WITH_LISTINGS} SELECT DISTINCT part AS part FROM L WHERE availability NOT IN ('gone', 'unlisted')")
def tracked_parts(spark, sf_dir):
    return C.tracked(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")), listings(spark, sf_dir), "part")


@query(f"{WITH_LISTINGS} SELECT m.merged_into AS a, m.id AS b, k.title AS title_a, m.title AS title_b, m.price_month_idr AS price_b FROM L m JOIN L k ON k.id = m.merged_into")
def duplicate_cards(spark, sf_dir):
    rows = listings(spark, sf_dir)
    pairs = rows.filter("merged_into is not null").select(F.col("merged_into").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    return C.duplicate_cards(pairs, rows).select("a", "b", F.col("card_a.title").alias("title_a"), F.col("card_b.title").alias("title_b"), F.col("card_b.price").alias("price_b"))


@query("SELECT s_suppkey AS source, count(l_partkey) FILTER (WHERE l_quantity > 45) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey % 4 <> 1 GROUP BY s_suppkey")
def sources_with_stats(spark, sf_dir):
    stats = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").alias("n"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") % 4 == 1).alias("archived"))
    return C.sources_with_stats(sources, stats).select("source", "n")
