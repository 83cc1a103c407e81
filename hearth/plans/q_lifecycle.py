"""Queries of the life of stored rows, and their SQL."""

from pyspark.sql import functions as F

from hearth.functions.rent import rent
from hearth.operators import lifecycle as Y
from hearth.plans.registry import query
from hearth.session import table
from hearth.sources.listings import WITH_LISTINGS, WITH_POINTS, listings, price_points

NOW = "2001-08-01"


@query(f"{WITH_LISTINGS} SELECT id, CASE WHEN linenumber = 2 THEN 'gone' ELSE availability END AS availability, CASE WHEN linenumber = 2 THEN TIMESTAMP '{NOW}' ELSE removed_at END AS removed_at, CASE WHEN linenumber = 2 THEN 'archived' ELSE removed_reason END AS removed_reason, CASE WHEN linenumber = 2 THEN 0 ELSE flagged END AS flagged, last_seen FROM L")
def rows_marked_gone(spark, sf_dir):
    rows = listings(spark, sf_dir)
    gone = rows.filter("linenumber = 2").select("id", F.lit("archived").alias("reason"))
    return Y.mark_gone(rows, gone, NOW).select("id", "availability", "removed_at", "removed_reason", "flagged", "last_seen")


_NEXT = "CASE WHEN linenumber % 3 = 0 THEN 'gone' WHEN linenumber % 3 = 1 THEN 'new' END"
_REASON = "CASE WHEN linenumber = 4 THEN 'taken' ELSE removed_reason END"


@query(f"{WITH_LISTINGS}, T AS (SELECT id, status, {_NEXT} AS next_status, removed_at, {_REASON} AS r FROM L) SELECT id, coalesce(next_status, status) AS status, CASE WHEN next_status = 'gone' AND removed_at IS NULL THEN TIMESTAMP '{NOW}' WHEN next_status <> 'gone' AND status = 'gone' AND r = 'taken' THEN NULL ELSE removed_at END AS removed_at, CASE WHEN next_status = 'gone' AND removed_at IS NULL THEN 'taken' WHEN next_status <> 'gone' AND status = 'gone' AND r = 'taken' THEN NULL ELSE r END AS removed_reason FROM T")
def person_removals(spark, sf_dir):
    rows = listings(spark, sf_dir).select("id", "status", F.expr(_NEXT).alias("next_status"), "removed_at", F.expr(_REASON).alias("removed_reason"))
    return Y.person_removal(rows, NOW).select("id", "status", "removed_at", "removed_reason")


_PAGE = "CASE linenumber % 4 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS http, linenumber % 4 > 1 AS parsed, linenumber % 4 = 3 AND quantity % 2 = 0 AS gone, CASE WHEN quantity % 3 = 0 THEN 12000000 ELSE price_month_idr END AS price"


@query(f"{WITH_LISTINGS}, R AS (SELECT id, price_month_idr AS stored, {_PAGE} FROM L WHERE (status IN ('shortlist', 'contacted', 'viewing_booked', 'viewed', 'offer') OR flagged = 1) AND availability <> 'gone'), O AS (SELECT *, CASE WHEN parsed AND gone THEN 'archived' WHEN NOT parsed AND http IN (404, 410) THEN 'delisted' WHEN NOT parsed THEN 'error' WHEN price IS NOT NULL AND price IS DISTINCT FROM stored THEN 'price' ELSE 'same' END AS outcome FROM R) SELECT id, outcome, CASE WHEN outcome = 'price' THEN price ELSE stored END AS price FROM O")
def rechecked(spark, sf_dir):
    rows = listings(spark, sf_dir).filter(Y.recheck_due())
    pages = listings(spark, sf_dir).selectExpr("id", *(f"{x}" for x in ["CASE linenumber % 4 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS http", "linenumber % 4 > 1 AS parsed", "linenumber % 4 = 3 AND quantity % 2 = 0 AS gone", "CASE WHEN quantity % 3 = 0 THEN 12000000L ELSE price_month_idr END AS price"]))
    return Y.recheck(rows, pages)


_VOTES = "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, user_id % 5 AS voter, CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'maybe' END AS verdict, ts AS told, event_id AS seq FROM events"


@query(f"WITH V AS ({_VOTES}), N AS (SELECT item, voter, arg_max(verdict, (told, seq)) AS verdict FROM V GROUP BY item, voter), S AS (SELECT item, count(*) FILTER (WHERE verdict = 'yes') AS yes FROM N GROUP BY item), E AS (SELECT item, bool_or(verdict = 'yes') AS ever FROM V GROUP BY item), R AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'shortlist' ELSE 'viewed' END AS status FROM customer) SELECT id, CASE WHEN status = 'new' AND yes > 0 THEN 'shortlist' WHEN status = 'shortlist' AND ever AND yes = 0 THEN 'new' ELSE status END AS status FROM R LEFT JOIN S ON S.item = id LEFT JOIN E ON E.item = id")
def shortlists(spark, sf_dir):
    votes = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("item"), (F.col("user_id") % 5).alias("voter"), F.expr("CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'maybe' END").alias("verdict"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CASE c_custkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'shortlist' ELSE 'viewed' END AS status")
    return Y.shortlisted(rows, votes).select("id", "status")


@query("WITH V AS (SELECT user_id AS team, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id, event_type AS status, ts, event_id FROM events) SELECT team, id, arg_max(status, (ts, event_id)) AS status FROM V GROUP BY team, id")
def team_states(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("team"), F.get_json_object("props", "$.k").cast("long").alias("id"), F.col("event_type").alias("status"), "ts", "event_id")
    return Y.latest_of(rows, ["team", "id"], "ts", "event_id").select("team", "id", "status")


@query("SELECT DISTINCT whatsapp, name FROM (SELECT 'wa' || (o_custkey % 40) AS whatsapp, min('n' || o_orderkey) AS name FROM orders GROUP BY 1) WHERE whatsapp NOT IN (SELECT 'wa' || c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def contacts_found(spark, sf_dir):
    found = table(spark, sf_dir, "orders").selectExpr("concat('wa', CAST(o_custkey % 40 AS STRING)) AS whatsapp", "concat('n', CAST(o_orderkey AS STRING)) AS name")
    known = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").selectExpr("concat('wa', CAST(c_custkey AS STRING)) AS whatsapp")
    return Y.new_contacts(known, found)


@query("SELECT DISTINCT o_orderkey % 100 AS id, 'wa' || (o_custkey % 40) AS whatsapp FROM orders WHERE NOT (o_orderkey % 100 < 10 AND o_custkey % 40 < 20)")
def contact_links_found(spark, sf_dir):
    found = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 100 AS id", "o_custkey % 40 AS k", "concat('wa', CAST(o_custkey % 40 AS STRING)) AS whatsapp")
    return Y.contact_links(found.filter("id < 10 and k < 20").select("id", "whatsapp").distinct(), found)


@query(f"{WITH_LISTINGS} SELECT id, array_to_string(list_concat(CASE WHEN linenumber % 2 = 0 THEN ['old'] ELSE [] END, CASE WHEN quantity % 2 = 0 THEN ['busy', 'noise'] ELSE [] END), ',') AS flags, coalesce(CASE WHEN linenumber = 3 THEN 'x' END, merged_into) AS marker FROM L")
def flags_added(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumns({"red_flags": F.when(F.col("linenumber") % 2 == 0, F.array(F.lit("old"))), "mark": Y.merge_marker(F.when(F.col("linenumber") == 3, "x"), F.col("merged_into"))})
    flags = rows.filter("quantity % 2 = 0").select("id", F.explode(F.array(F.lit("noise"), F.lit("busy"))).alias("flag"))
    return Y.add_flags(rows, flags).select("id", F.array_join("red_flags", ",").alias("flags"), F.col("mark").alias("marker"))


@query(f"{WITH_LISTINGS}{WITH_POINTS} SELECT id, CAST(pos AS INT) AS pos, price FROM (SELECT *, lag(price) OVER (PARTITION BY id ORDER BY pos) AS before FROM H WHERE price < 90000000) WHERE before IS NULL OR before <> price")
def repriced_points(spark, sf_dir):
    return Y.repriced(price_points(listings(spark, sf_dir)).select("id", "pos", "price"), F.col("price") < 90_000_000)


@query("SELECT count(*) AS n, max(event_id) AS cursor FROM events WHERE event_id > 500")
def after_cursor(spark, sf_dir):
    rows, cursor = Y.after_cursor(table(spark, sf_dir, "events"), "event_id", 500)
    return rows.agg(F.count("*").alias("n"), cursor.alias("cursor"))


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def unprocessed_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id")
    return Y.unprocessed(rows, rows.filter("event_id % 3 = 0"), "event_id")


@query("SELECT s_suppkey AS source FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey = 4")
def enabled_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("source"))
    return Y.enabled_sources(rows, rows.filter("CAST(source AS INT) % 4 = 0"), ["4"]).select(F.col("source").cast("int").alias("source"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'stored' ELSE n_name END AS label, row_number() OVER (ORDER BY n_nationkey % 2, n_nationkey) AS place FROM nation")
def source_registry(spark, sf_dir):
    from pyspark.sql import Window

    nation = table(spark, sf_dir, "nation")
    stored = nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.lit("stored").alias("label"), F.col("n_nationkey").alias("place"))
    out = Y.source_registry(stored, nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("place")))
    return out.select("id", "label", F.row_number().over(Window.orderBy("place")).cast("long").alias("place"))  # a registry: a few rows


@query("SELECT 'g' || c_custkey AS \"group\", CASE WHEN c_custkey BETWEEN 1 AND 25 THEN 'src' || (c_custkey - 1) ELSE 'fb-g' || c_custkey END AS source FROM customer")
def group_sources(spark, sf_dir):
    sources = table(spark, sf_dir, "nation").selectExpr("concat('src', CAST(n_nationkey AS STRING)) AS id", "concat('http://f.example/groups/g', CAST(n_nationkey + 1 AS STRING), '/') AS url")
    return Y.source_of_group(table(spark, sf_dir, "customer").selectExpr("concat('g', CAST(c_custkey AS STRING)) AS group"), sources)


@query("SELECT o_custkey AS ref, min(o_orderkey) FILTER (WHERE o_totalprice > 50000) AS first FROM orders GROUP BY o_custkey HAVING first IS NOT NULL")
def sweep_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ref"), "o_orderkey", "o_totalprice")
    return Y.first_rows(rows, "ref", "o_orderkey", F.col("o_totalprice") <= 50_000).select("ref", F.col("o_orderkey").alias("first"))


_TEXT = "concat('Rent: IDR ', CAST(CAST(o_totalprice AS BIGINT) * 1000 AS STRING), ' per month')"


@query("""WITH B AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 30000000 END AS stated, CASE WHEN CAST(trunc(o_totalprice) AS BIGINT) * 1000 BETWEEN 2000000 AND 500000000 THEN CAST(trunc(o_totalprice) AS BIGINT) * 1000 END AS said, CASE WHEN o_orderkey % 3 = 0 THEN 'ubud' ELSE 'other' END AS area, o_custkey % 7 AS bedrooms FROM orders)
 SELECT id, coalesce(stated, said) AS price_month_idr, area, CASE WHEN stated IS NULL AND said IS NULL THEN 'no price' WHEN bedrooms NOT BETWEEN 1 AND 4 THEN 'bedrooms' END AS skipped FROM B""")
def structured_rows(spark, sf_dir):
    batch = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 2 = 0 THEN 30000000L END AS price_month_idr", "CAST(NULL AS BIGINT) AS price_year_idr", "CASE o_orderkey % 3 WHEN 0 THEN 'ubud' WHEN 1 THEN 'x' END AS area", "o_custkey % 7 AS bedrooms", f"{_TEXT} AS text")
    return Y.listing_rows(batch, ["ubud"], rent(F.col("text"))).select("id", "price_month_idr", "area", "skipped")


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN TIMESTAMP '2001-01-01' ELSE TIMESTAMP '2001-02-01' END AS posted_at, least(8, event_id % 12) AS n_images FROM events")
def harvested_posts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("posted_at"), F.lit("2001-02-01").cast("timestamp_ntz").alias("exported_at"), F.expr("transform(slice(sequence(1, 12), 1, CAST(event_id % 12 AS INT)), x -> CAST(x AS STRING))").alias("images"))
    out = Y.harvest_posts(rows, F.when(F.col("id") % 3 == 1, F.lit("2001-01-01").cast("timestamp_ntz")))
    return out.select("id", "posted_at", F.size("images").cast("long").alias("n_images"))


#: A fold over a user's rows: bytes and rows of the open batch; it begins anew where the next row doesn't fit.
@query("""WITH RECURSIVE S AS (SELECT user_id, event_id, length(props) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 F AS (SELECT user_id, event_id, n, size AS bytes, 1 AS rows, 0 AS batch FROM S WHERE n = 1 UNION ALL
  SELECT S.user_id, S.event_id, S.n, CASE WHEN F.bytes + S.size > 60 OR F.rows = 7 THEN S.size ELSE F.bytes + S.size END, CASE WHEN F.bytes + S.size > 60 OR F.rows = 7 THEN 1 ELSE F.rows + 1 END, CASE WHEN F.bytes + S.size > 60 OR F.rows = 7 THEN F.batch + 1 ELSE F.batch END
  FROM F JOIN S ON S.user_id = F.user_id AND S.n = F.n + 1)
 SELECT user_id, event_id, CAST(batch AS BIGINT) AS batch FROM F""")
def import_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.length("props").alias("size"))
    return Y.batches(rows, "user_id", "event_id", "size", 60, 7).select("user_id", "event_id", "batch")


_PICTURES = "array(named_struct('file', CASE WHEN linenumber % 2 = 0 THEN 'f' END, 'hash', CASE WHEN linenumber % 4 = 0 THEN 'h' END, 'dead', linenumber = 3), named_struct('file', CAST(NULL AS STRING), 'hash', CAST(NULL AS STRING), 'dead', false))"


@query(f"{WITH_LISTINGS}, P AS (SELECT id, CASE WHEN availability = 'gone' THEN 0 ELSE CAST(linenumber % 2 = 1 AND linenumber <> 3 AS INT) + 1 END AS downloads, CAST(linenumber % 4 = 2 AS INT) AS hashes FROM L) SELECT * FROM P WHERE downloads > 0 OR hashes > 0")
def picture_work(spark, sf_dir):
    return Y.picture_work(listings(spark, sf_dir).select("id", "availability", F.expr(_PICTURES).alias("images")))


@query(f"{WITH_LISTINGS}, A AS (SELECT id, CASE WHEN linenumber % 3 > 0 THEN 'a' || part % 50 END AS address, CASE WHEN linenumber > 1 THEN lat END AS lat, CASE WHEN linenumber = 2 THEN 'centroid' WHEN linenumber > 2 THEN 'listing_map' END AS pin_source, part % 50 AS k FROM L), D AS (SELECT *, address IS NOT NULL AND (lat IS NULL OR coalesce(pin_source = 'centroid', FALSE)) AS due FROM A) SELECT id, due, CASE WHEN due AND k < 25 THEN -8.0 - k ELSE lat END AS lat, CASE WHEN due AND k < 25 THEN 'geocode' ELSE pin_source END AS pin_source FROM D")
def geocoded_pins(spark, sf_dir):
    rows = listings(spark, sf_dir).selectExpr("id", "CASE WHEN linenumber % 3 > 0 THEN concat('a', CAST(part % 50 AS STRING)) END AS address", "CASE WHEN linenumber > 1 THEN lat END AS lat", "lng", "CASE WHEN linenumber = 2 THEN 'centroid' WHEN linenumber > 2 THEN 'listing_map' END AS pin_source", "CAST(NULL AS DOUBLE) AS beach_km", "CAST(NULL AS STRING) AS beach_source")
    found = spark.range(25).selectExpr("concat('a', CAST(id AS STRING)) AS address", "CAST(-8.0 - id AS DOUBLE) AS g_lat", "CAST(115 AS DOUBLE) AS g_lng")
    due = Y.geocode_work(rows).select("id", F.lit(True).alias("due"))
    return Y.geocoded(rows, found).join(due, "id", "left").select("id", F.coalesce("due", F.lit(False)).alias("due"), F.col("lat").cast("double").alias("lat"), "pin_source")
