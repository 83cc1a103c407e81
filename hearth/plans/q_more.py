"""Queries of the rule joins and of the collecting run's decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.functions import facts as T
from hearth.operators import harvest as V
from hearth.operators import joins as J
from hearth.plans.registry import query
from hearth.session import table
from hearth.sources import images as I
from hearth.sources.listings import WITH_LISTINGS, listings

# A few places of the configuration.
PLACES = [("north", -8.25, 115.1), ("middle", -8.6, 115.4), ("south", -9.0, 115.7)]
_KM = "12742 * asin(sqrt(pow(sin(radians(({1} - {0}) / 2)), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians(({3} - {2}) / 2)), 2)))"
_DISTANCES = [(n, _KM.format("lat", a, "lng", b)) for n, a, b in PLACES]


@query(
    f"""{WITH_LISTINGS}, D AS (SELECT id, least({", ".join(f"CASE WHEN {d} <= 40 THEN {d} END" for _, d in _DISTANCES)}) AS km, {", ".join(f"{d} AS {n}" for n, d in _DISTANCES)} FROM L)
  SELECT id, CASE {" ".join(f"WHEN km = {n} THEN '{n}'" for n, _, _ in PLACES)} END AS place, round(km, 3) AS km FROM D"""
)
def nearest_place(spark, sf_dir):
    return J.places_near(listings(spark, sf_dir).select("id", "lat", "lng"), PLACES, 40).select("id", "place", F.round("place_km", 3).alias("km"))


@query(f"{WITH_LISTINGS} SELECT id, {', '.join(f'round({d}, 2) AS {n}' for n, d in _DISTANCES)} FROM L WHERE scope = 'in_filter'")
def anchor_distances(spark, sf_dir):
    rows = J.anchor_distances(listings(spark, sf_dir).filter("scope = 'in_filter'"), PLACES)
    return rows.select("id", *[F.col("anchors")[i]["km"].alias(n) for i, (n, _, _) in enumerate(PLACES)])


@query("SELECT a, b FROM (SELECT o_custkey AS a, o_orderkey AS b FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM (SELECT l_orderkey AS x, l_suppkey AS y FROM lineitem) d WHERE least(a, b) = least(x, y) AND greatest(a, b) = greatest(x, y))")
def pairs_not_dismissed(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    return J.not_dismissed(pairs, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b")))


@query(
    """WITH K AS (SELECT s_suppkey AS id, CAST(s_suppkey % 40 AS VARCHAR) AS k FROM supplier), N AS (SELECT k, count(*) AS n, min(id) AS f FROM K GROUP BY k)
  SELECT '000' || lpad(k, 4, '0') AS key, id, f AS first, n AS rows FROM K JOIN N USING (k) WHERE n > 1"""
)
def shared_contacts(spark, sf_dir):
    phone = F.concat(F.lit("+62 812-000"), F.lpad((F.col("s_suppkey") % 40).cast("string"), 4, "0"))
    out = J.shared_contacts(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), T.phone_key(phone).alias("phone_key")))
    return out.select(F.right("phone_key", F.lit(7)).alias("key"), "id", "first", "rows")


@query("WITH K AS (SELECT s_suppkey AS id, s_suppkey % 40 AS k, s_suppkey % 7 AS j FROM supplier) SELECT x.id AS a, y.id AS b FROM K x JOIN K y ON y.id = x.id + 40 OR y.id = x.id + 35 OR y.id = x.id + 1 WHERE x.k = y.k OR x.j = y.j")
def pairs_sharing_contact(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    keys = rows.select("id", F.explode(F.array(F.concat(F.lit("k"), F.col("id") % 40), F.concat(F.lit("j"), F.col("id") % 7))).alias("phone_key"))
    pairs = rows.select(F.col("id").alias("a"), F.explode(F.array(F.col("id") + 40, F.col("id") + 35, F.col("id") + 1)).alias("b"))
    return J.pairs_sharing_contact(pairs, keys)


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'large') THEN 'big' WHEN contains(p_name, 'small') THEN 'little' WHEN regexp_matches(p_name, '(^| )(gear|bolt)') THEN 'metal' END AS kind FROM part")
def kind_by_pattern(spark, sf_dir):
    kind = J.first_pattern(F.col("p_name"), [("big", "large"), ("little", "small"), ("metal", r"\b(?:gear|bolt)")])
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@query(f"{WITH_LISTINGS}, P AS (SELECT id, area, part AS photo, price_month_idr AS price FROM L WHERE availability = 'available') SELECT x.id, min(y.id) AS match FROM P x JOIN P y ON x.area = y.area AND x.photo = y.photo AND x.id <> y.id AND abs(x.price - y.price) <= 0.15 * greatest(x.price, y.price) GROUP BY x.id")
def same_first_photo(spark, sf_dir):
    rows = listings(spark, sf_dir).filter("availability = 'available'")
    return J.same_first_photo(rows.select("id", "area", F.col("part").alias("photo"), F.col("price_month_idr").alias("price")))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS viewings, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS ratings FROM customer")
def child_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "c_custkey")
    return J.child_counts(table(spark, sf_dir, "customer"), "c_custkey", viewings=orders, ratings=events)


@query("SELECT n_nationkey, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS members FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def team_members(spark, sf_dir):
    out = J.collected(table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", "s_suppkey")
    return out.select("n_nationkey", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT source, lang, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id % 3 = 0, length(text) DESC, text DESC) AS r FROM documents) WHERE r = 1")
def best_records(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "lang", "text", (F.col("doc_id") % 3 == 0).alias("truncated"))
    return V.best_records(rows, ["source", "lang"]).select("source", "lang", F.md5("text").alias("digest"))


@query("SELECT n_name AS key, coalesce(day - 2, DATE '2001-08-01' - 30) AS since, CASE WHEN day IS NULL THEN 'first' ELSE 'again' END AS kind, row_number() OVER (ORDER BY day IS NULL, day, n_nationkey, n_name) AS place FROM nation LEFT JOIN (SELECT s_nationkey, DATE '2001-07-01' + CAST(max(s_suppkey) % 28 AS INT) AS day FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY s_nationkey) ON s_nationkey = n_nationkey")
def work_queue(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    done = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.expr("date_add(DATE'2001-07-01', int(max(s_suppkey) % 28))").alias("day"))
    done = done.join(nations, "n_nationkey").select(F.col("n_name").alias("key"), "day")
    return V.work_queue(nations.select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("position")), done, "2001-08-01")


@query(f"{WITH_LISTINGS} SELECT id, CASE WHEN status = 'new' THEN 'new' WHEN quantity % 7 = 0 AND price_month_idr IS NOT NULL THEN 'price' WHEN date_diff('day', CAST(last_seen AS DATE), DATE '2001-08-01') >= 7 THEN 'stale' WHEN linenumber % 7 = 2 THEN 'weekly' END AS reason FROM L")
def detail_reasons(spark, sf_dir):
    rows = listings(spark, sf_dir).select(
        "id", F.expr("CASE WHEN status <> 'new' THEN last_seen END").alias("detail_at"), F.col("price_month_idr").alias("price"),
        F.expr("price_month_idr + CASE WHEN quantity % 7 = 0 THEN 1 ELSE 0 END").alias("card_price"), (F.col("linenumber") % 7).alias("refresh_day"),
    )
    return V.detail_reason(rows, "2001-08-01").select("id", "reason")


@query("SELECT user_id, event_id FROM (SELECT *, sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events) WHERE used <= 400")
def digest_within_bytes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("bytes", F.length("props"))
    return V.within_bytes(rows, 400, "user_id", [F.desc("ts"), "event_id"]).select("user_id", "event_id")


@query("SELECT user_id, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM (SELECT user_id, 'quiet_low' AS flag FROM events WHERE event_id % 6 <= 2 UNION ALL SELECT user_id, 'privacy_low' FROM events WHERE event_id % 50 <= 2 UNION ALL SELECT user_id, 'construction' FROM events WHERE event_id % 97 >= 90) GROUP BY user_id")
def viewing_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_id % 6 AS quiet", "event_id % 50 AS privacy", "CASE WHEN event_id % 97 >= 90 THEN 4 ELSE 1 END AS construction")
    return V.viewing_flags(rows, "user_id").select("user_id", F.array_join("flags", ",").alias("flags"))


@query("SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END) WHEN 3 THEN 'done' WHEN 2 THEN 'partly' ELSE 'not_yet' END AS assessed FROM orders GROUP BY o_custkey")
def assessed_states(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey", "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'partly' ELSE 'not_yet' END AS assessed")
    return V.assessed_state(rows, "o_custkey", "assessed")


@query("SELECT o_orderkey, least(o_orderdate, (SELECT min(l_shipdate) - INTERVAL 40 DAY FROM lineitem WHERE l_orderkey = o_orderkey)) AS o_orderdate FROM orders")
def earliest_seen(spark, sf_dir):
    late = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.expr("l_shipdate - INTERVAL 40 DAYS").alias("o_orderdate"))
    return V.earliest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), late, "o_orderkey", "o_orderdate")


@query("SELECT part, string_agg(DISTINCT u, ',' ORDER BY u) AS urls FROM (SELECT l_partkey AS part, unnest(['s' || CAST(l_suppkey % 8 AS VARCHAR), l_returnflag]) AS u FROM lineitem) GROUP BY part")
def merged_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.array(F.concat(F.lit("s"), (F.col("l_suppkey") % 8).cast("string")), "l_returnflag").alias("urls"))
    return V.merged_lists(rows, "part", "urls").select("part", F.array_join("urls", ",").alias("urls"))


@query(
    """WITH P AS (SELECT label, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY label)
  SELECT a.label AS a, b.label AS b, CAST(len(list_intersect(list_transform(a.ids, lambda x: x % 97), list_transform(b.ids, lambda x: x % 97))) AS INT) AS n FROM P a JOIN P b ON b.label = a.label + 1"""
)
def shared_photos(spark, sf_dir):
    photo = F.struct((F.col("vec_id") % 97).cast("string").alias("url"), F.lit(None).cast("string").alias("hash"))
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_sort(F.collect_set(photo)).alias("photos"))
    both = rows.alias("a").join(rows.alias("b"), F.col("b.label") == F.col("a.label") + 1)
    return both.select(F.col("a.label").alias("a"), F.col("b.label").alias("b"), I.shared_photos(F.col("a.photos"), F.col("b.photos")).alias("n"))
