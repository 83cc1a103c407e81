"""Search, scoring and aggregate queries and their SQL."""

from pyspark.sql import functions as F

from hearth.config import WEIGHTS
from hearth.functions.semantics import day_spine, nearest_rank
from hearth.operators import aggregates as A
from hearth.operators import scoring as R
from hearth.operators import search as S
from hearth.plans.q_market import AREAS
from hearth.plans.registry import query
from hearth.session import table
from hearth.sources.listings import WITH_LISTINGS, WITH_POINTS, listings, price_points

LIVE = "availability NOT IN ('gone', 'unlisted') AND status <> 'gone'"
OPEN = f"scope = 'in_filter' AND status NOT IN ('rejected', 'gone') AND {LIVE}"
R1 = "floor({0} * 10 + 0.5) / CAST(10 AS DOUBLE)"


def _found(spark, sf_dir, **filters):
    return listings(spark, sf_dir).filter(S.predicate(**filters))


def _search(name, where, **filters):
    def run(spark, sf_dir):
        return _found(spark, sf_dir, **filters).select("id", "area", "price_month_idr")

    run.__name__ = name
    query(f"{WITH_LISTINGS} SELECT id, area, price_month_idr FROM L WHERE {where}")(run)


_search("search_default", OPEN)
_search("search_area_status", f"status IN ('shortlist', 'viewed') AND area IN ('NATION_1', 'NATION_7') AND {LIVE}", scope="all", status=["shortlist", "viewed"], area=["NATION_1", "NATION_7"])
_search("search_hard_price", f"{OPEN} AND price_month_idr BETWEEN 20000000 AND 60000000", price=(20_000_000, 60_000_000))
_search("search_soft_range", f"{OPEN} AND (beach_km IS NULL OR beach_km <= 3) AND (land_m2 IS NULL OR land_m2 >= 200) AND (land_m2 IS NULL OR land_m2 <= 600) AND (build_m2 IS NULL OR build_m2 >= 100)", beach=3, land=(200, 600), build=(100, None))
_search("search_features", f"{OPEN} AND pool = 1 AND garden = 1 AND bedrooms IN (2, 3) AND furnished = 1", features=["pool", "garden"], bedrooms=[2, 3], furnished=1)
_search("search_style_source", f"{OPEN} AND style IN ('joglo', 'bamboo') AND source = 's3' AND flagged = 1", style=["joglo", "bamboo"], source="s3", flagged=True)
_search("search_term_rent", f"{OPEN} AND term IN ('yearly', 'both') AND for_sale = 0", term=["yearly"])
_search("search_term_sale", f"{OPEN} AND (term IN ('monthly', 'both') OR for_sale = 1)", term=["monthly", "sale"])
_search("search_text", f"{OPEN} AND (title ILIKE '%RED%' OR description ILIKE '%RED%' OR sub_area ILIKE '%RED%' OR ref ILIKE '%RED%')", q=" RED ")
_search("search_text_escaped", f"{OPEN} AND (contains(lower(title), '100%_a') OR contains(lower(sub_area), '100%_a'))", q="100%_A")
_search("search_recent", f"{OPEN} AND first_seen >= TIMESTAMP '2001-05-01'", first_seen_since="2001-05-01")
_GONE = "(availability IN ('gone', 'unlisted') OR status = 'gone')"
_REASON = "coalesce(removed_reason, CASE WHEN availability = 'unlisted' THEN 'unlisted' WHEN availability = 'gone' THEN 'delisted' WHEN status = 'gone' THEN 'taken' END)"
_AT = f"coalesce(removed_at, CASE WHEN {_GONE} THEN last_seen END)"
_search("search_removed_only", f"{_GONE} AND merged_into IS NULL", scope="all", status=["all"], removed="only")
_search("search_removed_reason", f"merged_into IS NULL AND {_REASON} IN ('archived', 'taken') AND {_AT} >= TIMESTAMP '2000-01-01'", scope="all", status=["all"], removed="show", reason=["archived", "taken"], removed_since="2000-01-01")


def _page(name, order, sql_order, extra=""):
    def run(spark, sf_dir):
        rows = _found(spark, sf_dir, scope="all", status=["all"], removed="show") if order == "removed" else _found(spark, sf_dir)
        return S.page(rows, order, 50, 100).select("id", "price_month_idr", "beach_km", "build_m2")

    run.__name__ = name
    where = "merged_into IS NULL" if order == "removed" else OPEN
    query(f"{WITH_LISTINGS} SELECT id, price_month_idr, beach_km, build_m2 FROM L WHERE {where} ORDER BY {sql_order}, id DESC LIMIT 50 OFFSET 100")(run)


_page("page_by_fit", "fit", "stored_fit DESC NULLS LAST, price_month_idr ASC NULLS LAST")
_page("page_by_price", "price", "price_month_idr ASC NULLS LAST")
_page("page_by_beach", "beach", "beach_km ASC NULLS LAST")
_page("page_by_new", "new", "first_seen DESC NULLS LAST")
_page("page_by_size", "size", "build_m2 DESC NULLS LAST, land_m2 DESC NULLS LAST")
_page("page_by_removed", "removed", f"{_AT} DESC NULLS LAST")


@query(f"{WITH_LISTINGS} SELECT count(*) AS total FROM L WHERE {OPEN}")
def search_total(spark, sf_dir):
    return _found(spark, sf_dir).agg(F.count("*").alias("total"))


@query(f"{WITH_LISTINGS} SELECT id, area FROM L ORDER BY CASE WHEN {_GONE} THEN 1 ELSE 0 END, price_month_idr ASC NULLS LAST, id DESC LIMIT 40")
def live_first_top(spark, sf_dir):
    return S.ordered(listings(spark, sf_dir), "price", live_first=True).limit(40).select("id", "area")


@query(f"{WITH_LISTINGS} SELECT id, region FROM L WHERE region = 'ASIA' OR region LIKE '%2%'")
def search_region(spark, sf_dir):
    return listings(spark, sf_dir).filter((F.col("region") == "ASIA") | F.col("region").contains("2")).select("id", "region")


@query(f"{WITH_LISTINGS} SELECT id, CAST(round(lat * 100) AS BIGINT) AS lat_c, CAST(round(lng * 100) AS BIGINT) AS lng_c FROM L WHERE (lat + 8.65) * (lat + 8.65) + ((lng - 115.3) * cos(radians(-8.65))) * ((lng - 115.3) * cos(radians(-8.65))) <= (20 / 111.32) * (20 / 111.32)")
def search_radius(spark, sf_dir):
    return listings(spark, sf_dir).filter(S.within(-8.65, 115.3, 20)).select("id", *[F.round(F.col(c) * 100).cast("long").alias(f"{c}_c") for c in ("lat", "lng")])


VOTES = """WITH V0 AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, user_id AS voter, CASE WHEN value < 5 THEN 'yes' WHEN value < 15 THEN 'maybe' ELSE 'no' END AS verdict, ts AS cast_at, event_id AS seq FROM events),
V AS (SELECT item, voter, verdict, cast_at FROM (SELECT *, row_number() OVER (PARTITION BY item, voter ORDER BY cast_at DESC, seq DESC) AS rn FROM V0) WHERE rn = 1),
O AS (SELECT item, verdict AS other FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY cast_at DESC, voter DESC) AS rn FROM V WHERE voter <> 7 AND voter % 3 = 1) WHERE rn = 1),
M AS (SELECT item, verdict AS mine FROM V WHERE voter = 7),
X AS (SELECT DISTINCT item FROM V), J AS (SELECT item, mine, other FROM X LEFT JOIN M USING (item) LEFT JOIN O USING (item))"""


def _votes(spark, sf_dir):
    verdict = F.when(F.col("value") < 5, "yes").when(F.col("value") < 15, "maybe").otherwise("no")
    rows = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("item"), F.col("user_id").alias("voter"), verdict.alias("verdict"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return S.latest_verdicts(rows)


@query(f"{VOTES} SELECT * FROM J")
def verdicts_mine_and_theirs(spark, sf_dir):
    return S.my_and_theirs(_votes(spark, sf_dir), 7, F.col("voter") % 3 == 1)


_MODES = {
    "match": "mine = 'yes' AND other = 'yes'", "waiting_other": "mine IS NOT NULL AND mine <> 'no' AND other IS NULL", "waiting_me": "mine IS NULL AND other IS NOT NULL",
    "disagree": "mine <> other", "yes": "mine = 'yes' OR other = 'yes'", "maybe": "mine = 'maybe' OR other = 'maybe'", "no": "mine = 'no' OR other = 'no'",
    "not_no": "coalesce(mine, '') <> 'no' AND coalesce(other, '') <> 'no'", "unvoted": "mine IS NULL AND other IS NULL",
}


@query(f"{VOTES}, K AS (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, item FROM J WHERE {w}" for m, w in _MODES.items()) + ") SELECT mode, count(*) AS n, CAST(sum(item) AS BIGINT) AS items FROM K GROUP BY mode")
def verdict_modes(spark, sf_dir):
    both = S.my_and_theirs(_votes(spark, sf_dir), 7, F.col("voter") % 3 == 1)
    modes = F.array_compact(F.array(*[F.when(c, m) for m, c in S.verdict_mode().items()]))
    return both.select("item", F.explode(modes).alias("mode")).groupBy("mode").agg(F.count("*").alias("n"), F.sum("item").alias("items"))


@query(f"{VOTES} SELECT voter, count(*) FILTER (WHERE verdict = 'yes') AS yes, count(*) FILTER (WHERE verdict = 'maybe') AS maybe, count(*) FILTER (WHERE verdict = 'no') AS \"no\" FROM V GROUP BY voter")
def verdict_counts(spark, sf_dir):
    return _votes(spark, sf_dir).groupBy("voter").pivot("verdict", ["yes", "maybe", "no"]).count().fillna(0, ["yes", "maybe", "no"])


@query(f"""{WITH_LISTINGS}, P AS (SELECT *, price_month_idr / CAST(build_m2 AS DOUBLE) AS m2 FROM L WHERE price_month_idr IS NOT NULL AND build_m2 > 0), A AS (SELECT area, CAST(floor(median(m2) + 0.5) AS BIGINT) AS area_m2 FROM P WHERE availability NOT IN ('gone', 'unlisted') GROUP BY area)
SELECT id, CAST(floor(m2 + 0.5) AS BIGINT) AS price_per_m2, area_m2, CAST(floor((m2 - area_m2) * 100 / area_m2 + 0.5) AS BIGINT) AS vs_area_pct, CAST(floor((1 - price_year_idr / CAST(price_month_idr * 12 AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS yearly_saving_pct FROM P LEFT JOIN A USING (area)""")
def value_fields(spark, sf_dir):
    return S.value_fields(listings(spark, sf_dir))


STATES = "T AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS part, CAST(user_id % 3 AS INT) AS team, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1, 2)"


@query(f"{WITH_LISTINGS}, {STATES} SELECT L.id, coalesce(T.status, 'new') AS status FROM L LEFT JOIN T ON T.part = L.part AND T.team = 2")
def team_overlay(spark, sf_dir):
    rows = listings(spark, sf_dir)
    states = table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("part"), (F.col("user_id") % 3).cast("int").alias("team")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    by_id = states.join(rows.select("id", "part"), "part").select("id", "team", "status")
    return S.overlay(rows, by_id, 2).select("id", "status")


BEACHES = [("north", -8.3, 115.1), ("west", -8.6, 115.0), ("south", -8.9, 115.5), ("east", -8.5, 115.8)]
_POINTS = ", ".join(f"('{n}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for n, a, b in BEACHES)


@query(f"""{WITH_LISTINGS}, P(name, p_lat, p_lng) AS (VALUES {_POINTS}), D AS (SELECT id, name, 2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(p_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(p_lat)) * pow(sin(radians(p_lng - lng) / 2), 2)))) AS km FROM L CROSS JOIN P)
SELECT id, arg_min(name, km) AS name, {R1.format("min(km) * 1.3")} AS km FROM D GROUP BY id""")
def nearest_beach(spark, sf_dir):
    return S.nearest_of(listings(spark, sf_dir).withColumns({"lat": F.col("lat").cast("double"), "lng": F.col("lng").cast("double")}), BEACHES)


_W = WEIGHTS
_RAMP = "greatest(0.0, least(1.0, ({0} - {1}) / CAST({2} AS DOUBLE)))"
_HALF = " + ".join(f"CASE WHEN {k} = 1 THEN {_W[k]} WHEN {k} IS NULL THEN {_W[k] // 2} ELSE 0 END" for k in ("living_open", "airy", "kitchen_full", "aircon"))
_FULL = " + ".join(f"CASE WHEN {k} = 1 THEN {_W[k]} ELSE 0 END" for k in ("pool", "garden", "workspace", "joglo"))
POINTS = f"""floor(coalesce({_RAMP.format("beach_km", 8, -7)}, 0.5) * {_W["beach"]} + 1e-9)
 + floor(CASE WHEN land_m2 > 0 THEN {_RAMP.format("land_m2", 200, 300)} ELSE 0.5 END * {_W["land"]} + 1e-9)
 + floor(CASE WHEN price_month_idr > 0 THEN least({_RAMP.format("price_month_idr", 30000000, 20000000)}, {_RAMP.format("price_month_idr", 80000000, -10000000)}) ELSE 0.5 END * {_W["price"]} + 1e-9)
 + {_HALF} + {_FULL} + CASE view_kind WHEN 'ocean' THEN 14 WHEN 'rice' THEN 14 WHEN 'river' THEN 10 WHEN 'jungle' THEN 7 ELSE 0 END
 + CASE style WHEN 'joglo' THEN 12 WHEN 'bamboo' THEN 12 WHEN 'tropical' THEN 8 ELSE 0 END
 + CASE WHEN furnished = 1 THEN CASE WHEN furniture_quality >= 3 THEN 3 WHEN furniture_quality IS NULL THEN 1 ELSE 0 END WHEN furnished IS NULL THEN 1 ELSE 0 END"""
SCORED = f"""{WITH_LISTINGS}, F AS (SELECT *, CAST(greatest(0, least(100, floor(({POINTS}) * 100 / CAST({sum(_W.values())} AS DOUBLE) + 0.5))) AS INT) AS fit_score,
 array_to_string(list_filter([CASE WHEN NOT coalesce(bedrooms BETWEEN 1 AND 3 AND bedrooms + extra_rooms >= 2, false) THEN 'rooms' END, CASE WHEN NOT coalesce(price_month_idr BETWEEN 20000000 AND 80000000, false) THEN 'budget' END, CASE WHEN area NOT IN {AREAS} THEN 'area' END, CASE WHEN style = 'balinese_old' THEN 'style' END], lambda x: x IS NOT NULL), ',') AS fails FROM L)"""


@query(f"""{SCORED} SELECT id, CASE WHEN fails = '' THEN 'in_filter' ELSE 'market' END AS scope, fit_score, coalesce(price_month_idr > 80000000, false) AS over_budget, CAST(fails = '' AND fit_score >= 65 AND {LIVE} AND status <> 'rejected' AS INT) AS flagged, fails FROM F""")
def fit_scores(spark, sf_dir):
    return R.score_rows(listings(spark, sf_dir)).drop("reasons")


@query(f"""{WITH_LISTINGS}, R AS (SELECT *, floor(price_month_idr / 1e6 * 10 + 0.5) / CAST(10 AS DOUBLE) AS m FROM L)
SELECT id, concat_ws(', ', bedrooms || 'BR' || CASE WHEN extra_rooms > 0 THEN ' +' || extra_rooms ELSE '' END, CASE WHEN area <> 'other' THEN area END, CAST(beach_km AS DOUBLE) || ' km to beach', CASE WHEN m = floor(m) THEN CAST(CAST(m AS BIGINT) AS VARCHAR) ELSE CAST(m AS VARCHAR) END || ' M/mo',
 CASE WHEN pool = 1 THEN 'pool' END, CASE WHEN garden = 1 THEN 'garden' END, CASE view_kind WHEN 'ocean' THEN 'ocean view' WHEN 'rice' THEN 'ricefield view' WHEN 'river' THEN 'river view' WHEN 'jungle' THEN 'jungle view' END, CASE WHEN joglo = 1 THEN 'joglo' END, CASE WHEN workspace = 1 THEN 'workspace' END) AS reasons FROM R""")
def fit_reasons(spark, sf_dir):
    return R.score_rows(listings(spark, sf_dir)).select("id", "reasons")


@query(f"{WITH_LISTINGS}, S AS (SELECT CAST(unnest(range(10)) AS INT) AS bucket), C AS (SELECT CAST(least(9, stored_fit // 10) AS INT) AS bucket FROM L) SELECT S.bucket, count(C.bucket) AS n FROM S LEFT JOIN C USING (bucket) GROUP BY S.bucket")
def fit_histogram(spark, sf_dir):
    return A.histogram(listings(spark, sf_dir), A.fit_bucket(F.col("stored_fit")), 10)


@query(f"{WITH_LISTINGS} SELECT CASE WHEN beach_km IS NULL THEN 'unknown' WHEN beach_km < 0.5 THEN '0-0.5' WHEN beach_km < 1 THEN '0.5-1' WHEN beach_km < 2 THEN '1-2' WHEN beach_km < 3 THEN '2-3' WHEN beach_km < 4 THEN '3-4' ELSE '4+' END AS label, count(*) AS n FROM L GROUP BY 1")
def beach_histogram(spark, sf_dir):
    return listings(spark, sf_dir).groupBy(A.distance_label(F.col("beach_km")).alias("label")).agg(F.count("*").alias("n"))


@query(f"{WITH_LISTINGS}, S AS (SELECT CAST(unnest(range(13)) AS INT) AS bucket), C AS (SELECT CAST(greatest(0, least(12, floor((price_month_idr - 20000000) / CAST(5000000 AS DOUBLE)))) AS INT) AS bucket FROM L WHERE price_month_idr IS NOT NULL) SELECT S.bucket, count(C.bucket) AS n FROM S LEFT JOIN C USING (bucket) GROUP BY S.bucket")
def price_histogram(spark, sf_dir):
    rows = listings(spark, sf_dir).filter("price_month_idr is not null")
    return A.histogram(rows, A.price_bucket(F.col("price_month_idr"), 20_000_000, 5_000_000, 13), 13)


@query("WITH D AS (SELECT CAST(DATE '2024-01-31' - CAST(i AS INT) AS DATE) AS day FROM range(40) t(i)), C AS (SELECT CAST(ts + INTERVAL 8 HOURS AS DATE) AS day, count(*) FILTER (WHERE event_type = 'signup') AS signups, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) AS n FROM events GROUP BY 1) SELECT day, coalesce(signups, 0) AS signups, coalesce(purchases, 0) AS purchases, coalesce(n, 0) AS n FROM D LEFT JOIN C USING (day)")
def daily_activity(spark, sf_dir):
    day = (F.col("ts") + F.expr("INTERVAL 8 HOURS")).cast("date").alias("day")
    counts = table(spark, sf_dir, "events").groupBy(day).agg(F.count_if(F.col("event_type") == "signup").alias("signups"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count("*").alias("n"))
    return day_spine(spark, 40, "2024-01-31").join(counts, "day", "left").fillna(0, ["signups", "purchases", "n"])


@query(f"{WITH_LISTINGS}{WITH_POINTS} SELECT day, count(*) AS changes FROM H WHERE pos >= 1 GROUP BY day")
def price_change_days(spark, sf_dir):
    return price_points(listings(spark, sf_dir)).filter("pos >= 1").groupBy("day").agg(F.count("*").alias("changes"))


@query(f"{WITH_LISTINGS} SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) FILTER (WHERE availability = 'available') AS available, count(*) FILTER (WHERE availability = 'gone') AS gone, count(*) FILTER (WHERE availability = 'unlisted') AS unlisted, count(*) AS n FROM L GROUP BY GROUPING SETS ((source), ())")
def state_audit(spark, sf_dir):
    return A.audit(listings(spark, sf_dir), "availability", ["available", "gone", "unlisted"], "source")


@query("SELECT event_type, count(*) AS n, floor(CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) / count(*) * 10 + 0.5) / CAST(10 AS DOUBLE) AS average FROM events GROUP BY event_type")
def rating_averages(spark, sf_dir):
    return A.rating_averages(table(spark, sf_dir, "events"), "event_type", "value")


@query(f"{WITH_LISTINGS} SELECT ref, count(DISTINCT area) AS areas, count(DISTINCT bedrooms) AS rooms FROM L GROUP BY ref HAVING count(DISTINCT area) >= 2 OR count(DISTINCT bedrooms) >= 2")
def promo_keys(spark, sf_dir):
    return A.repeated_in(listings(spark, sf_dir), "ref", "area", "bedrooms")


@query(f"{WITH_LISTINGS} SELECT lower(trim(sub_area)) AS pocket, count(*) AS n FROM L WHERE status = 'rejected' AND trim(sub_area) <> '' GROUP BY 1 HAVING count(*) >= 2")
def pocket_mining(spark, sf_dir):
    return A.pockets(listings(spark, sf_dir))


@query(f"{WITH_LISTINGS} SELECT ref, arg_max(id, (length(title), id)) AS best_id, max(price_month_idr) AS top_price, min(first_seen) AS first_seen FROM L GROUP BY ref")
def best_of_group(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("ref").agg(F.max_by("id", F.struct(F.length("title"), "id")).alias("best_id"), F.max("price_month_idr").alias("top_price"), F.min("first_seen").alias("first_seen"))


@query(f"{WITH_LISTINGS} SELECT area, count(*) AS n, count(*) FILTER (WHERE availability = 'gone') AS gone, count(DISTINCT CASE WHEN status = 'viewed' THEN ref END) AS viewed, count(*) FILTER (WHERE status = 'shortlist') AS shortlisted, CAST(quantile_disc(price_month_idr, 0.5) FILTER (WHERE availability <> 'gone') AS BIGINT) AS median_price FROM L GROUP BY area")
def by_area(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("area").agg(F.count("*").alias("n"), F.count_if(F.col("availability") == "gone").alias("gone"), F.countDistinct(F.when(F.col("status") == "viewed", F.col("ref"))).alias("viewed"), F.count_if(F.col("status") == "shortlist").alias("shortlisted"), nearest_rank(0.5, "price_month_idr", where="availability <> 'gone'").alias("median_price"))


@query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 1")
def last_run(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'signup'").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "ts", "user_id")


@query("WITH F AS (SELECT CASE event_type WHEN 'view' THEN 'pool' WHEN 'click' THEN 'beach' WHEN 'error' THEN 'workspace' WHEN 'signup' THEN 'airy' ELSE 'unheard' END AS feature, value < 2 AS negative FROM events WHERE value < 2.1), D AS (SELECT feature, CAST(sum(CASE WHEN negative THEN 2 ELSE 1 END) AS BIGINT) AS delta FROM F GROUP BY feature), W AS (SELECT unnest(['pool', 'beach', 'workspace', 'airy']) AS feature, unnest([6, 8, 3, 7]) AS w) SELECT feature, delta, CAST(greatest(w, least(20, w + delta)) AS INT) AS weight FROM D JOIN W USING (feature)")
def learned_weights(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for x in ("view", "pool", "click", "beach", "error", "workspace", "signup", "airy")])
    rows = table(spark, sf_dir, "events").filter("value < 2.1").select(F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("unheard")).alias("feature"), (F.col("value") < 2).alias("negative"))
    return R.learned_weights(rows, WEIGHTS)


