"""Duplicate, snapshot, sequence and stream queries and their SQL."""

from pyspark.sql import functions as F

from hearth.functions.semantics import half_up, nearest_rank
from hearth.operators import aggregates as A
from hearth.operators import duplicates as D2
from hearth.operators import sequences as Q
from hearth.operators import similarity as D
from hearth.operators import upsert as U
from hearth.operators.pairs import PairLists, version_of
from hearth.plans.registry import query
from hearth.session import settle, table
from hearth.sources.listings import TABLES, WITH_LISTINGS, WITH_POINTS, listings, price_points
from hearth.streaming import events as X

#: Each vector's signs, and a copy with its first bits turned over.
HASHES = "H0 AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings), H AS (SELECT id, bits FROM H0 UNION ALL SELECT id + 1000000, list_transform(bits, lambda x, i: CASE WHEN i <= 1 + id % 8 THEN 1 - x ELSE x END) FROM H0)"


@query(f"WITH {HASHES} SELECT a.id AS a, b.id AS b, CAST(len(list_filter(list_zip(a.bits, b.bits), lambda p: p[1] <> p[2])) AS INT) AS distance FROM H a JOIN H b ON a.id < b.id WHERE len(list_filter(list_zip(a.bits, b.bits), lambda p: p[1] <> p[2])) <= 6")
def hamming_pairs(spark, sf_dir):
    hashes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), D.sign_bits(F.col("embedding")).alias("hash"))
    turned = F.col("hash").bitwiseXOR(F.expr("shiftleft(1L, CAST(1 + id % 8 AS INT)) - 1"))
    hashes = hashes.unionByName(hashes.select((F.col("id") + 1_000_000).alias("id"), turned.alias("hash")))
    return D.close_hashes(hashes).select("a", "b", F.col("distance").cast("int").alias("distance"))


@query("""WITH N AS (SELECT DISTINCT trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS id FROM part),
G AS (SELECT id, g, count(*) AS c FROM (SELECT id, substr(id, CAST(unnest(range(1, greatest(1, length(id) - 2) + 1)) AS INT), 3) AS g FROM N) GROUP BY id, g),
S AS (SELECT id, sum(c) AS n FROM G GROUP BY id)
SELECT a, b, dice FROM (SELECT x.id AS a, y.id AS b, round(2 * CAST(sum(least(x.c, y.c)) AS DOUBLE) / CAST(any_value(s.n) + any_value(t.n) AS DOUBLE), 6) AS dice FROM G x JOIN G y ON x.g = y.g AND x.id < y.id JOIN S s ON s.id = x.id JOIN S t ON t.id = y.id GROUP BY x.id, y.id) WHERE dice >= 0.6""")
def title_dice(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(D.normal_text(F.concat_ws(" ", "p_name", "p_type")).alias("id")).distinct()
    return D.dice_pairs(names.withColumn("text", F.col("id")), 0.6)


FILLED = ["title", "description", "land_m2", "build_m2", "price_month_idr", "price_year_idr", "style", "beach_km"]
#: Signals of the listings view: the supplier is the contact, two photos and the source's logo, pins of parts and suppliers.
SIGNALS = {
    "title": "concat(title, ' ', substr(md5(CAST(part AS STRING)), 1, 20))",
    "land_m2": "CASE WHEN part % 11 > 0 THEN 50 + (part * 37 + quantity * 13) % 900 END",
    "build_m2": "CASE WHEN supplier % 9 > 0 THEN 20 + (part * 7 + supplier * 3) % 300 END",
    "poster": "CASE WHEN linenumber % 3 = 1 THEN concat('u', CAST(supplier % 50 AS STRING)) END",
    "contacts": "CASE WHEN quantity % 10 < 8 THEN {0}concat('tel', CAST(supplier AS STRING)){1} END",
    "photos": "{0}concat('p', CAST(part AS STRING), '-', area), concat('q', CAST(part AS STRING), '-', area, '-', CAST(quantity % 3 AS STRING)), concat('logo-', source){1}",
}
SIGNALS_SQL = ", ".join(f"{x.format('[', ']')} AS {n}" for n, x in SIGNALS.items() if n != "title")


def signal_rows(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumns({n: F.expr(x.format("array(", ")")) for n, x in SIGNALS.items()})
    return rows.withColumns({"url": F.concat(F.lit("u/"), "id"), "alt_urls": F.array().cast("array<string>")})


def _promo(rows):
    each = rows.filter("availability <> 'gone'").select("area", "bedrooms", F.explode("photos").alias("photo"))
    return A.repeated_in(each, "photo", "area", "bedrooms")


_NEAR = "abs(a.price_month_idr - b.price_month_idr) <= {0} * greatest(a.price_month_idr, b.price_month_idr)"
_NORM = "nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), '')"
ROWS = f"""{WITH_LISTINGS}, S AS MATERIALIZED (SELECT id, source, ref, area, bedrooms, price_month_idr, lat, lng, first_seen, availability, merged_into, {SIGNALS_SQL},
 {_NORM.format(SIGNALS["title"])} AS title_key, nullif(substr({_NORM.format("description")}, 1, 60), '') AS opening FROM L),
G AS (SELECT title_key AS t, g, count(*) AS c FROM (SELECT title_key, substr(title_key, CAST(unnest(range(1, greatest(1, length(title_key) - 2) + 1)) AS INT), 3) AS g FROM (SELECT DISTINCT title_key FROM S)) GROUP BY 1, 2),
N AS (SELECT t, sum(c) AS n FROM G GROUP BY t),
T AS MATERIALIZED (SELECT x.t AS ta, y.t AS tb, round(2 * CAST(sum(least(x.c, y.c)) AS DOUBLE) / CAST(any_value(s.n) + any_value(u.n) AS DOUBLE), 6) AS dice FROM G x JOIN G y ON x.g = y.g JOIN N s ON s.t = x.t JOIN N u ON u.t = y.t GROUP BY 1, 2 HAVING dice >= 0.6)"""
_UNIT = "(a.source = b.source AND regexp_extract(a.ref, '^([A-Z]+[0-9]+)[A-Z]?$', 1) = regexp_extract(b.ref, '^([A-Z]+[0-9]+)[A-Z]?$', 1) AND a.ref <> b.ref)"
_SHARED = "len(list_intersect(a.photos, b.photos))"
_PIN = "a.lat = b.lat AND a.lng = b.lng"
_BESIDE = ["a.area = b.area", _PIN, "a.land_m2 = b.land_m2", "a.build_m2 = b.build_m2", "a.poster = b.poster"]
_ALIKE = ["a.contacts = b.contacts", "a.photos[1] = b.photos[1]", "a.photos[2] = b.photos[2]", "a.opening = b.opening", "a.land_m2 = b.land_m2 AND a.build_m2 = b.build_m2 AND a.poster = b.poster"]
_ALIKE += [f"{_BESIDE[i]} AND {_BESIDE[j]}" for i in (0, 1) for j in range(1, 5) if i != j]
_PAIR = "SELECT a.id AS a, b.id AS b FROM R a JOIN {0}R b ON a.bedrooms = b.bedrooms AND a.id < b.id AND {1}"
#: Pairs that have something in common; a test on the smallest tables compares all pairs instead.
SOME_PAIRS = " UNION ".join([_PAIR.format("", on) for on in _ALIKE] + [_PAIR.format("T ON T.ta = a.title_key JOIN ", f"b.title_key = T.tb AND {on}") for on in _BESIDE])
ALL_PAIRS = "SELECT a.id AS a, b.id AS b FROM R a JOIN R b ON a.bedrooms = b.bedrooms AND a.id < b.id"
CANDIDATES = f"""{ROWS}, R AS MATERIALIZED (SELECT S.* REPLACE (list_filter(photos, lambda p: NOT starts_with(p, 'logo')) AS photos) FROM S WHERE availability <> 'gone' AND bedrooms IS NOT NULL),
K AS MATERIALIZED ({SOME_PAIRS}),
P AS (SELECT a.id AS a, b.id AS b, a.source AS source_a, b.source AS source_b, a.first_seen AS first_seen_a, b.first_seen AS first_seen_b, a.title_key AS ta, b.title_key AS tb,
  CASE WHEN a.area = b.area THEN 150 ELSE 0 END + CASE WHEN {_NEAR.format("CAST(0.05 AS DOUBLE)")} THEN 250 WHEN {_NEAR.format("CAST(0.1 AS DOUBLE)")} THEN 100 ELSE 0 END + CASE WHEN a.contacts = b.contacts THEN 350 ELSE 0 END
  + CASE {_SHARED} WHEN 0 THEN 0 WHEN 1 THEN 350 ELSE 600 END + CASE WHEN a.opening = b.opening THEN 200 ELSE 0 END + CASE WHEN a.land_m2 = b.land_m2 THEN 100 ELSE 0 END + CASE WHEN a.build_m2 = b.build_m2 THEN 100 ELSE 0 END
  + CASE WHEN a.lat = b.lat AND a.lng = b.lng THEN 150 ELSE 0 END + CASE WHEN a.poster = b.poster THEN 100 ELSE 0 END AS s

 FROM K JOIN R a ON a.id = K.a JOIN R b ON b.id = K.b WHERE (CASE WHEN a.price_month_idr IS NULL OR b.price_month_idr IS NULL THEN a.area = b.area ELSE {_NEAR.format("CAST(0.15 AS DOUBLE)")} END) AND NOT {_UNIT}),
C AS MATERIALIZED (SELECT a, b, source_a, source_b, first_seen_a, first_seen_b, least(1000, s + CASE WHEN dice >= 0.8 THEN 200 WHEN dice >= 0.6 THEN 100 ELSE 0 END) / CAST(1000 AS DOUBLE) AS score FROM (SELECT * FROM P WHERE s >= 300) LEFT JOIN T USING (ta, tb))"""


def found_candidates(spark, sf_dir, least):
    """Pairs without promotion pictures, by a search of their own."""
    rows = signal_rows(spark, sf_dir)
    return D2.candidates(rows.withColumn("photos", F.filter("photos", lambda p: ~p.startswith("logo"))), least)


def _candidates(spark, sf_dir, least):
    """The same, found once for the tables as they are and a least score, then read."""
    version = version_of(spark, *[f"{sf_dir}/{t}.parquet" for t in TABLES])
    return PairLists(spark).at(version, "candidates", least, lambda score: found_candidates(spark, sf_dir, score))


@query(f"{CANDIDATES} SELECT a, b, score FROM C WHERE score >= 0.6")
def dup_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir, 0.6).select("a", "b", "score")


@query(f"{CANDIDATES}, E AS (SELECT a AS id, b AS other, score FROM C WHERE score >= 0.5 UNION ALL SELECT b, a, score FROM C WHERE score >= 0.5), O AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS place FROM E) SELECT id, other, score, place FROM O WHERE place <= 10")
def dup_candidates_by_listing(spark, sf_dir):
    return D2.candidates_of(_candidates(spark, sf_dir, 0.5), signal_rows(spark, sf_dir).select("id")).select("id", "other", "score", F.col("place").cast("long").alias("place"))


@query(f"{CANDIDATES} SELECT a, b, CASE WHEN (source_a = 's0', first_seen_a, a) <= (source_b = 's0', first_seen_b, b) THEN a ELSE b END AS keep FROM C WHERE score >= 0.8")
def dup_keepers(spark, sf_dir):
    return D2.keeper_first(_candidates(spark, sf_dir, 0.8), ["s0"]).select("a", "b", "keep")


#: Likely pairs that the gaps take, best first.
MOST_LIKELY = 200
GAPS = f"""{CANDIDATES}, O AS (SELECT a, b, 'merged' AS kind FROM (SELECT merged_into AS a, id AS b FROM S WHERE merged_into IS NOT NULL) UNION ALL
 SELECT a, b, 'candidate' FROM (SELECT * FROM C WHERE score >= 0.6 ORDER BY score DESC, a, b LIMIT {MOST_LIKELY}) WHERE source_a IS DISTINCT FROM source_b),
 U AS (SELECT * FROM O QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY kind DESC, a DESC) = 1),
 Z AS (SELECT U.a, U.b, x.source AS source_a, y.source AS source_b, x.price_month_idr AS price_a, y.price_month_idr AS price_b, floor((y.price_month_idr - x.price_month_idr) / x.price_month_idr * 100 * 10 + 0.5) / CAST(10 AS DOUBLE) AS gap_pct, kind
  FROM U JOIN S x ON x.id = U.a JOIN S y ON y.id = U.b WHERE x.price_month_idr > 0 AND y.price_month_idr IS NOT NULL AND U.a <> U.b)"""


def _gaps(spark, sf_dir):
    # the best pairs are those of the highest score that has enough of them: lower ones needn't be found
    for least in (1.0, 0.8, 0.6):
        likely = settle(_candidates(spark, sf_dir, least).orderBy(F.desc("score"), "a", "b").limit(MOST_LIKELY), "likely")
        if likely.count() == MOST_LIKELY:
            break
    return D2.cross_source_gaps(listings(spark, sf_dir), likely)


@query(f"{GAPS} SELECT * FROM Z ORDER BY abs(gap_pct) DESC, a, b LIMIT 30")
def cross_source_gaps(spark, sf_dir):
    return _gaps(spark, sf_dir).orderBy(F.desc(F.abs("gap_pct")), "a", "b").limit(30)


@query(f"{GAPS} SELECT count(*) AS n_pairs, floor(quantile_disc(abs(gap_pct), 0.5) * 10 + 0.5) / CAST(10 AS DOUBLE) AS median_gap_pct FROM Z")
def cross_source_gap_summary(spark, sf_dir):
    gaps = _gaps(spark, sf_dir).withColumn("g", F.abs("gap_pct"))
    return gaps.agg(F.count("*").alias("n_pairs"), half_up(nearest_rank(0.5, "g", "double"), 1).alias("median_gap_pct"))


#: All logos are promotion pictures: each stands in several areas.
AUTOMATIC = f"""{ROWS}, R AS MATERIALIZED (SELECT S.* REPLACE (list_filter(photos, lambda p: NOT starts_with(p, 'logo')) AS photos) FROM S WHERE availability <> 'gone' AND merged_into IS NULL),
P AS (SELECT a.id AS a, b.id AS b, a.title_key AS ta, b.title_key AS tb, a.source IS DISTINCT FROM b.source AS apart, a.opening = b.opening AS same, {_SHARED} AS shared, a.bedrooms = b.bedrooms AND coalesce({_NEAR.format("CAST(0.05 AS DOUBLE)")}, FALSE) AS close,
  coalesce(a.bedrooms = b.bedrooms, TRUE) AS agree, a.source AS source_a, b.source AS source_b, a.first_seen AS first_seen_a, b.first_seen AS first_seen_b FROM R a JOIN R b ON a.area = b.area AND a.id < b.id WHERE NOT {_UNIT}),
C AS MATERIALIZED (SELECT *, coalesce(CASE WHEN close THEN CASE WHEN dice >= 0.8 AND apart THEN printf('title similarity %.2f', dice) WHEN same THEN 'same first 60 letters' WHEN shared >= 1 THEN 'shared photo' END END, CASE WHEN agree AND shared >= 2 THEN shared || ' shared photos' END) AS reason FROM P LEFT JOIN T USING (ta, tb))"""


@query(f"{AUTOMATIC} SELECT a, b, reason FROM C WHERE reason IS NOT NULL")
def dup_automatic(spark, sf_dir):
    rows = signal_rows(spark, sf_dir)
    return D2.automatic_pairs(rows, _promo(rows)).select("a", "b", "reason")


@query()
def dup_merges(spark, sf_dir):
    """Held against a pass over the pairs one by one in the tests."""
    rows = signal_rows(spark, sf_dir)
    return D2.merges_of(D2.automatic_pairs(rows, _promo(rows)), ["s0"])


@query()
def dup_settled(spark, sf_dir):
    rows = signal_rows(spark, sf_dir)
    return D2.settle_import(rows, ["s0"], "2001-08-01", FILLED, _promo(rows))


_MERGES = "SELECT merged_into AS keep, id AS gone FROM L WHERE merged_into IS NOT NULL"


@query(f"""{WITH_LISTINGS.replace("L AS (SELECT * REPLACE (", "L AS (SELECT * REPLACE (" + SIGNALS["land_m2"] + " AS land_m2, ")}, M AS ({_MERGES}), K AS (SELECT M.keep, arg_min(L.land_m2, L.id) FILTER (WHERE L.land_m2 IS NOT NULL) AS land_m2, arg_min(L.price_month_idr, L.id) FILTER (WHERE L.price_month_idr IS NOT NULL) AS price, list_sort(list('u/' || L.id)) AS urls FROM M JOIN L ON L.id = M.gone GROUP BY M.keep)
 SELECT L.id, CASE WHEN M.gone IS NULL THEN coalesce(L.land_m2, K.land_m2) ELSE L.land_m2 END AS land_m2, CASE WHEN M.gone IS NULL THEN coalesce(L.price_month_idr, K.price) ELSE L.price_month_idr END AS price_month_idr, CASE WHEN M.gone IS NOT NULL THEN '' ELSE coalesce(array_to_string(K.urls, ' '), '') END AS alt_urls,
 CASE WHEN M.gone IS NOT NULL THEN 'gone' ELSE L.availability END AS availability, CASE WHEN M.gone IS NOT NULL THEN 'merged' ELSE L.removed_reason END AS removed_reason, coalesce(M.keep, L.merged_into) AS merged_into FROM L LEFT JOIN M ON M.gone = L.id LEFT JOIN K ON K.keep = L.id""")
def merges_applied(spark, sf_dir):
    rows = signal_rows(spark, sf_dir)
    merges = rows.filter("merged_into is not null").select(F.col("merged_into").alias("keep"), F.col("id").alias("gone"))
    out = D2.apply_merges(rows, merges, ["land_m2", "price_month_idr"], "2001-08-01")
    return out.select("id", "land_m2", "price_month_idr", F.array_join("alt_urls", " ").alias("alt_urls"), "availability", "removed_reason", "merged_into")


@query(f"{WITH_LISTINGS}, M AS ({_MERGES}), C AS (SELECT id, 'tel' || supplier % 20 AS contact FROM L) SELECT DISTINCT coalesce(M.keep, C.id) AS id, contact FROM C LEFT JOIN M ON M.gone = C.id")
def merged_contacts(spark, sf_dir):
    rows = listings(spark, sf_dir)
    merges = rows.filter("merged_into is not null").select(F.col("merged_into").alias("keep"), F.col("id").alias("gone"))
    return D2.move_children(rows.select("id", F.expr("concat('tel', CAST(supplier % 20 AS STRING))").alias("contact")), merges, "id", once=True)


@query(f"{WITH_LISTINGS}, Q AS (SELECT CASE WHEN linenumber = 1 THEN 'nobody' WHEN linenumber = 2 THEN id ELSE coalesce(merged_into, 'nobody') END AS keep, id AS merge FROM L) SELECT Q.keep, Q.merge, CASE WHEN K.id IS NULL THEN 'not_found' WHEN Q.keep = Q.merge THEN 'same_row' WHEN M.availability = 'gone' OR M.merged_into IS NOT NULL THEN 'already_gone' WHEN K.merged_into IS NOT NULL THEN 'keeper_merged' END AS refusal FROM Q LEFT JOIN L K ON K.id = Q.keep JOIN L M ON M.id = Q.merge")
def merge_refusals(spark, sf_dir):
    rows = listings(spark, sf_dir)
    keep = F.expr("CASE WHEN linenumber = 1 THEN 'nobody' WHEN linenumber = 2 THEN id ELSE coalesce(merged_into, 'nobody') END")
    return D2.manual_merges(rows.select(keep.alias("keep"), F.col("id").alias("merge")), rows)


_OLD = "SELECT id, title, price_month_idr, availability, build_m2, land_m2, furniture_quality, last_seen, removed_at, merged_into FROM L WHERE linenumber <= 5"
_NEW = "SELECT id, CASE WHEN quantity % 4 = 0 THEN NULL ELSE title END AS title, CASE WHEN quantity % 3 = 0 THEN price_month_idr + 1000000 ELSE price_month_idr END AS price_month_idr, CASE WHEN quantity % 5 = 0 THEN 'available' ELSE availability END AS availability, build_m2, 333 AS land_m2, furniture_quality, merged_into FROM L WHERE linenumber >= 4"


@query(f"""{WITH_LISTINGS}, E AS ({_OLD}), I AS ({_NEW}), U AS (SELECT coalesce(E.id, I.id) AS id, E.id AS old_id, I.id AS new_id, coalesce(I.title, E.title) AS title, coalesce(I.price_month_idr, E.price_month_idr) AS price_month_idr,
 CASE WHEN E.merged_into IS NOT NULL THEN coalesce(E.availability, I.availability) ELSE coalesce(I.availability, E.availability) END AS availability, coalesce(I.build_m2, E.build_m2) AS build_m2, coalesce(E.land_m2, I.land_m2) AS land_m2, coalesce(E.furniture_quality, I.furniture_quality) AS furniture_quality,
 CAST((I.price_month_idr IS NOT NULL AND I.price_month_idr IS DISTINCT FROM E.price_month_idr) AS INT) AS points, CASE WHEN I.id IS NULL THEN E.last_seen ELSE TIMESTAMP '2001-08-01' END AS last_seen,
 CASE WHEN E.id IS NOT NULL AND I.id IS NOT NULL AND E.merged_into IS NULL AND E.availability IN ('gone', 'unlisted') AND I.availability NOT IN ('gone', 'unlisted') THEN NULL ELSE E.removed_at END AS removed_at,
 E.title AS t0, E.price_month_idr AS p0, E.availability AS a0, E.build_m2 AS b0, E.land_m2 AS l0, E.furniture_quality AS f0 FROM E FULL JOIN I ON E.id = I.id)
SELECT id, price_month_idr, availability, land_m2, points, last_seen, removed_at, CASE WHEN new_id IS NULL THEN 'absent' WHEN old_id IS NULL THEN 'inserted' WHEN (title, price_month_idr, availability, build_m2, land_m2, furniture_quality) IS DISTINCT FROM (t0, p0, a0, b0, l0, f0) THEN 'updated' ELSE 'unchanged' END AS action FROM U""")
def upsert_snapshot(spark, sf_dir):
    rows = listings(spark, sf_dir)
    run = lambda sql: spark.sql(sql.replace("FROM L", "FROM {rows}"), rows=rows)
    old = run(_OLD).withColumn("history", F.array().cast("array<struct<day:date,price:bigint>>"))
    out = U.upsert(old, run(_NEW), "2001-08-01")
    return out.select("id", "price_month_idr", "availability", "land_m2", F.size("history").alias("points"), "last_seen", "removed_at", "action")


@query(f"{WITH_LISTINGS} SELECT id, CASE WHEN source IN ('s1', 's2') AND availability = 'available' AND last_seen < TIMESTAMP '2001-07-29' THEN 'unlisted' ELSE availability END AS availability FROM L")
def unlisted_by_staleness(spark, sf_dir):
    return U.mark_unlisted(listings(spark, sf_dir), ["s1", "s2"], "2001-08-01").select("id", "availability")


@query(f"{WITH_LISTINGS} SELECT source, count(*) AS live FROM L WHERE availability = 'available' AND source NOT IN (SELECT source FROM L WHERE quantity = 50 AND source < 's5') GROUP BY source")
def silent_sources(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return U.silent_sources(rows, rows.filter("quantity = 50 and source < 's5'"))


@query(f"{WITH_LISTINGS} SELECT id, CAST(CAST('0x' || substr(sha1(id), 1, 8) AS BIGINT) % 7 AS INT) AS day FROM L")
def refresh_days(spark, sf_dir):
    return listings(spark, sf_dir).select("id", U.refresh_day(F.col("id")).alias("day"))


@query(f"{WITH_LISTINGS}, G AS (SELECT merged_into, arg_min(land_m2, id) FILTER (WHERE land_m2 IS NOT NULL) AS land_m2, arg_min(view_kind, id) FILTER (WHERE view_kind IS NOT NULL) AS view_kind, arg_min(price_month_idr, id) FILTER (WHERE price_month_idr IS NOT NULL) AS price_month_idr FROM L WHERE merged_into IS NOT NULL GROUP BY merged_into) SELECT K.id, coalesce(K.land_m2, G.land_m2) AS land_m2, coalesce(K.view_kind, G.view_kind) AS view_kind, coalesce(K.price_month_idr, G.price_month_idr) AS price_month_idr FROM L K LEFT JOIN G ON G.merged_into = K.id WHERE K.merged_into IS NULL")
def merged_values(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return U.merge_values(rows.filter("merged_into is null"), rows.filter("merged_into is not null"), ["land_m2", "view_kind", "price_month_idr"])


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.get_json_object("props", "$.k").cast("long") % 50).alias("chat"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("sender"), "ts")


BURSTS = """WITH M AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 50 AS chat, event_id AS ordinal, event_type AS sender, ts FROM events),
S AS (SELECT *, CASE WHEN lag(sender) OVER w IS NULL OR lag(sender) OVER w <> sender OR ts - lag(ts) OVER w > INTERVAL 600 MINUTES THEN 1 ELSE 0 END AS starts FROM M WINDOW w AS (PARTITION BY chat ORDER BY ordinal)),
B AS (SELECT *, sum(starts) OVER (PARTITION BY chat ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS burst FROM S)"""


@query(f"{BURSTS} SELECT chat, CAST(burst AS BIGINT) AS burst, any_value(sender) AS sender, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM B GROUP BY chat, burst")
def session_bursts(spark, sf_dir):
    return Q.bursts(_messages(spark, sf_dir), 600)


@query(f"{WITH_LISTINGS}{WITH_POINTS} SELECT id, CAST(pos AS INT) AS pos, day, price FROM (SELECT *, lag(price) OVER (PARTITION BY id ORDER BY pos) AS before FROM H) WHERE before IS NULL OR before <> price")
def history_changes(spark, sf_dir):
    return Q.changed_only(price_points(listings(spark, sf_dir)))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events")
def sliding_counts(spark, sf_dir):
    return Q.sliding_count(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", 3600).select("event_id", "user_id", "recent")


@query(f"{WITH_LISTINGS}{WITH_POINTS} SELECT id, 'new' AS kind, price_month_idr AS price FROM L WHERE first_seen >= TIMESTAMP '2001-07-01' UNION ALL SELECT id, 'price', price FROM (SELECT *, lag(price) OVER (PARTITION BY id ORDER BY pos) AS before FROM H) WHERE before <> price AND day > DATE '2001-07-01'")
def digest_since(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return Q.digest(rows, price_points(rows), "2001-07-01")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, sf_dir):
    return X.run_to_end(X.windowed_counts(X.read_stream(spark, f"{sf_dir}/events.parquet")), "complete")


@query("SELECT min(event_id) AS event_id, user_id FROM events GROUP BY user_id")
def stream_first_users(spark, sf_dir):
    # rows of a key may arrive in any order: the first that comes isn't the smallest
    rows = X.smallest_of_each(X.read_stream(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id"), "user_id", "event_id")
    return X.run_to_end(rows, "update").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


#: Bursts that the watermark (ten minutes behind the last event) has not passed are still open at the end.
@query(
    """WITH O AS (SELECT user_id, event_type, ts, lag(event_type) OVER w AS before, lag(ts) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  N AS (SELECT *, sum(CASE WHEN before = event_type AND epoch(ts) - epoch(last) <= 600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM O),
  B AS (SELECT user_id AS chat, event_type AS sender, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, burst = max(max(burst)) OVER (PARTITION BY user_id) AS newest FROM N GROUP BY user_id, event_type, burst)
  SELECT chat, sender, n, first_ts, last_ts FROM B WHERE NOT newest OR last_ts + INTERVAL 20 MINUTE < (SELECT max(ts) FROM events)"""
)
def stream_user_bursts(spark, sf_dir):
    rows = X.read_stream(spark, f"{sf_dir}/events.parquet")
    rows = rows.select(F.col("user_id").alias("chat"), F.col("event_type").alias("sender"), "ts", F.unix_micros("ts").alias("ordinal"))
    out = X.run_to_end(X.stream_bursts(rows, 10), "append")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})
