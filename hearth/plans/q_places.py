"""Queries of the place rules and their SQL."""

from pyspark.sql import functions as F

from hearth.functions import places as P
from hearth.plans.cases import by_cases
from hearth.plans.registry import query
from hearth.session import table
from hearth.sources.listings import WITH_LISTINGS, listings

TITLES = [
    ("Villa in Pererenan, 5 minutes to Canggu", "pererenan"),
    ("Villa near Goa Gajah, Bedulu", "pejeng"),
    ("10 mins from Ubud", None),
    ("New house Kaba-Kaba, Tabanan", "tanah_lot"),
    ("Tumbak Bayuh family home with Ubud vibes", "pererenan"),
    ("Close to Seseh - Cemagi hills", "cemagi"),
    ("Rumah desa Mas", "lodtunduh"),
    ("Padang-Padang cliff house", "padang_padang"),
    ("A house by the sea", None),
    (None, None),
]
by_cases("areas_of_titles", {"title": "string"}, TITLES, ["area"], lambda r: {"id": F.col("id"), "area": P.area_of_title(F.col("title"))})

POSTS = [
    ("Villa for rent, ten minutes or a bit more to Pererenan", "other"),
    ("Canggu villa, 10 minutes to Pererenan", "canggu"),
    ("Seminyak studio", "other"),
    ("Cepaka house near the market, quiet", "tanah_lot"),
    ("Near the beach of Seseh", "other"),
    ("From the sea you walk a long, long way to a hill and a temple, in Munggu", "munggu"),
    ("", "other"),
    (None, "other"),
]
by_cases("areas_of_posts", {"text": "string"}, POSTS, ["area"], lambda r: {"id": F.col("id"), "area": P.area_of_post(F.col("text"))})

NEAR = [
    ("Villa in Pererenan, 5 min to Canggu", "Villa in Pererenan,  "),
    ("Close to Batu Bolong, quiet", " , quiet"),
    ("Nearby Ubud. A house", " . A house"),
    ("12 minutes drive from Seseh beach", " "),
    ("No such phrase", "No such phrase"),
    (None, None),
]
by_cases("nearness_stripped", {"text": "string"}, NEAR, ["plain"], lambda r: {"id": F.col("id"), "plain": P.without_nearness(F.col("text"))})

SITES = [
    ("Cemagi / Seseh - Beach Side", "Villa", "", "cemagi", "Beach Side", None),
    ("Cemagi/Seseh - Residential", "Villa", "", "seseh", "Residential", None),
    ("Cemagi / Seseh", "Villa in Munggu", "", "munggu", None, None),
    ("Cemagi / Seseh -", "Seseh villa", "", "seseh", None, None),
    ("Bali Pererenan - North", "Buduk house", "", "pererenan", "Buduk", 4),
    ("Pererenan - South", "House", "", "pererenan", "South", None),
    ("Tanah Lot Area - Nyanyi", "House", "", "nyanyi", "Nyanyi", None),
    ("Tanah Lot Area - North side of Tabanan", "Buwit house", "", "buwit", "North side of Tabanan", None),
    ("Tanah Lot Area - Beraban", "Kaba Kaba house", "", "tanah_lot", "Kaba-Kaba", None),
    ("Canggu - Batu Bolong", "House 5 min to Berawa", "", "canggu", "Batu Bolong", None),
    ("Canggu - Padonan", "House", "", "padonan", "Padonan", None),
    ("Canggu", "Berawa house", "", "berawa", None, None),
    ("Ubud", "Villa in Lodtunduh", "", "lodtunduh", None, None),
    ("Ubud - Center", "Villa near Canggu", "", "ubud", "Center", None),
    ("Uluwatu - Bingin", "Villa", "", "bingin", "Bingin", None),
    ("Uluwatu - Pecatu", "Villa", "", "uluwatu", "Pecatu", None),
    ("Other Bali Area - Amed", "Villa in Payangan", "", "payangan", None, None),
    ("Other Bali Area - Amed", "Villa", "", "other", "Amed", None),
    ("", "Villa in Munggu", "villa/seseh", "munggu", None, None),
    ("nowhere", "Villa", "x/ubud", "ubud", None, None),
    ("", "Berawa villa", "other-bali-area", "berawa", None, None),
    (None, None, None, "other", None, None),
]
by_cases(
    "site_areas", {"location": "string", "title": "string", "category": "string"}, SITES, ["area", "sub", "hint"],
    lambda r: {"id": F.col("id"), **{n: P.site_area(F.col("location"), F.col("title"), F.col("category"))[c] for n, c in (("area", "area"), ("sub", "sub_area"), ("hint", "beach_km_hint"))}},
)

SUBS = [
    ("Canggu, Berawa", ["berawa"], None),
    ("Bukit, Uluwatu, Pecatu", ["uluwatu"], "Pecatu"),
    ("Uluwatu / Pecatu -", ["uluwatu", "pecatu"], None),
    ("Seseh, Kec. Mengwi, Bali", ["pererenan"], "Seseh"),
    ("Tanah Lot Area, Beraban | Kediri", ["tanah lot"], "Beraban, Kediri"),
    (None, ["ubud"], None),
]
by_cases("sub_areas", {"location": "string", "labels": "array<string>"}, SUBS, ["sub"], lambda r: {"id": F.col("id"), "sub": P.sub_area(F.col("location"), F.col("labels"))})

DISTRICTS = [("pererenan", ["mengwi"]), ("canggu", ["kuta utara"])]
PORTAL = [
    ("Seseh, Badung", "Canggu villa", None, "seseh"),
    ("Kuta Utara, Badung", "Umalas villa", "canggu", "umalas"),
    ("Kuta Utara, Badung", "Nice villa", "berawa", "berawa"),
    ("Kuta Utara, Badung", "Nice villa", None, "canggu"),
    ("Denpasar", "Nice villa", None, None),
    (None, None, None, None),
]
by_cases("areas_village_first", {"location": "string", "title": "string", "slug_area": "string"}, PORTAL, ["area"], lambda r: {"id": F.col("id"), "area": P.village_first(F.col("location"), F.col("title"), F.col("slug_area"), DISTRICTS)})

ORDERED = [
    ("Villa in Seseh", "Canggu", "ubud", "80351, Mengwi", "seseh", "title"),
    ("Villa 5 min to Canggu", "Berawa", "ubud", None, "berawa", "breadcrumb"),
    ("Villa", None, "ubud", "Canggu", "ubud", "geo"),
    ("Villa", None, None, "Jl. Raya, Canggu", "canggu", "address"),
    ("Villa", None, None, "80351, Mengwi", None, None),
]
by_cases(
    "areas_title_first", {"title": "string", "crumb": "string", "pin": "string", "address": "string"}, ORDERED, ["area", "source"],
    lambda r: {"id": F.col("id"), **{n: P.title_first(F.col("title"), F.col("crumb"), F.col("pin"), F.col("address"))[n] for n in ("area", "source")}},
)
TAGS = [("Mengwi", "Villa in Seseh", "seseh"), ("Mengwi", "Villa", "mengwi"), ("Canggu", "Villa in Seseh", "canggu"), ("Kerobokan", "Villa near Canggu", None), (None, None, None)]
by_cases("areas_tag_first", {"tag": "string", "title": "string"}, TAGS, ["area"], lambda r: {"id": F.col("id"), "area": P.tag_first(F.col("tag"), F.col("title"))})

HINTS = [("pererenan", "in Buduk", 4), ("pererenan", "Tiying Tutul lane", 4), ("canggu", "in Buduk", None), ("pererenan", "by the sea", None), (None, None, None)]
by_cases("beach_hints", {"area": "string", "text": "string"}, HINTS, ["km"], lambda r: {"id": F.col("id"), "km": P.beach_hint(F.col("area"), F.col("text"))})
NAMES = [
    ("5 min to Echo Beach", None, "Echo Beach"),
    ("10 min walk", "The Berawa Beach is near", "Berawa Beach"),
    ("From Batu Bolong Beach on", None, "Batu Bolong Beach"),
    ("the beach", "a beach", None),
    (None, None, None),
]
by_cases("beach_names", {"near": "string", "text": "string"}, NAMES, ["name"], lambda r: {"id": F.col("id"), "name": P.beach_name(F.col("near"), F.col("text"))})

KM = "2 * 6371 * asin(sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))"
CENTROIDS = "SELECT n_name AS area, -8.25 - n_nationkey / CAST(40 AS DOUBLE) AS c_lat, 115.1 + n_nationkey / CAST(40 AS DOUBLE) AS c_lng FROM nation WHERE n_nationkey < 20"
BEACHES = [("north", -8.3, 115.2), ("south", -8.9, 115.6), ("west", -8.5, 115.0)]


def _centroids(spark, sf_dir):
    key = F.col("n_nationkey") / F.lit(40.0)
    return table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_name").alias("area"), (-8.25 - key).alias("c_lat"), (115.1 + key).alias("c_lng"))


@query(f"{WITH_LISTINGS}, C AS ({CENTROIDS}) SELECT id, coalesce({KM.format('c_lat', 'c_lng', 'lat', 'lng')} <= 6, FALSE) AS plausible, coalesce(lat BETWEEN -8.6 AND -8.3 AND lng BETWEEN 115.2 AND 115.6, FALSE) AS boxed FROM L LEFT JOIN C USING (area)")
def pins_plausible(spark, sf_dir):
    rows = P.plausible_pins(listings(spark, sf_dir).select("id", "area", "lat", "lng"), _centroids(spark, sf_dir))
    return rows.select("id", "plausible", P.in_box(F.col("lat"), F.col("lng"), -8.6, -8.3, 115.2, 115.6).alias("boxed"))


_DISTANCES = ", ".join(f"{{'km': {KM.format('lat', 'lng', a, b)} * 1.3, 'name': '{n}'}}" for n, a, b in BEACHES)


@query(
    f"""{WITH_LISTINGS}, C AS ({CENTROIDS}), P AS (SELECT id, CASE WHEN linenumber = 1 THEN c_lat ELSE L.lat END AS lat, CASE WHEN linenumber = 1 THEN c_lng ELSE L.lng END AS lng,
 CASE WHEN linenumber > 1 THEN 'listing_map' WHEN c_lat IS NOT NULL THEN 'centroid' END AS pin_source, beach_km AS stated FROM L LEFT JOIN C USING (area)),
 B AS (SELECT *, CASE WHEN lat IS NOT NULL THEN list_sort([{_DISTANCES}])[1] END AS b FROM P)
 SELECT id, pin_source, coalesce(stated, floor(b.km * 100 + 0.5) / CAST(100 AS DOUBLE)) AS beach_km, CASE WHEN stated IS NULL THEN b.name END AS beach_name, CASE WHEN stated IS NOT NULL THEN 'listing_text' WHEN lat IS NOT NULL THEN 'computed' END AS beach_source FROM B"""
)
def pins_placed(spark, sf_dir):
    rows = listings(spark, sf_dir).select("id", "area", *[F.when(F.col("linenumber") > 1, F.col(c)).alias(c) for c in ("lat", "lng")], "beach_km")
    rows = rows.withColumns({"pin_source": F.lit(None).cast("string"), "beach_name": F.lit(None).cast("string"), "beach_source": F.when(F.col("beach_km").isNotNull(), "listing_text")})
    return P.place_pins(rows, _centroids(spark, sf_dir), BEACHES).select("id", "pin_source", "beach_km", "beach_name", "beach_source")
