"""Queries of pages' parts over tables of cases, of photos, and of people's activity."""

from pyspark.sql import functions as F

from hearth.operators import aggregates as A
from hearth.plans.cases import by_cases
from hearth.plans.registry import query
from hearth.session import table
from hearth.sources import images, pages

_c = F.col
by_cases("meta_tags", {"html": "string"}, [
    ('<meta property="og:title" content="One"><meta property="og:title" content="Two"><meta name="twitter:card" content="big">', "One", "big"),
    ('<meta name="description" content="x">', None, None),
    ("", None, None),
], ["title", "card"], lambda r: {"id": _c("id"), "title": F.try_element_at(pages.meta_tags(_c("html")), F.lit("og:title")), "card": F.try_element_at(pages.meta_tags(_c("html")), F.lit("twitter:card"))})
by_cases("embedded_states", {"html": "string"}, [
    ('<script id="__NEXT_DATA__" type="application/json">{"props":{"id":7}}</script>', 7, None),
    ('<div data-page="{&quot;a&quot;:3}"></div>', None, 3),
    ('<script id="__NEXT_DATA__">{broken</script>', None, None),
    (None, None, None),
], ["next", "inertia"], lambda r: {"id": _c("id"), "next": F.variant_get(pages.next_data(_c("html")), "$.props.id", "int"), "inertia": F.variant_get(pages.inertia(_c("html")), "$.a", "int")})
by_cases("linked_data", {"html": "string"}, [
    ('<script type="application/ld+json">{"@graph":[{"@type":"House","name":"a"},{"@type":"Person"}]}</script>', 1, '{"@type": "House", "name": "a"}'),
    ("<script type='application/ld+json'>[{\"@type\":[\"House\",\"Offer\"]}, {\"item\":{\"@type\":\"House\"}}]</script>", 2, '{"@type": ["House", "Offer"]}'),
    ('<script type="application/ld+json">{broken</script>', 0, None),
    (None, 0, None),
], ["n", "first"], lambda r: {"id": _c("id"), "n": F.size(pages.json_ld_udf("House")(_c("html"))), "first": F.get(pages.json_ld_udf("House")(_c("html")), F.lit(0))})
by_cases("hydration_literals", {"html": "string"}, [
    ("<script>window.__DATA__ = {price: 5, 'name': 'a b', list: [1, 2,], none: undefined};</script>", '{"price": 5, "name": "a b", "list": [1, 2], "none":null}'),
    ("<script>window.__DATA__ = {a: function() {}}</script>", None),
    ("<script>window.other = {a: 1}</script>", None),
    (None, None),
], ["json"], lambda r: {"id": _c("id"), "json": pages.hydration(_c("html"), "__DATA__")})
by_cases("generic_pages", {"html": "string"}, [
    ('<html><title>T</title><meta property="og:title" content="Villa &amp; pool"><body><p>3 bedrooms</p><p>Land 300 m2</p><p>IDR 40.000.000 / month</p><a href="https://wa.me/6281234567890">x</a></body>', "Villa & pool", 40_000_000, "month", 3, 300, "+6281234567890"),
    ("<title>Plain</title><p>no facts</p>", "Plain", None, None, None, None, None),
    (None, None, None, None, None, None, None),
], ["title", "price", "per", "bedrooms", "land_m2", "whatsapp"], lambda r: {"id": _c("id"), **{n: pages.generic_page(_c("html"))[n] for n in ("title", "price", "per", "bedrooms", "land_m2", "whatsapp")}})
by_cases("index_cards", {"text": "string"}, [
    ("RF9183A Villa. Bedrooms: 3. IDR 40.000.000 / mo", "RF9183A", 40_000_000, "month", 3),
    ("RF9183A and RF9184 Villas IDR 40.000.000 / mo", None, None, None, None),
    ("RF1 IDR 4.000.000 / mo, was IDR 5.000.000", None, None, None, None),
    ("no facts", None, None, None, None),
    (None, None, None, None, None),
], ["ref", "price", "per", "bedrooms"], lambda r: {"id": _c("id"), **{n: pages.index_card(_c("text"))[n] for n in ("ref", "price", "per", "bedrooms")}})


@query("SELECT c_custkey AS id, 'http://x.example/villa/' || c_custkey || '/s' || c_custkey AS url, 's' || c_custkey AS slug, '2025-01-0' || (1 + c_custkey % 9) AS lastmod FROM customer WHERE c_custkey % 3 > 0")
def sitemap_urls(spark, sf_dir):
    """A sitemap of one line a customer; every third has no listing's address, and each stands twice."""
    entry = F.expr("concat('<url><loc>http://x.example/', CASE WHEN c_custkey % 3 > 0 THEN concat('villa/', CAST(c_custkey AS STRING), '/') ELSE 'about/' END, 's', CAST(c_custkey AS STRING), '</loc><lastmod>2025-01-0', CAST(1 + c_custkey % 9 AS STRING), '</lastmod></url>')")
    again = F.regexp_replace(entry, "</loc>", "?again</loc>")
    return pages.sitemap_urls(table(spark, sf_dir, "customer").select(F.concat(entry, again).alias("xml")))


@query("""WITH W AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT e.user_id, floor(avg(e.event_id % 10) * 10 + 0.5) / CAST(10 AS DOUBLE) AS rating, any_value(a.acts) AS acts FROM events e LEFT JOIN (SELECT user_id, string_agg(event_type || '=' || n, ' ' ORDER BY event_type) AS acts FROM W GROUP BY user_id) a ON a.user_id = e.user_id GROUP BY e.user_id""")
def activity_by_person(spark, sf_dir):
    out = A.activity_by_person(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "1900-01-01", "2200-01-01", F.col("event_id") % 10)
    return out.select("user_id", "rating", F.array_join(F.transform("acts", lambda a: F.concat_ws("=", a["event_type"], a["n"].cast("string"))), " ").alias("acts"))


@query("WITH P AS (SELECT vec_id AS id, vec_id % 16 AS h FROM embeddings) SELECT id, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 0 WHEN bit_count(CAST(h AS BIGINT)) <= 6 THEN 1 ELSE 0 END AS n FROM P")
def photos_by_hash(spark, sf_dir):
    """Pairs of two photos: one address that is shared by every third row, and hashes that differ in the bits of id % 16."""
    photo = lambda url, hash: F.struct(url.cast("string").alias("url"), hash.cast("string").alias("hash"))
    no = F.lit(None)
    hashed = F.when(F.col("vec_id") % 5 == 0, F.lit("broken")).otherwise(F.lower(F.hex(F.col("vec_id") % 16)))
    left = F.array(photo(F.lit("u"), no), photo(no, F.lit("0")))
    right = F.array(photo(no, hashed), photo(F.when(F.col("vec_id") % 3 == 0, "u").otherwise("w"), no))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), images.shared_photos(left, right).alias("n"))
