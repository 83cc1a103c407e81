"""Rules over single texts and rows, applied to texts that are built from the tables' columns."""

from pyspark.sql import functions as F

from hearth.functions import facts as T
from hearth.functions import notes as N
from hearth.functions import posts as P
from hearth.operators import cards as C
from hearth.operators import search as S
from hearth.plans.registry import query
from hearth.session import table
from hearth.sources.listings import WITH_LISTINGS, listings


@query(f"""{WITH_LISTINGS}, P AS (SELECT *, price_month_idr / CAST(build_m2 AS DOUBLE) AS m2 FROM L WHERE price_month_idr IS NOT NULL AND build_m2 > 0), A AS (SELECT area, floor(median(m2) + 0.5) AS area_m2 FROM P WHERE availability NOT IN ('gone', 'unlisted') GROUP BY area),
V AS (SELECT id, CAST(floor((m2 - area_m2) * 100 / area_m2 + 0.5) AS BIGINT) AS pct FROM P LEFT JOIN A USING (area)) SELECT id, pct, CASE WHEN pct < -3 THEN 'under' WHEN pct > 3 THEN 'over' WHEN pct IS NOT NULL THEN 'par' END AS wording FROM V""")
def worded_values(spark, sf_dir):
    return S.value_fields(listings(spark, sf_dir)).select("id", F.col("vs_area_pct").alias("pct"), C.value_wording(F.col("vs_area_pct")).alias("wording"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') >= 2 AS match FROM events GROUP BY 1")
def matched_items(spark, sf_dir):
    said = F.when(F.col("event_type") == "purchase", "yes").when(F.col("event_type") == "view", "maybe").otherwise("no")
    votes = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("item"), "user_id", said.alias("verdict")).distinct()
    return votes.groupBy("item").agg(C.is_match(F.collect_list("verdict")).alias("match"))


@query("SELECT event_id // 2 AS run, bool_or(event_id % 3 = 0 AND (event_id % 7 = 0 OR ts <= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 12 HOURS)) AS stale FROM events GROUP BY 1")
def stale_fetches(spark, sf_dir):
    page = F.struct((F.col("event_id") % 3 == 0).alias("cached"), F.when(F.col("event_id") % 7 > 0, F.col("ts")).alias("at"))
    pages = table(spark, sf_dir, "events").groupBy(F.expr("event_id DIV 2").alias("run")).agg(F.collect_list(page).alias("pages"))
    return pages.select("run", C.served_stale(F.col("pages"), F.expr("TIMESTAMP_NTZ'2024-01-15 12:00:00'")).alias("stale"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN lower(c_mktsegment) || '.' || c_custkey END AS source, CASE c_custkey % 3 WHEN 0 THEN '[src:] ' || c_name WHEN 1 THEN c_name END AS note FROM customer")
def noted_sources(spark, sf_dir):
    note = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('[src:] ', c_name) WHEN 1 THEN concat('[src:', lower(c_mktsegment), '.', c_custkey, ']  ', c_name) ELSE concat('[src:', lower(c_mktsegment), '.', c_custkey, ']') END")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), N.note_source(note).alias("s")).select("id", "s.source", "s.note")


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(strip_accents(concat('¡', p_name, ' Élan – ', p_type, '/Ñandú ', CAST(p_size AS VARCHAR), '!'))), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def title_slugs(spark, sf_dir):
    title = F.concat(F.lit("¡"), "p_name", F.lit(" Élan – "), "p_type", F.lit("/Ñandú "), F.col("p_size").cast("string"), F.lit("!"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), P.slug(title).alias("slug"))


_WORDS = ["monthly", "Annually", "yearly", "weekly"]


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'month' WHEN 1 THEN 'year' WHEN 2 THEN 'year' END AS period, CASE WHEN page_id % 3 > 0 THEN 'rf' || CAST(1000 + page_id AS VARCHAR) END AS ref, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://p.example/img?w=2' END AS picture FROM pages")
def facts_of_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    word = F.get(F.array(*map(F.lit, _WORDS)), (F.col("page_id") % 4).cast("int"))
    rent = F.concat("url", F.lit("/for-rent/villa/"), word, F.lit("/x"))
    offer = F.concat(F.lit("https://a.example/villa-"), F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("RF"), (F.col("page_id") + 1000).cast("string"))).otherwise("view"), F.when(F.col("page_id") % 3 == 1, "/?from=list").otherwise(""))
    wrapped = F.concat(F.lit("https://p.example/img?w=2"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("&url="), F.url_encode("url"))).otherwise(""))
    return pages.select("page_id", N.period_of_url(rent).alias("period"), T.ref_of_url(offer).alias("ref"), T.unwrap_image(wrapped).alias("picture"))


@query(f"{WITH_LISTINGS} SELECT id, CASE WHEN quantity % 5 < 4 THEN lat END AS lat, CASE WHEN quantity % 5 < 4 THEN lng END AS lng FROM L")
def pins_of_links(spark, sf_dir):
    pin = "CASE quantity % 5 WHEN 0 THEN concat('https://maps.example/@', lat, ',', lng, ',17z') WHEN 1 THEN concat('?q=', lat, ',', lng) WHEN 2 THEN concat('x!3d', lat, '!4d', lng) WHEN 3 THEN concat(lat, ' ', lng) ELSE concat('@-98,', lng) END"
    return listings(spark, sf_dir).select("id", T.lat_lng(F.expr(pin)).alias("p")).select("id", "p.lat", "p.lng")


@query(f"{WITH_LISTINGS} SELECT id, coalesce(CASE WHEN linenumber % 2 = 0 THEN quantity % 2 END, pool) AS pool, coalesce(CASE WHEN linenumber % 3 = 0 THEN 'lake' END, view_kind) AS view_kind, coalesce(CASE WHEN linenumber % 5 = 0 THEN 70 END, land_m2) AS land_m2 FROM L")
def stated_facts(spark, sf_dir):
    names = ["pool", "view_kind", "land_m2"]
    stated = {"pool": "CASE WHEN linenumber % 2 = 0 THEN quantity % 2 END", "view_kind": "CASE WHEN linenumber % 3 = 0 THEN 'lake' END", "land_m2": "CASE WHEN linenumber % 5 = 0 THEN 70 END"}
    rows = listings(spark, sf_dir).select("id", *[F.col(n).alias(f"derived_{n}") for n in names], *[F.expr(stated[n]).alias(f"stated_{n}") for n in names])
    return N.stated_over_derived(rows, names)
