"""Queries of collecting runs, the inbox and passes that people ask for, and their SQL."""

import uuid

from pyspark.sql import functions as F

from hearth.operators import ingest as I
from hearth.plans.q_dedupe import _NEW, _OLD
from hearth.plans.registry import query
from hearth.session import settle, shared_dir, table
from hearth.sources.listings import WITH_LISTINGS, listings

NOW, BROKEN, SILENT = "2001-08-01", "s3", "s4"
SOURCES = [f"s{i}" for i in range(8)]
_IN = "coalesce(price_month_idr BETWEEN 5000000 AND 90000000, FALSE)"
_OLD_ROWS, _NEW_ROWS = _OLD.replace("SELECT id,", "SELECT id, source,"), _NEW.replace("SELECT id,", "SELECT id, source,")


def _outcome(spark, sf_dir):
    """A run over eight sources: one fails in its tasks, one lists nothing, details add a size."""
    needed = ["id", "source", "title", "price_month_idr", "availability", "build_m2", "land_m2", "furniture_quality", "last_seen", "removed_at", "merged_into", "linenumber", "quantity"]
    rows = settle(listings(spark, sf_dir, dealt=True).select(*needed), "listings")  # once for all sources
    sql = lambda text: spark.sql(text.replace("FROM L", "FROM {rows}"), rows=rows)
    stored = sql(_OLD_ROWS).withColumn("history", F.array().cast("array<struct<day:date,price:bigint>>"))
    cards = sql(_NEW_ROWS)

    def reader(source):
        own = cards.filter(F.col("source") == source)
        if source == BROKEN:
            return lambda: own.withColumn("title", F.when(F.length("id") > 0, F.raise_error(F.lit("blocked")).cast("string")))
        return lambda: own.limit(0) if source == SILENT else own

    details = rows.filter("quantity % 6 = 0").select("id", F.lit(777).alias("build_m2"))
    log = I.RunLog(spark, f"{shared_dir(spark)}/hearth-runs-{uuid.uuid4().hex}")
    return I.run(log, "one", stored, {s: reader(s) for s in SOURCES}, NOW, F.expr(_IN), details=details, detail_columns=("build_m2",)), log


_RUN = f"""{WITH_LISTINGS}, E AS ({_OLD_ROWS}), N AS (SELECT N.*, {_IN} AS inside, quantity AS q FROM ({_NEW_ROWS}) N JOIN (SELECT id, quantity FROM L) USING (id) WHERE source NOT IN ('{BROKEN}', '{SILENT}')),
 I AS (SELECT * REPLACE (CASE WHEN q % 6 = 0 THEN 777 ELSE build_m2 END AS build_m2) FROM N WHERE inside),
 U AS (SELECT coalesce(E.id, I.id) AS id, coalesce(I.source, E.source) AS source, E.id AS old_id, I.id AS new_id, coalesce(I.price_month_idr, E.price_month_idr) AS price_month_idr, coalesce(I.build_m2, E.build_m2) AS build_m2,
  CASE WHEN E.merged_into IS NOT NULL THEN coalesce(E.availability, I.availability) ELSE coalesce(I.availability, E.availability) END AS availability, CASE WHEN I.id IS NULL THEN E.last_seen ELSE TIMESTAMP '{NOW}' END AS last_seen,
  (coalesce(I.title, E.title), coalesce(I.price_month_idr, E.price_month_idr), CASE WHEN E.merged_into IS NOT NULL THEN coalesce(E.availability, I.availability) ELSE coalesce(I.availability, E.availability) END, coalesce(I.build_m2, E.build_m2), coalesce(E.land_m2, I.land_m2), coalesce(E.furniture_quality, I.furniture_quality)) IS DISTINCT FROM (E.title, E.price_month_idr, E.availability, E.build_m2, E.land_m2, E.furniture_quality) AS changed
  FROM E FULL JOIN I ON E.id = I.id)"""


@query(
    f"""{_RUN}, A AS (SELECT source, count(*) AS seen, count(*) FILTER (WHERE NOT inside) AS skipped FROM N GROUP BY source),
 B AS (SELECT source, count(*) FILTER (WHERE old_id IS NULL) AS new, count(*) FILTER (WHERE old_id IS NOT NULL AND changed) AS updated, count(*) FILTER (WHERE old_id IS NOT NULL AND NOT changed) AS unchanged FROM U WHERE new_id IS NOT NULL GROUP BY source)
 SELECT S.source, CAST(coalesce(seen, 0) AS BIGINT) AS seen, CAST(coalesce(new, 0) AS BIGINT) AS new, CAST(coalesce(updated, 0) AS BIGINT) AS updated, CAST(coalesce(unchanged, 0) AS BIGINT) AS unchanged, CAST(coalesce(skipped, 0) AS BIGINT) AS skipped,
  S.source IN ('{BROKEN}', '{SILENT}') AS failed FROM (SELECT 's' || unnest(range(8)) AS source) S LEFT JOIN A USING (source) LEFT JOIN B USING (source)"""
)
def ingest_run(spark, sf_dir):
    """What a run counted, by source."""
    return _outcome(spark, sf_dir)[0].table().select("source", "seen", "new", "updated", "unchanged", "skipped", F.col("error").isNotNull().alias("failed"))


@query(
    f"""{_RUN} SELECT id, source, price_month_idr, build_m2, last_seen, CASE WHEN source NOT IN ('{BROKEN}', '{SILENT}') AND availability = 'available' AND last_seen < TIMESTAMP '2001-07-29' THEN 'unlisted' ELSE availability END AS availability FROM U"""
)
def ingest_rows(spark, sf_dir):
    """The stored rows after the run: those of sources that failed are as they were."""
    return _outcome(spark, sf_dir)[0].rows.select("id", "source", "price_month_idr", "build_m2", "last_seen", "availability")


_TITLE = r"nullif(trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)), '')"


@query(
    rf"""WITH P AS (SELECT url, max(html) AS html FROM pages WHERE page_id % 4 > 0 GROUP BY url), R AS (SELECT page_id AS id, url, CASE WHEN page_id % 2 = 0 THEN 'from a friend' ELSE '' END AS note FROM pages WHERE page_id % 5 > 0),
 D AS (SELECT id, R.url, note, {_TITLE} AS title, CASE WHEN regexp_matches(R.url, '^https?://([^/]*\.)?example\.org') THEN 'one' ELSE 'generic' END AS adapter FROM R LEFT JOIN P ON P.url = R.url)
 SELECT id, url, adapter, CASE WHEN title IS NULL THEN 'failed' ELSE 'done' END AS status, concat_ws(' | ', nullif(note, ''), CASE WHEN title IS NULL THEN 'no listing data' ELSE 'read by ' || adapter END) AS note, title FROM D"""
)
def inbox_results(spark, sf_dir):
    """Addresses of four in five pages are pending, of a quarter there is no page."""
    pages = table(spark, sf_dir, "pages")
    pending = pages.select(F.col("page_id").alias("id"), "url", F.when(F.col("page_id") % 2 == 0, "from a friend").otherwise("").alias("note"), F.when(F.col("page_id") % 5 > 0, "pending").otherwise("done").alias("status"))
    title = lambda html: F.nullif(F.trim(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    found = I.inbox(pending, pages.filter("page_id % 4 > 0"), {"example.org": "one"}, title)
    return found.withColumnRenamed("d", "title")


@query(f"{WITH_LISTINGS} SELECT a, b FROM (SELECT DISTINCT CASE WHEN quantity % 2 = 0 THEN id ELSE merged_into END AS a, CASE WHEN quantity % 2 = 0 THEN merged_into ELSE id END AS b, quantity FROM L WHERE merged_into IS NOT NULL) WHERE quantity % 3 > 0")
def dismissals_left(spark, sf_dir):
    """Dismissed pairs, of which a pass has merged a third."""
    rows = listings(spark, sf_dir).filter("merged_into is not null")
    even = F.col("quantity") % 2 == 0
    pairs = rows.select(F.when(even, F.col("id")).otherwise(F.col("merged_into")).alias("a"), F.when(even, F.col("merged_into")).otherwise(F.col("id")).alias("b"), "quantity")
    merged = rows.filter("quantity % 3 = 0").select(F.col("merged_into").alias("keep"), F.col("id").alias("gone"))
    return I.without_merged(pairs, merged).select("a", "b")
