"""Query of the site adapters over the stored pages, and its SQL."""

from pyspark.sql import functions as F

from hearth.plans.registry import query
from hearth.sources.sites import Adapter, register

ADAPTERS = [Adapter("org", ("example.org",)), Adapter("net", ("example.net",)), Adapter("generic")]


@query(
    r"""WITH P AS (SELECT url, html, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, list_distinct(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS links, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) AS title FROM pages)
 SELECT CASE WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 'org' WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'net' ELSE 'generic' END AS source, CASE WHEN html IS NULL THEN NULL WHEN len(links) >= 6 THEN 'list' ELSE 'detail' END AS kind, url, nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), '') AS ref, nullif(title, '') AS title,
  CAST(CASE WHEN coalesce(title, '') = '' THEN 0 WHEN len(links) >= 6 THEN len(links) ELSE len(regexp_extract_all(html, '<meta\s[^>]*content="([^"]*)"', 1)) END AS BIGINT) AS things, coalesce(title, '') = '' AS failed FROM P"""
)
def site_rows(spark, sf_dir):
    register(spark, ADAPTERS)
    rows = spark.read.format("sites").option("path", f"{sf_dir}/pages.parquet").load()
    return rows.select("source", "kind", "url", "ref", "title", F.coalesce(F.size("about"), F.lit(0)).cast("long").alias("things"), F.col("error").isNotNull().alias("failed"))
