"""The listings view over the order tables: one row for each line item, as a rental offer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.session import table

#: Runs unchanged in Spark and in DuckDB; braces are table names.
LISTINGS_SQL = """
SELECT concat_ws('-', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING), CAST(l.l_partkey AS STRING), CAST(l.l_suppkey AS STRING), CAST(CAST(floor(l.l_extendedprice * 100 + 0.5) AS BIGINT) AS STRING), CAST(CAST(l.l_quantity AS INT) AS STRING)) AS id,
  concat('s', CAST(l.l_suppkey % 8 AS STRING)) AS source,
  concat('RF', CAST(l.l_partkey AS STRING), substr('ABCD', CAST(l.l_linenumber % 4 + 1 AS INT), 1)) AS ref,
  l.l_partkey AS part, l.l_suppkey AS supplier,
  concat(p.p_name, CASE WHEN l.l_linenumber % 5 = 0 THEN ' nego' WHEN l.l_linenumber % 5 = 1 THEN ' Price Negotiable' ELSE '' END) AS title,
  CASE WHEN l.l_linenumber % 3 = 0 THEN NULL ELSE concat('A ', p.p_name, ' by ', p.p_brand, ' near the beach, quiet street number ', CAST(p.p_size AS STRING), ' with a garden') END AS description,
  n.n_name AS area, r.r_name AS region, p.p_brand AS sub_area,
  nullif(p.p_size % 6, 0) AS bedrooms, l.l_linenumber % 2 AS extra_rooms,
  CASE WHEN l.l_linenumber % 7 = 0 THEN NULL ELSE CAST(floor(l.l_extendedprice) AS BIGINT) * 1000 END AS price_month_idr,
  CASE WHEN l.l_discount >= 0.05 THEN CAST(floor(l.l_extendedprice * (1 - l.l_discount)) AS BIGINT) * 12000 END AS price_year_idr,
  CASE WHEN l.l_discount >= 0.05 THEN 'both' ELSE 'monthly' END AS term,
  CASE WHEN l.l_linenumber % 4 = 3 THEN 1 ELSE 0 END AS for_sale,
  nullif(p.p_size * 10, 10) AS build_m2, nullif((p.p_size * 37) % 700, 0) AS land_m2,
  CASE WHEN p.p_size % 5 = 0 THEN NULL ELSE l.l_quantity / 8.0 END AS beach_km,
  CAST(-820 - l.l_suppkey % 97 AS DOUBLE) / 100 AS lat, CAST(11500 + l.l_partkey % 89 AS DOUBLE) / 100 AS lng,
  CASE p.p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS pool,
  CASE CAST(l.l_partkey % 4 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 0 END AS garden,
  CASE CAST(l.l_suppkey % 3 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 0 END AS furnished,
  CASE CAST(l.l_orderkey % 3 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 0 END AS aircon,
  CASE CAST(l.l_partkey % 5 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 0 END AS kitchen_full,
  CASE CAST(l.l_orderkey % 5 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 0 END AS workspace,
  CASE CAST(l.l_suppkey % 4 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 0 END AS living_open,
  CASE CAST(l.l_orderkey % 4 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 0 END AS airy,
  CASE WHEN p.p_size % 11 = 0 THEN 1 END AS joglo,
  nullif(p.p_size % 6, 5) AS furniture_quality,
  CASE p.p_size % 7 WHEN 0 THEN 'modern' WHEN 1 THEN 'tropical' WHEN 2 THEN 'joglo' WHEN 3 THEN 'balinese_old' WHEN 4 THEN 'bamboo' END AS style,
  CASE CAST(l.l_partkey % 6 AS INT) WHEN 0 THEN 'ocean' WHEN 1 THEN 'rice' WHEN 2 THEN 'river' WHEN 3 THEN 'jungle' WHEN 4 THEN 'none' END AS view_kind,
  o.o_orderdate AS first_seen, greatest(o.o_orderdate, l.l_shipdate) AS last_seen,
  CASE WHEN l.l_linestatus = 'F' AND l.l_returnflag = 'R' THEN 'gone' WHEN l.l_returnflag = 'A' THEN 'unlisted' ELSE 'available' END AS availability,
  CASE WHEN l.l_linestatus = 'F' AND l.l_returnflag = 'R' AND l.l_linenumber % 2 = 0 THEN greatest(o.o_orderdate, l.l_shipdate) + INTERVAL 1 DAY END AS removed_at,
  CASE WHEN l.l_linestatus = 'F' AND l.l_returnflag = 'R' AND l.l_linenumber % 4 = 0 THEN 'archived' END AS removed_reason,
  CASE CAST(l.l_orderkey % 6 AS INT) WHEN 0 THEN 'asap' WHEN 1 THEN 'from: 2001-08-15' WHEN 2 THEN '01/10/2001' WHEN 3 THEN 'ask the owner' WHEN 4 THEN '2002-02-01' END AS available_from,
  CASE WHEN l.l_quantity >= 25 THEN 'in_filter' ELSE 'market' END AS scope,
  CASE CAST(l.l_orderkey % 8 AS INT) WHEN 0 THEN 'shortlist' WHEN 1 THEN 'contacted' WHEN 2 THEN 'viewed' WHEN 3 THEN 'rejected' WHEN 4 THEN 'gone' ELSE 'new' END AS status,
  CASE WHEN l.l_quantity >= 40 THEN 1 ELSE 0 END AS flagged, CAST(CAST(l.l_quantity AS INT) * 2 AS INT) AS stored_fit,
  CASE p.p_size % 4 WHEN 0 THEN '{{"Electricity":"Included","Cleaning staff":"No"}}' WHEN 1 THEN '{{"Electricity bill":"Not included"}}' WHEN 2 THEN '{{"Housekeeping":"Yes","Internet":"Included"}}' END AS inclusions,
  l.l_linenumber AS linenumber, CAST(l.l_quantity AS INT) AS quantity,
  CASE WHEN l.l_linenumber = 4 AND l.l_quantity < 12 THEN k.first_id END AS merged_into
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {part} p ON p.p_partkey = l.l_partkey
JOIN (SELECT l_partkey AS k_partkey, min(concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS STRING), CAST(CAST(l_quantity AS INT) AS STRING))) AS first_id FROM {lineitem} GROUP BY l_partkey) k ON k.k_partkey = l.l_partkey
JOIN {supplier} s ON s.s_suppkey = l.l_suppkey JOIN {nation} n ON n.n_nationkey = s.s_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey
"""
TABLES = ("lineitem", "orders", "part", "supplier", "nation", "region")
#: WITH clause for the oracle: listings as L.
WITH_LISTINGS = f"WITH L0 AS ({LISTINGS_SQL.format(**{t: t for t in TABLES})}), L AS (SELECT * REPLACE (nullif(merged_into, id) AS merged_into) FROM L0)"


def listings(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The view. dealt: for those who ask for merges, line items are dealt by part once, for first ids and parts alike."""
    tables = {t: table(spark, sf_dir, t) for t in TABLES}
    if dealt:
        sql, tables["lineitem"] = _DEALT, _with_first_ids(spark, tables)
    else:
        # every line's part has a first id, so an outer join gives the same rows, and Spark leaves it out where nobody asks for merges
        sql = LISTINGS_SQL.replace("JOIN (SELECT l_partkey AS k_partkey", "LEFT JOIN (SELECT l_partkey AS k_partkey")
    return spark.sql(sql, **tables).withColumn("merged_into", F.expr("nullif(merged_into, id)"))


_BEFORE, _, _AFTER = LISTINGS_SQL.partition("JOIN (SELECT l_partkey AS k_partkey, ")
_FIRST_ID, _, _AFTER = _AFTER.partition(" AS first_id FROM {lineitem} GROUP BY l_partkey) k ON k.k_partkey = l.l_partkey")
_DEALT = _BEFORE.replace("JOIN {orders} o ON o.o_orderkey = l.l_orderkey ", "").replace("o.o_orderdate", "l.o_orderdate").replace("k.first_id", "l.first_id") + _AFTER + "WHERE l.o_orderkey IS NOT NULL"


def _with_first_ids(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Line items with their order's date (null, if there is none: a first id may be such a line's) and their part's first id."""
    orders = tables["orders"].select("o_orderkey", "o_orderdate")
    rows = tables["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    # dealt before ids are put together: numbers are shuffled, not texts
    return rows.repartition("l_partkey").withColumn("first_id", F.expr(f"{_FIRST_ID} OVER (PARTITION BY l_partkey)"))


def price_points(rows: DataFrame) -> DataFrame:
    """id, pos, day, price: each priced row's history, oldest first."""
    point = lambda days, tenths: F.struct(F.date_add(F.col("first_seen").cast("date"), days).alias("day"), F.expr(f"CAST(price_month_idr * (20 + {tenths}) DIV 20 AS BIGINT)").alias("price"))
    history = F.array(point(0, "quantity % 5"), point(20, "linenumber % 3"), point(45, "0"))
    return rows.filter("price_month_idr is not null").select("id", F.posexplode(history).alias("pos", "h")).select("id", "pos", "h.day", "h.price")


WITH_POINTS = """, H AS (
  SELECT id, 0 AS pos, CAST(first_seen AS DATE) AS day, price_month_idr * (20 + quantity % 5) // 20 AS price FROM L WHERE price_month_idr IS NOT NULL
  UNION ALL SELECT id, 1, CAST(first_seen AS DATE) + 20, price_month_idr * (20 + linenumber % 3) // 20 FROM L WHERE price_month_idr IS NOT NULL
  UNION ALL SELECT id, 2, CAST(first_seen AS DATE) + 45, price_month_idr FROM L WHERE price_month_idr IS NOT NULL)"""
