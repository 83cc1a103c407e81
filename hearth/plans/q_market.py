"""Market queries and their SQL."""

from pyspark.sql import functions as F

from hearth.functions.semantics import half_up, market_base
from hearth.operators import metrics as M
from hearth.plans.registry import query
from hearth.sources.listings import WITH_LISTINGS, WITH_POINTS, listings, price_points

AREAS = "(" + ", ".join(f"'NATION_{i}'" for i in range(24)) + ")"
BAND = f"bedrooms BETWEEN 1 AND 4 AND price_month_idr BETWEEN 15000000 AND 80000000 AND area IN {AREAS}"
MARKET = f"{WITH_LISTINGS}, R AS (SELECT * FROM L WHERE availability <> 'gone' AND {BAND})"
BASE = f"{WITH_LISTINGS}, B AS (SELECT *, CASE WHEN bedrooms >= 4 THEN '4+' ELSE CAST(bedrooms AS VARCHAR) END AS br, availability IN ('gone', 'unlisted') AS removed FROM L WHERE merged_into IS NULL AND {BAND})"
BOX = "count(price_month_idr) AS n, CAST(quantile_disc(price_month_idr, 0.25) AS BIGINT) AS p25, CAST(quantile_disc(price_month_idr, 0.5) AS BIGINT) AS median, CAST(quantile_disc(price_month_idr, 0.75) AS BIGINT) AS p75"
TREND = "strftime(CAST(first_seen + INTERVAL 8 HOURS AS DATE), '%Y-%m')"
WEEK = "strftime(CAST({0} + INTERVAL 8 HOURS AS DATE), '%G-W%V')"


@query(f"{MARKET} SELECT area, {BOX}, count(*) FILTER (WHERE scope = 'in_filter') AS n_in_filter FROM R GROUP BY area")
def price_box_by_area(spark, sf_dir):
    return M.price_box_by(listings(spark, sf_dir), "area")


@query(f"{MARKET} SELECT bedrooms, {BOX}, count(*) FILTER (WHERE scope = 'in_filter') AS n_in_filter FROM R GROUP BY bedrooms")
def price_box_by_bedrooms(spark, sf_dir):
    return M.price_box_by(listings(spark, sf_dir), "bedrooms")


_FEATURES = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS has, price_month_idr AS p FROM R" for f in M.PREMIUM_FEATURES)


@query(f"{MARKET}, U AS ({_FEATURES}) SELECT feature, CAST(quantile_disc(p, 0.5) FILTER (WHERE has = 1) AS BIGINT) AS median_with, CAST(quantile_disc(p, 0.5) FILTER (WHERE has = 0) AS BIGINT) AS median_without, count(*) FILTER (WHERE has = 1) AS n_with, count(*) FILTER (WHERE has = 0) AS n_without FROM U GROUP BY feature")
def feature_premium(spark, sf_dir):
    return M.feature_premium(listings(spark, sf_dir))


@query(f"{MARKET}, A AS (SELECT area, CAST(quantile_disc(price_month_idr, 0.5) AS BIGINT) AS area_median FROM R GROUP BY area) SELECT id, area, price_month_idr, area_median, floor((price_month_idr - area_median) * 100.0 / area_median * 10 + 0.5) / 10.0 AS delta_pct FROM L LEFT JOIN A USING (area) WHERE status IN ('shortlist', 'contacted', 'viewing_booked', 'viewed', 'offer') AND availability <> 'gone'".replace("* 100.0 /", "* CAST(100 AS DOUBLE) /"))
def shortlist_vs_median(spark, sf_dir):
    return M.shortlist_vs_median(listings(spark, sf_dir))


@query(f"{BASE}, T AS (SELECT {TREND} AS month, * FROM B WHERE br IS NOT NULL) SELECT month, coalesce(area, 'all') AS area, br, {BOX} FROM T WHERE month IN ('2001-03', '2001-04', '2001-05', '2001-06', '2001-07', '2001-08') GROUP BY GROUPING SETS ((month, br, area), (month, br))")
def price_trend(spark, sf_dir):
    return M.price_trend(listings(spark, sf_dir))


@query(f"""{BASE}, E AS (SELECT {WEEK.format('first_seen')} AS week, area, 1 AS n, 0 AS r FROM B UNION ALL SELECT {WEEK.format('coalesce(removed_at, last_seen)')}, area, 0, 1 FROM B WHERE removed),
W AS (SELECT strftime(DATE '2001-08-01' - CAST(7 * i AS INT), '%G-W%V') AS week FROM range(13) t(i)),
C AS (SELECT week, coalesce(area, 'all') AS area, sum(n) AS n, sum(r) AS r FROM E WHERE week IN (SELECT week FROM W) GROUP BY GROUPING SETS ((week, area), (week)))
SELECT week, area, CAST(coalesce(n, 0) AS BIGINT) AS "new", CAST(coalesce(r, 0) AS BIGINT) AS removed, CAST(coalesce(n, 0) - coalesce(r, 0) AS BIGINT) AS net FROM W CROSS JOIN (SELECT DISTINCT area FROM C) A LEFT JOIN C USING (week, area)""")
def supply_flow(spark, sf_dir):
    return M.supply_flow(listings(spark, sf_dir))


@query(f"""{BASE}, D AS (SELECT area, CASE WHEN price_month_idr < 30000000 THEN '<30' WHEN price_month_idr < 40000000 THEN '30-40' WHEN price_month_idr < 50000000 THEN '40-50' ELSE '50+' END AS band, greatest(0, CAST(floor(epoch(last_seen - first_seen) / 86400) AS BIGINT)) AS days FROM B WHERE removed),
G AS (SELECT 'area' AS kind, area AS key, days FROM D UNION ALL SELECT 'price_band', band, days FROM D)
SELECT kind, key, count(*) AS n, CAST(quantile_disc(days, 0.5) AS BIGINT) AS median_days, CAST(quantile_disc(days, 0.25) AS BIGINT) AS p25, CAST(quantile_disc(days, 0.75) AS BIGINT) AS p75 FROM G GROUP BY kind, key""")
def time_on_market(spark, sf_dir):
    return M.time_on_market(listings(spark, sf_dir))


@query(f"{BASE} SELECT count(*) AS n_live, count(*) FILTER (WHERE TIMESTAMP '2001-08-01' - first_seen > INTERVAL 30 DAYS) AS n_live_over, floor(count(*) FILTER (WHERE TIMESTAMP '2001-08-01' - first_seen > INTERVAL 30 DAYS) / count(*) * 1000 + 0.5) / CAST(1000 AS DOUBLE) AS share FROM B WHERE NOT removed")
def stale_share(spark, sf_dir):
    return M.stale_share(listings(spark, sf_dir))


DROPS = f"{BASE}{WITH_POINTS}, P AS (SELECT *, lag(price) OVER (PARTITION BY id ORDER BY pos) AS before FROM H), D AS (SELECT id, area, before, price, floor((before - price) / before * 100 * 10 + 0.5) / CAST(10 AS DOUBLE) AS pct, day FROM P JOIN B USING (id) WHERE before > 0 AND price < before AND day >= DATE '2001-06-01')"


def _drops(spark, sf_dir):
    base = market_base(listings(spark, sf_dir))
    return M.price_drops(base, price_points(base), "2001-06-01")


@query(f"{DROPS} SELECT * FROM D")
def price_drops(spark, sf_dir):
    return _drops(spark, sf_dir)


@query(f"{DROPS} SELECT count(*) AS n, floor(CAST(sum(CAST(pct AS DECIMAL(20,1))) AS DOUBLE) / count(*) * 10 + 0.5) / CAST(10 AS DOUBLE) AS avg_pct FROM D")
def price_drop_summary(spark, sf_dir):
    out = _drops(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(F.col("pct").cast("decimal(20,1)")).alias("s"))
    return out.select("n", half_up(F.try_divide(F.col("s").cast("double"), F.col("n")), 1).alias("avg_pct"))


@query(f"{DROPS} SELECT * FROM D ORDER BY day DESC, pct DESC, id, before DESC LIMIT 20")
def price_drops_latest(spark, sf_dir):
    return _drops(spark, sf_dir).orderBy(F.desc("day"), F.desc("pct"), "id", F.desc("before")).limit(20)


@query(f"""{BASE}, M AS (SELECT *, price_month_idr / CAST(build_m2 AS DOUBLE) AS m2, price_month_idr / CAST(bedrooms AS DOUBLE) AS room FROM B WHERE build_m2 > 20)
SELECT CASE WHEN grouping(area) = 1 THEN 'all' ELSE area END AS area, CASE WHEN grouping(br) = 1 THEN 'all' ELSE br END AS br, count(*) AS n, CAST(floor(quantile_disc(m2, 0.5) + 0.5) AS BIGINT) AS median_per_build_m2, CAST(floor(quantile_disc(room, 0.5) + 0.5) AS BIGINT) AS median_per_bedroom, CAST(quantile_disc(price_month_idr, 0.5) AS BIGINT) AS median_price
FROM M GROUP BY GROUPING SETS ((area), (), (br, area), (br))""")
def per_m2(spark, sf_dir):
    return M.per_m2(listings(spark, sf_dir))


@query(f"""{BASE}, Y AS (SELECT area, price_year_idr / CAST(12 AS DOUBLE) / price_month_idr AS ratio FROM B WHERE term = 'both' AND price_year_idr > 0)
SELECT CASE WHEN grouping(area) = 1 THEN 'all' ELSE area END AS area, count(*) AS n, floor((1 - quantile_disc(ratio, 0.5)) * 100 * 10 + 0.5) / CAST(10 AS DOUBLE) AS median_discount_pct FROM Y WHERE ratio > 0 AND ratio <= 5 GROUP BY GROUPING SETS ((area), ())""")
def yearly_discount(spark, sf_dir):
    return M.yearly_discount(listings(spark, sf_dir))


@query(f"{BASE} SELECT br, CASE WHEN beach_km IS NULL THEN 'unknown' WHEN beach_km < 1 THEN '0-1' WHEN beach_km < 2 THEN '1-2' WHEN beach_km < 4 THEN '2-4' ELSE '4+' END AS band, count(*) AS n, CAST(quantile_disc(price_month_idr, 0.5) AS BIGINT) AS median FROM B WHERE br IS NOT NULL GROUP BY 1, 2")
def beach_premium(spark, sf_dir):
    return M.beach_premium(listings(spark, sf_dir))


_FLAG = "CASE WHEN len(list_filter(e, lambda x: regexp_matches(x.k, '{0}', 'i'))) > 0 THEN len(list_filter(e, lambda x: regexp_matches(x.k, '{0}', 'i') AND regexp_matches(x.v, 'included|yes', 'i') AND NOT regexp_matches(x.v, '\\bnot\\b|\\bno\\b|excluded', 'i'))) > 0 END"


@query(f"""{BASE}, E AS (SELECT price_month_idr AS p, list_transform(json_keys(inclusions), lambda k: {{'k': k, 'v': json_extract_string(inclusions, '$."' || k || '"')}}) AS e FROM B WHERE inclusions IS NOT NULL),
I AS (SELECT 'electricity' AS inclusion, p, {_FLAG.format("electric")} AS has FROM E UNION ALL SELECT 'staff', p, {_FLAG.format("cleaning|housekeeping|staff")} FROM E)
SELECT inclusion, CAST(quantile_disc(p, 0.5) FILTER (WHERE has) AS BIGINT) AS median_with, CAST(quantile_disc(p, 0.5) FILTER (WHERE NOT has) AS BIGINT) AS median_without, count(*) FILTER (WHERE has) AS n_with, count(*) FILTER (WHERE NOT has) AS n_without FROM I GROUP BY inclusion""")
def inclusions_premium(spark, sf_dir):
    return M.inclusions_premium(listings(spark, sf_dir))


@query(f"""{BASE}, S AS (SELECT source, count(*) AS listings, count(*) FILTER (WHERE scope = 'in_filter') AS in_filter, count(*) FILTER (WHERE flagged = 1) AS flagged FROM B GROUP BY source)
SELECT *, floor(in_filter / sum(in_filter) OVER () * 100 * 10 + 0.5) / CAST(10 AS DOUBLE) AS share_in_filter_pct, floor(flagged / sum(flagged) OVER () * 100 * 10 + 0.5) / CAST(10 AS DOUBLE) AS share_flagged_pct FROM S""")
def source_share(spark, sf_dir):
    return M.source_share(listings(spark, sf_dir))


_EDGES = M.budget_edges()
_BANDS = ", ".join(f"count(*) FILTER (WHERE price_month_idr >= {a} AND price_month_idr {'<=' if i == len(_EDGES) - 1 else '<'} {b}) AS band_{n.replace('-', '_')}" for i, (a, b, n) in enumerate(_EDGES))


@query(f"{BASE} SELECT area, {_BANDS}, count(*) AS n FROM B WHERE NOT removed AND bedrooms BETWEEN 1 AND 3 AND price_month_idr BETWEEN {_EDGES[0][0]} AND {_EDGES[-1][1]} GROUP BY area")
def budget_bands(spark, sf_dir):
    return M.budget_bands(listings(spark, sf_dir))


_LEADS = ", ".join(f"count(*) FILTER (WHERE bucket = '{b}') AS {b}" for b in M.LEAD_BUCKETS)


@query(f"""{BASE}, A AS (SELECT area, CASE coalesce(available_from, availability) WHEN 'asap' THEN 'now' WHEN 'available' THEN 'now' WHEN 'from: 2001-08-15' THEN 'within_1m' WHEN '01/10/2001' THEN 'in_1_3m' WHEN '2002-02-01' THEN 'later' ELSE 'unknown' END AS bucket FROM B WHERE NOT removed)
SELECT CASE WHEN grouping(area) = 1 THEN 'all' ELSE area END AS area, {_LEADS}, count(*) AS n FROM A GROUP BY GROUPING SETS ((area), ())""")
def availability_lead(spark, sf_dir):
    return M.availability_lead(listings(spark, sf_dir))


@query(f"{BASE}, N AS (SELECT area, count(*) AS n_live, count(*) FILTER (WHERE regexp_matches(concat_ws(' ', title, description), 'negotiable|nego\\b|bisa nego|harga nego', 'i')) AS n_negotiable FROM B WHERE NOT removed GROUP BY area) SELECT *, floor(n_negotiable / n_live * 100 * 10 + 0.5) / CAST(10 AS DOUBLE) AS share_pct FROM N")
def negotiable_share(spark, sf_dir):
    return M.negotiable_share(listings(spark, sf_dir))


@query(f"{WITH_LISTINGS}, S AS (SELECT unnest(['new', 'shortlist', 'contacted', 'viewing_booked', 'viewed', 'offer', 'rejected', 'gone']) AS status, unnest(range(1, 9)) AS place) SELECT status, count(id) AS n, CAST(place AS INT) AS place FROM S LEFT JOIN L USING (status) GROUP BY status, place")
def pipeline_counts(spark, sf_dir):
    return M.pipeline_counts(listings(spark, sf_dir))


@query(f"{WITH_LISTINGS} SELECT source, count(*) AS listings, count(*) FILTER (WHERE availability = 'gone') AS gone, count(*) FILTER (WHERE scope = 'in_filter') AS in_filter, count(*) FILTER (WHERE flagged = 1) AS flagged, CAST(quantile_disc(price_month_idr, 0.5) FILTER (WHERE availability <> 'gone') AS BIGINT) AS median_price, max(last_seen) AS last_seen FROM L GROUP BY source")
def by_source(spark, sf_dir):
    return M.by_source(listings(spark, sf_dir))


@query(f"{WITH_LISTINGS}, S AS (SELECT unnest(['<30', '30-40', '40-50', '50+']) AS band), P AS (SELECT CASE WHEN price_month_idr < 30000000 THEN '<30' WHEN price_month_idr < 40000000 THEN '30-40' WHEN price_month_idr < 50000000 THEN '40-50' ELSE '50+' END AS band FROM L WHERE price_month_idr IS NOT NULL) SELECT S.band, count(P.band) AS n FROM S LEFT JOIN P USING (band) GROUP BY S.band")
def price_band_counts(spark, sf_dir):
    return M.price_band_counts(listings(spark, sf_dir))
