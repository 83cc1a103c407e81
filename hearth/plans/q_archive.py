"""Queries of archives and channels: known ids, digests under a size, requests about channels, last reads, saved filters, shared rows."""

from pyspark.sql import functions as F

from hearth.operators import cards as C
from hearth.operators import digests as G
from hearth.operators import intake as I
from hearth.operators import known as K
from hearth.plans.q_more import _DISTANCES, PLACES
from hearth.plans.registry import query
from hearth.session import settle, table
from hearth.sources.listings import WITH_LISTINGS, listings

_GROUP, _ID = "CAST(l_suppkey % 8 AS STRING)", "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))"


@query(f"""WITH P AS (SELECT {_GROUP} AS "group", {_ID} AS id, l_partkey AS part, l_shipdate AS at FROM lineitem)
SELECT b."group", b.id, b.part FROM P b WHERE b.at >= TIMESTAMP '1998-06-01' AND NOT EXISTS (SELECT 1 FROM P a WHERE a.at < TIMESTAMP '1999-06-01' AND a."group" = b."group" AND a.id = b.id)""")
def ids_not_archived(spark, sf_dir):
    posts = table(spark, sf_dir, "lineitem").selectExpr(f"{_GROUP} AS `group`", f"{_ID} AS id", "l_partkey AS part", "l_shipdate AS at")
    archive = posts.filter("at < TIMESTAMP_NTZ'1999-06-01'")
    # two runs' filters, of one size, merged: what a collecting run keeps between its nights
    room = settle(K.sizes(archive), "rooms")
    early, late = (K.bloom(archive.filter(when), room) for when in ("at < TIMESTAMP_NTZ'1997-01-01'", "at >= TIMESTAMP_NTZ'1997-01-01'"))
    return K.unknown(posts.filter("at >= TIMESTAMP_NTZ'1998-06-01'"), archive, settle(K.merged(early, late), "filter")).select("group", "id", "part")


@query("""SELECT DISTINCT CASE WHEN o_custkey % 4 = 0 THEN 'in' || CAST(o_custkey % 5 AS VARCHAR) ELSE 'g' || CAST(o_custkey % 7 AS VARCHAR) END AS "group", CAST(o_orderkey // 2 AS VARCHAR) AS id FROM orders WHERE o_orderkey % 6 > 0 AND NOT (o_custkey % 4 = 0 AND o_custkey % 3 = 0)""")
def ids_archived(spark, sf_dir):
    posts = table(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_custkey % 4 = 0 THEN concat('/a/posts-final-', o_orderkey, '.json') ELSE concat('/a/posts-g', o_custkey % 7, '-', o_orderkey, '.json') END AS file",
        "CASE WHEN o_custkey % 3 > 0 THEN concat('in', o_custkey % 5) END AS group_id", "CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey DIV 2 END AS post_id",
    )
    return K.archived_ids(posts)


BUDGET, _LISTS = 6_000, {"new": "view", "flagged": "click", "changes": "signup", "feedback": "error", "viewings": "purchase"}
_ROW = {"new": ("id", "title", "reasons"), "flagged": ("id", "title", "reasons"), "changes": ("id", "title"), "feedback": ("id", "title", "text"), "viewings": ("id", "title", "notes")}
_pack = lambda fields: "struct_pack(" + ", ".join(f'"{n}" := {x}' for n, x in fields.items()) + ")"
_cut = lambda x, n: f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '…' ELSE {x} END"
_each = lambda name, **change: f'list_transform(p."{name}", lambda x: {_pack({f: change.get(f, f"x.{f}") for f in _ROW[name]})})'


def _stage(number: int, before: str, **change: str) -> str:
    lists = _pack({n: change.get(n, f'p."{n}"') for n in _LISTS})
    return f"P{number} AS (SELECT user_id, p, CASE WHEN bytes >= {BUDGET} THEN {number} ELSE stages END AS stages, strlen(to_json(p)) AS bytes FROM (SELECT user_id, stages, bytes, CASE WHEN bytes >= {BUDGET} THEN {lists} ELSE p END AS p FROM {before}))"


def _drop(name: str) -> str:
    sizes = f'list_transform(list_reverse(p."{name}"), lambda x: strlen(to_json(x)) + 1)'
    drops = f"len(list_filter(range(0, greatest(0, len(p.\"{name}\") - 5)), lambda i: bytes - coalesce(list_sum(({sizes})[1:i]), 0) >= {BUDGET}))"
    return f'p."{name}"[1:len(p."{name}") - {drops}]'


_TITLE, _TEXT = "repeat(concat(event_type, ' ', props, ' – '), CAST(1 + user_id % 12 AS INT))", "repeat(concat(props, '. '), CAST(user_id % 5 * 10 AS INT))"
_STAGES = [
    _stage(1, "P0", **{n: _each(n, title=_cut("x.title", 60), reasons="x.reasons[1:4]") for n in ("new", "flagged")}),
    _stage(2, "P1", changes=_each("changes", title=_cut("x.title", 40)), feedback=_each("feedback", title=_cut("x.title", 40), text=_cut("x.text", 200)), viewings=_each("viewings", title=_cut("x.title", 40), notes=_cut("x.notes", 200))),
    _stage(3, "P2", new=_drop("new")),
    _stage(4, "P3", flagged=_drop("flagged")),
]


@query(f"""WITH E AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS r, event_id AS id, {_TITLE} AS title, {_TEXT} AS text, text AS notes, list_transform(range(1, 7), lambda i: 'reason ' || CAST(i * event_id AS VARCHAR)) AS reasons FROM events),
P0 AS (SELECT user_id, p, 0 AS stages, strlen(to_json(p)) AS bytes FROM (SELECT user_id, {_pack({n: f"coalesce(list({_pack({f: f for f in _ROW[n]})} ORDER BY r) FILTER (WHERE event_type = '{kind}'), [])" for n, kind in _LISTS.items()})} AS p FROM E WHERE r <= 40 GROUP BY user_id)), {", ".join(_STAGES)}
SELECT user_id, CAST(stages AS INT) AS stages, CAST(bytes AS INT) AS bytes, CAST(len(p."new") AS INT) AS n_new, CAST(len(p.flagged) AS INT) AS n_flagged, md5(CAST(to_json(p) AS VARCHAR)) AS digest FROM P4""")
def digests_in_budget(spark, sf_dir):
    from pyspark.sql import Window

    # the newest 40 of each list, as a digest shows them
    newest = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("r", newest).filter("r <= 40")
    reasons = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("reason "), (i * F.col("event_id")).cast("string")))
    rows = rows.withColumns({"id": F.col("event_id"), "title": F.expr(_TITLE), "text": F.expr(_TEXT), "notes": F.expr(_TEXT), "reasons": reasons})
    listed = lambda name, kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.struct("r", *_ROW[name])))), lambda x: F.struct(*[x[f].alias(f) for f in _ROW[name]])).alias(name)
    payloads = rows.groupBy("user_id").agg(F.struct(*[listed(n, kind) for n, kind in _LISTS.items()]).alias("p"))
    out = G.within_budget(payloads, "p", G.digest_stages(BUDGET), BUDGET)
    return out.select("user_id", "stages", "bytes", F.size("p.new").alias("n_new"), F.size("p.flagged").alias("n_flagged"), F.md5(F.to_json("p", {"ignoreNullFields": "false"})).alias("digest"))


ADAPTERS = ["s1", "s12", "s21"]
_KIND = f"CASE WHEN k % 3 > 0 THEN element_at(array({', '.join(repr(x) for x in [*I.KINDS, 'bogus'])}), CAST(k % 8 + 1 AS INT)) END"
_SAID = {"id": "CASE WHEN k % 9 < 8 THEN concat('S', CAST(k AS STRING)) END", "kind": _KIND, "name": "CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat(c_name, ' ') END", "url": "CASE WHEN k % 5 = 1 THEN concat('http://x/', CAST(k AS STRING)) END"}


def _requests(spark, sf_dir):
    kinds = F.array(*map(F.lit, I.KINDS))
    stored = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.get(kinds, (F.col("s_suppkey") % 7).cast("int")).alias("kind"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "u").alias("url"), F.lit(True).alias("enabled"),
        F.lit("n").alias("notes"), F.lit(None).cast("string").alias("contact_id"), F.lit(False).alias("archived"), F.lit("system").alias("created_by"), F.expr("TIMESTAMP_NTZ'2001-01-01'").alias("created_at"), F.expr("TIMESTAMP_NTZ'2001-01-01'").alias("updated_at"),
    )
    said = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey")).select("k", *[F.expr(x).alias(n) for n, x in _SAID.items()], F.expr("CASE WHEN k % 2 = 0 THEN false END").alias("enabled"))
    # a null field is left out of the text, but an address may be said to be null
    text = F.to_json(F.struct(*_SAID, "enabled"))
    text = F.when(F.col("k") % 5 == 0, F.concat(F.substring(text, F.lit(1), F.char_length(text) - 1), F.when(text == "{}", "").otherwise(","), F.lit('"url":null}'))).otherwise(text)
    asked = said.select(F.col("k").alias("place"), text.alias("input"), F.lit("anna").alias("by"), F.expr("TIMESTAMP_NTZ'2001-08-01'").alias("at"))
    return I.upsert_sources(stored, asked, ADAPTERS)


_LIST = "[" + ", ".join(repr(x) for x in I.KINDS) + "]"
_ASKED = f"""WITH S AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id, {_LIST}[s_suppkey % 7 + 1] AS kind, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'u' END AS url FROM supplier),
C AS (SELECT c_custkey AS place, k % 9 < 8 AS given, CASE WHEN k % 9 < 8 THEN 's' || CAST(k AS VARCHAR) WHEN k % 4 IN (2, 3) THEN replace(lower(c_name), '#', '-') END AS id, CASE WHEN k % 3 > 0 THEN ({_LIST[:-1]}, 'bogus'])[k % 8 + 1] END AS kind, CASE WHEN k % 4 IN (2, 3) THEN c_name END AS name,
 k % 5 = 0 OR k % 5 = 1 AS has_url, CASE WHEN k % 5 = 1 THEN 'http://x/' || CAST(k AS VARCHAR) END AS url, k % 2 = 0 AS off FROM (SELECT *, c_custkey AS k FROM customer)),
R AS (SELECT C.*, S.id IS NOT NULL AS known, S.kind AS old_kind, CASE WHEN given AND S.id IS NOT NULL THEN CASE WHEN C.kind <> S.kind AND C.kind = 'bogus' THEN 'unknown kind' WHEN C.kind <> S.kind AND 'scraper' IN (C.kind, S.kind) THEN 'keeps its kind' END
 ELSE CASE WHEN C.name IS NULL THEN 'no name' WHEN C.kind IS NULL OR C.kind = 'bogus' THEN 'unknown kind' WHEN C.id IS NULL THEN 'no letter or digit in the name' WHEN S.id IS NOT NULL THEN 'is there already' WHEN C.kind = 'scraper' AND C.id NOT IN ({', '.join(map(repr, ADAPTERS))}) THEN 'no adapter' END END AS refusal FROM C LEFT JOIN S ON S.id = C.id)"""


@query(f"{_ASKED} SELECT place, id, CASE WHEN refusal IS NULL THEN CASE WHEN known THEN 'updated' ELSE 'created' END END AS action, refusal FROM R")
def source_requests(spark, sf_dir):
    return _requests(spark, sf_dir)[1]


@query(f"""{_ASKED}, F AS (SELECT * FROM R WHERE refusal IS NULL)
SELECT coalesce(S.id, F.id) AS id, coalesce(F.kind, S.kind) AS kind, coalesce(F.name, S.name) AS name, CASE WHEN F.id IS NULL OR (S.id IS NOT NULL AND NOT has_url) THEN S.url ELSE F.url END AS url, NOT coalesce(off, FALSE) AS enabled, CASE WHEN S.id IS NOT NULL THEN 'n' END AS notes,
 CASE WHEN S.id IS NOT NULL THEN 'system' ELSE 'anna' END AS created_by, CASE WHEN F.id IS NULL THEN TIMESTAMP '2001-01-01' ELSE TIMESTAMP '2001-08-01' END AS updated_at FROM S FULL JOIN F ON S.id = F.id""")
def sources_after_requests(spark, sf_dir):
    return _requests(spark, sf_dir)[0].select("id", "kind", "name", "url", "enabled", "notes", "created_by", "updated_at")


@query("""SELECT s_nationkey AS owner, 'g' || CAST(s_suppkey % 30 AS VARCHAR) AS key, CAST(DATE '2001-07-01' + CAST(max(s_suppkey) % 28 AS INT) AS VARCHAR) AS day FROM supplier WHERE s_nationkey % 3 = 0 OR (s_nationkey % 3 = 1 AND s_suppkey % 5 > 0) GROUP BY 1, 2""")
def last_done_days(spark, sf_dir):
    # of a group's entries the one with the largest key comes last in the list, and is the only one in the map
    rows = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS owner", "s_suppkey AS k", "concat('g', s_suppkey % 30) AS id", "CASE WHEN s_nationkey % 3 <> 1 OR s_suppkey % 5 > 0 THEN CAST(date_add(DATE'2001-07-01', int(s_suppkey % 28)) AS STRING) ELSE '' END AS last_done")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "id", "last_done"))), lambda x: F.struct(x["id"].alias("id"), x["last_done"].alias("last_done"))).alias("groups")
    once = rows.groupBy("owner", "id").agg(F.max_by("last_done", "k").alias("last_done")).groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("id", "last_done"))).alias("last_done"))
    both = rows.groupBy("owner").agg(listed).join(once, "owner")
    mapped, groups = F.to_json(F.struct("last_done")), F.to_json(F.struct("groups"))
    return I.last_done(both.select("owner", F.when(F.col("owner") % 3 == 0, mapped).when(F.col("owner") % 3 == 1, groups).otherwise("[]").alias("state")))


_SAVED = {
    "status": "CASE WHEN event_id % 3 = 0 THEN array('new') WHEN event_id % 3 = 1 THEN slice(array('x'), 1, 0) END", "area": "CASE WHEN event_id % 5 = 0 THEN array(props) END", "bedrooms": "CASE WHEN event_id % 7 = 0 THEN array(2, 3) END", "features": "CAST(NULL AS ARRAY<STRING>)", "style": "CASE WHEN event_id % 11 = 0 THEN array('modern') END",
    "min": "nullif(event_id % 4, 0)", "max": "nullif(event_id % 6, 1)", "land_min": "CAST(NULL AS INT)", "land_max": "nullif(event_id % 9, 2)", "build_min": "nullif(event_id % 10, 3)", "build_max": "CAST(NULL AS INT)", "anchor": "nullif(event_id % 13, 0)", "anchor_km": "nullif(event_id % 2, 0)", "beach": "nullif(event_id % 8, 5)", "max_age_days": "nullif(event_id % 12, 7)",
    "furnished": "CASE event_id % 4 WHEN 0 THEN 'any' WHEN 1 THEN 'yes' WHEN 2 THEN '' END", "term": "CASE event_id % 3 WHEN 0 THEN array('monthly', 'yearly', 'sale') WHEN 1 THEN array('sale') END", "removed": "CASE event_id % 5 WHEN 0 THEN 'show' WHEN 1 THEN 'hide' WHEN 2 THEN '' END",
    "assessed": "CASE event_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN '' END", "source": "nullif(event_type, 'view')", "q": "CASE WHEN event_id % 2 = 0 THEN props ELSE '' END", "verdict": "CAST(NULL AS STRING)", "my_verdict": "CASE WHEN event_id % 17 = 0 THEN 'yes' END",
}
_ON = "e % 3 = 0;e % 5 = 0;e % 7 = 0;e % 11 = 0;e % 4 <> 0 OR e % 6 <> 1;e % 9 <> 2;e % 10 <> 3;e % 13 <> 0 AND e % 2 <> 0;e % 8 <> 5;e % 12 <> 7;e % 4 = 1;e % 3 = 1;e % 5 = 0;e % 3 = 0;event_type <> 'view';e % 2 = 0;e % 17 = 0".split(";")


@query(f"SELECT event_id, CAST({' + '.join(f'CAST({x} AS INT)' for x in map('({})'.format, _ON))} AS INT) AS active FROM (SELECT *, event_id AS e FROM events)")
def active_filter_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", I.active_filters(F.struct(*[F.expr(x).alias(n) for n, x in _SAVED.items()])).alias("active"))


@query(f"""{WITH_LISTINGS}, P AS (SELECT *, price_month_idr / CAST(build_m2 AS DOUBLE) AS m2 FROM L WHERE price_month_idr IS NOT NULL AND build_m2 > 0), A AS (SELECT area, floor(median(m2) + 0.5) AS area_m2 FROM P WHERE availability NOT IN ('gone', 'unlisted') GROUP BY area),
V AS (SELECT part, string_agg(voter || '=' || verdict, ' ' ORDER BY voter, verdict) AS verdicts FROM (SELECT DISTINCT user_id AS voter, event_type AS verdict, CAST(json_extract_string(props, '$.k') AS BIGINT) AS part FROM events WHERE user_id % 2 = 0) GROUP BY part)
SELECT L.id, coalesce(V.verdicts, '') AS verdicts, n_name AS status_by_name, CAST(floor(P.m2 + 0.5) AS BIGINT) AS price_per_m2, CAST(floor((P.m2 - area_m2) * 100 / area_m2 + 0.5) AS BIGINT) AS vs_area_pct, round({_DISTANCES[0][1].replace("lat", "L.lat").replace("lng", "L.lng")}, 2) AS km
FROM L LEFT JOIN P ON P.id = L.id LEFT JOIN A ON A.area = P.area LEFT JOIN V ON V.part = L.part LEFT JOIN nation ON n_nationkey = L.quantity WHERE L.flagged = 1""")
def shared_rows(spark, sf_dir):
    market = listings(spark, sf_dir)
    said = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("part"), F.col("user_id").alias("voter"), F.col("event_type").alias("verdict")).distinct()
    rows = market.filter("flagged = 1").withColumn("status_by", F.col("quantity"))
    verdicts = rows.select(F.col("id").alias("item"), "part").join(said, "part").select("item", "voter", "verdict")
    people = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    out = C.with_shared(rows, market, verdicts, said.select("voter").filter("voter % 2 = 0").distinct(), people, PLACES)
    spoken = F.array_join(F.transform("verdicts", lambda v: F.concat_ws("=", v["voter"].cast("string"), v["verdict"])), " ")
    return out.select("id", spoken.alias("verdicts"), "status_by_name", "price_per_m2", "vs_area_pct", F.get("anchors", F.lit(0))["km"].alias("km"))
