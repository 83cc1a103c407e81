"""Channels that offers come through: what a request to add or change one does, and when each was last read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions.posts import slug

# Kinds of channels.
KINDS = ["scraper", "facebook_group", "whatsapp_group", "instagram", "agent", "website", "other"]
ENTRY = "kind string, name string, url string, enabled boolean, notes string, contact_id string, archived boolean, created_by string, created_at timestamp_ntz, updated_at timestamp_ntz"


def _request() -> Column:
    """What a request says: its fields, and which of them it has at all (a field that is null is said to be null)."""
    said = lambda name: F.get_json_object("input", f"$.{name}")
    fields = [said(n).alias(n) for n in ("kind", "url", "notes", "contact_id", "enabled", "archived")]
    return F.struct("place", "by", "at", F.trim(said("name")).alias("name"), F.coalesce(F.json_object_keys("input"), F.array().cast("array<string>")).alias("has"), F.col("given").isNotNull().alias("given"), *fields)


def upsert_sources(stored: DataFrame, asked: DataFrame, adapters: list[str]) -> tuple[DataFrame, DataFrame]:
    """The channels after all requests, and place, id, action (created, updated or null), refusal for each request.

    stored: id and the columns of ENTRY. asked: place, input (a JSON object), by, at. Requests of one channel are applied in
    the order of place, each to what the one before left; channels don't wait for each other. A request without an id makes
    a new channel named after its name, and is refused if there is one. A channel of the kind scraper has to be one of the
    adapters and keeps its kind. A request changes the fields it has, and none if it is refused.
    """
    given = F.nullif(F.get_json_object("input", "$.id"), F.lit(""))
    named = asked.withColumn("given", F.coalesce(F.nullif(slug(given), F.lit("")), given))
    named = named.withColumn("id", F.coalesce("given", F.nullif(slug(F.get_json_object("input", "$.name")), F.lit(""))))
    fields = [f.split()[0] for f in ENTRY.split(", ")]
    # requests without any id are of no channel, and none leaves anything to another: each one is by itself
    alone = F.when(F.col("id").isNull(), F.col("place"))
    requests = named.select("id", alone.alias("alone"), _request().alias("r")).groupBy("id", "alone").agg(F.array_sort(F.collect_list("r")).alias("requests")).drop("alone")
    both = stored.select("id", F.struct(*fields).cast(f"struct<{ENTRY.replace(' ', ':')}>".replace(",:", ",")).alias("entry")).join(requests, "id", "full")

    def step(state: Column, r: Column) -> Column:
        old, has = state["entry"], lambda n: F.array_contains(r["has"], n)
        change = r["given"] & old.isNotNull()
        pick = lambda n: F.when(has(n), r[n]).otherwise(old[n])
        scraper = F.lit("scraper")
        other_kind = has("kind") & ~r["kind"].eqNullSafe(old["kind"])
        known = F.coalesce(r["kind"].isin(*KINDS), F.lit(False))
        refusal = F.when(
            change,
            F.when(other_kind & ~known, "unknown kind").when(other_kind & ((old["kind"] == scraper) | (r["kind"] == scraper)), "keeps its kind"),
        ).otherwise(
            F.when(F.coalesce(r["name"], F.lit("")) == "", "no name").when(~known, "unknown kind").when(F.col("id").isNull(), "no letter or digit in the name")
            .when(old.isNotNull(), "is there already").when((r["kind"] == scraper) & ~F.col("id").isin(*adapters), "no adapter")
        )
        flag = lambda n, when: F.coalesce(r[n] == when, F.lit(False))
        made = {"kind": r["kind"], "name": r["name"], "url": r["url"], "enabled": ~flag("enabled", "false"), "notes": r["notes"], "contact_id": r["contact_id"], "archived": flag("archived", "true"), "created_by": r["by"], "created_at": r["at"], "updated_at": r["at"]}
        changed = {
            "kind": F.coalesce(r["kind"], old["kind"]), "name": F.coalesce(F.nullif(r["name"], F.lit("")), old["name"]), "url": pick("url"), "notes": pick("notes"), "contact_id": pick("contact_id"),
            "enabled": F.when(has("enabled"), ~flag("enabled", "false")).otherwise(old["enabled"]), "archived": F.when(has("archived"), flag("archived", "true")).otherwise(old["archived"]),
            "created_by": old["created_by"], "created_at": old["created_at"], "updated_at": r["at"],
        }
        new = F.struct(*[F.when(change, changed[n]).otherwise(made[n]).alias(n) for n in fields])
        action = F.when(refusal.isNull(), F.when(change, "updated").otherwise("created"))
        told = F.array(F.struct(r["place"].alias("place"), action.alias("action"), refusal.alias("refusal")))
        return F.struct(F.when(refusal.isNull(), new).otherwise(old).alias("entry"), F.concat(state["told"], told).alias("told"))

    none = F.array().cast("array<struct<place:bigint,action:string,refusal:string>>")
    folded = F.aggregate(F.coalesce("requests", F.array().cast(requests.schema["requests"].dataType)), F.struct("entry", none.alias("told")), step)
    done = both.select("id", folded.alias("s"))
    return done.filter("s.entry is not null").select("id", "s.entry.*"), done.select("id", F.explode("s.told").alias("t")).select("t.place", "id", "t.action", "t.refusal")


def last_done(states: DataFrame) -> DataFrame:
    """state (a JSON text) -> owner, key, day: when each group was last read.

    Either shape is read: {"last_done": {group: day}} or {"groups": [{"id": group, "last_done": day}]}; the first one wins
    where a state has both, and the last entry of a group. A state that is neither, or null, has no groups.
    """
    read = states.select("owner", F.from_json("state", "last_done map<string,string>, groups array<struct<id:string,last_done:string>>").alias("s"))
    own = F.transform(F.map_entries("s.last_done"), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("last_done")))
    listed = F.filter("s.groups", lambda g: (g["id"] != "") & (g["last_done"] != ""))
    each = read.select("owner", F.posexplode(F.coalesce(own, listed)).alias("n", "g")).select("owner", "n", F.col("g.id").alias("key"), F.col("g.last_done").alias("day"))
    return each.groupBy("owner", "key").agg(F.max_by("day", "n").alias("day"))


def active_filters(f: Column, terms: int = 3) -> Column:
    """How many of a saved filter's choices (a struct) differ from none at all; a range counts once."""
    listed = [F.coalesce(F.size(f[n]) > 0, F.lit(False)) for n in ("status", "area", "bedrooms", "features", "style")]
    ranges = [f["min"].isNotNull() | f["max"].isNotNull(), f["land_min"].isNotNull() | f["land_max"].isNotNull(), f["build_min"].isNotNull() | f["build_max"].isNotNull()]
    said = [F.coalesce(f[n] != "", F.lit(False)) for n in ("assessed", "source", "q", "verdict", "my_verdict")]
    rest = [
        f["anchor"].isNotNull() & f["anchor_km"].isNotNull(), f["beach"].isNotNull(), f["max_age_days"].isNotNull(),
        F.coalesce(~f["furnished"].isin("", "any"), F.lit(False)), F.coalesce(F.size(f["term"]) < terms, F.lit(False)), F.coalesce(~f["removed"].isin("", "hide"), F.lit(False)),
    ]
    return F.aggregate(F.array(*listed, *ranges, *said, *rest), F.lit(0), lambda n, on: n + on.cast("int"))
