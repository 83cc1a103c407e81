"""Joins with rules of their own: nearest places with a cut-off, anchors, shared contacts, text patterns, first photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.operators.search import haversine_km


def places_near(rows: DataFrame, places: list[tuple[str, float, float]], cut_off_km: float) -> DataFrame:
    """rows with lat and lng, and the nearest place's name and distance; null beyond the cut-off.

    The places are a short list of the configuration, so they stand in the plan as literals and nothing is joined.
    """
    each = F.array(*[F.struct(haversine_km(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng)).alias("km"), F.lit(name).alias("name")) for name, lat, lng in places])
    best = F.array_min(F.filter(each, lambda p: p["km"] <= cut_off_km))
    return rows.withColumn("place", best["name"]).withColumn("place_km", best["km"])


def anchor_distances(rows: DataFrame, anchors: list[tuple[str, float, float]]) -> DataFrame:
    """One distance a row for each of a person's anchors, as an array in their order."""
    each = [F.struct(F.lit(name).alias("name"), F.round(haversine_km(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng)), 2).alias("km")) for name, lat, lng in anchors]
    return rows.withColumn("anchors", F.array(*each))


def not_dismissed(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """pairs (a, b) without those that were dismissed in either order."""
    ordered = dismissed.select(F.least("a", "b").alias("__low"), F.greatest("a", "b").alias("__high"))
    return pairs.join(ordered, (F.least("a", "b") == F.col("__low")) & (F.greatest("a", "b") == F.col("__high")), "left_anti")


def shared_contacts(contacts: DataFrame) -> DataFrame:
    """id, phone_key -> phone_key, id, first, rows: each row with a number that others have too, beside the class's first row.

    Two rows share a number if they stand in one class, whatever its size; classes aren't expanded into pairs.
    """
    keyed = contacts.filter("phone_key is not null").select("phone_key", "id").distinct()
    sizes = keyed.groupBy("phone_key").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    return keyed.join(sizes, "phone_key")


def pairs_sharing_contact(pairs: DataFrame, contacts: DataFrame) -> DataFrame:
    """The given pairs (a, b) that have a number in common: any equal key counts."""
    keys = contacts.filter("phone_key is not null").groupBy("id").agg(F.collect_set("phone_key").alias("keys"))
    side = lambda s: keys.select(F.col("id").alias(s), F.col("keys").alias(f"keys_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(F.arrays_overlap("keys_a", "keys_b")).select("a", "b")


def first_pattern(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern (in order of priority) that the text matches: a join with a small regex table."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in patterns])


def same_first_photo(rows: DataFrame, share: float = 0.15) -> DataFrame:
    """id -> match: the smallest other id of the area with the same first photo and a price within the share.

    Prices are dealt into bands as wide as the share, and each row meets its own and the two beside it only.
    """
    import math

    known = rows.filter("photo is not null and price > 0").withColumn("band", F.floor(F.ln("price") / -math.log(1 - share)))
    left = known.select(F.col("id").alias("lid"), "area", "photo", F.col("price").alias("lprice"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = known.select(F.col("id").alias("rid"), "area", "photo", F.col("price").alias("rprice"), "band")
    close = F.abs(F.col("lprice") - F.col("rprice")) <= share * F.greatest("lprice", "rprice")
    both = left.join(right, ["area", "photo", "band"]).filter((F.col("lid") != F.col("rid")) & close)
    return both.groupBy(F.col("lid").alias("id")).agg(F.min("rid").alias("match"))


def child_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """The parents' keys with a count of each child table's rows; zero without any."""
    out = parents.select(key).distinct()
    for name, rows in children.items():
        out = out.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.fillna(0, list(children))


def collected(parents: DataFrame, members: DataFrame, key: str, member: str) -> DataFrame:
    """key, members (sorted): parents without members keep an empty list."""
    lists = members.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("members"))
    empty = F.array().cast(lists.schema["members"].dataType)
    return parents.select(key).distinct().join(lists, key, "left").withColumn("members", F.coalesce("members", empty))
