"""Requests about channels one after the other, and the two shapes of last reads."""

import datetime as dt
import time

from pyspark.sql import functions as F

from hearth.operators import intake as I

AT = dt.datetime(2001, 8, 1)
STORED = "id string, " + I.ENTRY


def _run(spark, stored, asked):
    rows = spark.createDataFrame(stored, STORED)
    requests = spark.createDataFrame([(n, text, "anna", AT) for n, text in enumerate(asked)], "place long, input string, by string, at timestamp_ntz")
    entries, told = I.upsert_sources(rows, requests, ["siteone"])
    return {r["id"]: r for r in entries.collect()}, {r["place"]: (r["id"], r["action"], r["refusal"]) for r in told.collect()}


def test_requests_of_one_channel_follow_each_other(spark):
    stored = [("siteone", "scraper", "Site One", None, True, None, None, False, "system", None, None), ("grp", "agent", "Group", "u", True, "n", "c1", False, "system", None, None)]
    asked = [
        '{"name":"Bali Café","kind":"website","url":"http://c"}', '{"name":"Bali Cafe","kind":"website"}', '{"id":"bali-cafe","enabled":false}', '{"id":"Bali Cafe","url":null,"name":" "}',
        '{"id":"siteone","kind":"agent"}', '{"id":"siteone","enabled":false,"kind":"scraper"}', '{"id":"grp","kind":"scraper"}', '{"id":"grp","kind":"odd"}', '{"id":"grp","kind":"other","contact_id":null}',
        '{"name":"New","kind":"scraper"}', '{"name":"!!","kind":"agent"}', '{"kind":"agent"}', '{"name":"No kind"}', None,
    ]
    entries, told = _run(spark, stored, asked)
    assert told == {
        0: ("bali-cafe", "created", None), 1: ("bali-cafe", None, "is there already"), 2: ("bali-cafe", "updated", None), 3: ("bali-cafe", "updated", None),
        4: ("siteone", None, "keeps its kind"), 5: ("siteone", "updated", None), 6: ("grp", None, "keeps its kind"), 7: ("grp", None, "unknown kind"), 8: ("grp", "updated", None),
        9: ("new", None, "no adapter"), 10: (None, None, "no letter or digit in the name"), 11: (None, None, "no name"), 12: ("no-kind", None, "unknown kind"), 13: (None, None, "no name"),
    }
    assert set(entries) == {"siteone", "grp", "bali-cafe"}
    cafe, site, grp = entries["bali-cafe"], entries["siteone"], entries["grp"]
    assert (cafe["name"], cafe["url"], cafe["enabled"], cafe["created_by"], cafe["updated_at"]) == ("Bali Café", None, False, "anna", AT)
    assert (site["kind"], site["enabled"], site["created_by"]) == ("scraper", False, "system")
    assert (grp["kind"], grp["contact_id"], grp["url"], grp["notes"]) == ("other", None, "u", "n")


def test_no_requests_and_no_channels(spark):
    stored = [("grp", "agent", "Group", "u", True, "n", "c1", False, "system", None, None)]
    entries, told = _run(spark, stored, [])
    assert set(entries) == {"grp"} and not told
    assert _run(spark, [], []) == ({}, {})


def test_last_reads_of_both_shapes(spark):
    states = [
        ("a", '{"last_done":{"1":"2026-01-02","2":"2026-01-03"},"groups":[{"id":"9","last_done":"2026-01-01"}]}'), ("b", '{"groups":[{"id":1,"last_done":"2026-01-02"},{"id":"2"},{"id":"1","last_done":"2026-01-05"},null]}'),
        ("c", None), ("d", "[]"), ("e", "{"), ("f", '{"last_done":"never"}'),
    ]
    got = sorted(map(tuple, I.last_done(spark.createDataFrame(states, "owner string, state string")).collect()))
    assert got == [("a", "1", "2026-01-02"), ("a", "2", "2026-01-03"), ("b", "1", "2026-01-05")]


def test_no_choice_counts_nothing(spark):
    names = {"status": "array<string>", "area": "array<string>", "bedrooms": "array<int>", "features": "array<string>", "style": "array<string>", "term": "array<string>"}
    numbers = "min max land_min land_max build_min build_max anchor anchor_km beach max_age_days".split()
    texts = "furnished assessed source q verdict my_verdict removed".split()
    none = {**{n: F.lit(None).cast(k) for n, k in names.items()}, **{n: F.lit(None).cast("int") for n in numbers}, **{n: F.lit(None).cast("string") for n in texts}}
    count = lambda **more: spark.range(1).select(I.active_filters(F.struct(*[c.alias(n) for n, c in (none | more).items()]))).first()[0]
    assert count() == 0 and count(removed=F.lit("hide"), furnished=F.lit("any"), q=F.lit(""), min=F.lit(1), max=F.lit(2), anchor=F.lit(1)) == 1
    assert count(term=F.array(F.lit("sale")), anchor=F.lit(1), anchor_km=F.lit(2), removed=F.lit("only")) == 3


def test_requests_of_no_channel_do_not_wait_for_each_other(spark):
    rows = spark.createDataFrame([], STORED)
    asked = spark.range(20_000).select(F.col("id").alias("place"), F.lit('{"kind":"agent"}').alias("input"), F.lit("anna").alias("by"), F.lit(AT).cast("timestamp_ntz").alias("at"))
    entries, told = I.upsert_sources(rows, asked, [])
    started = time.monotonic()
    assert told.groupBy("id", "action", "refusal").agg(F.count("*").alias("n"), F.count_distinct("place").alias("places")).collect() == [(None, None, "no name", 20_000, 20_000)]
    assert time.monotonic() - started < 15  # in one group each one copied what was told to those before it
    assert entries.count() == 0
