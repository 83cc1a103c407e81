"""Runs whose sources fail, their log, the inbox, and passes that people ask for."""

import pytest
from pyspark.sql import functions as F

from hearth.operators import ingest as I
from hearth.plans import q_dedupe, q_ingest

STORED = "id string, source string, title string, price_month_idr bigint, availability string, build_m2 int, land_m2 int, furniture_quality int, last_seen timestamp_ntz, removed_at timestamp_ntz, merged_into string, history array<struct<day:date,price:bigint>>"


def stored(spark, rows):
    full = [(i, s, "t", p, a, None, None, None, None, None, None, []) for i, s, p, a in rows]
    return spark.createDataFrame(full, STORED).withColumn("last_seen", F.lit("2001-01-01").cast("timestamp_ntz"))


def cards(df):
    return df.drop("history", "last_seen", "removed_at")


def test_a_failing_source_leaves_the_others(spark, tmp_path):
    before = stored(spark, [("a1", "a", 5, "available"), ("b1", "b", 5, "available"), ("c1", "c", 5, "available"), ("d1", "d", 5, "available")])
    good = cards(stored(spark, [("a1", "a", 6, "available"), ("a2", "a", 7, "available"), ("a3", "a", 999, "available"), ("x1", "x", 7, "available"), (None, "a", 7, "available"), ("a2", "a", 7, "available")]))
    broken = good.withColumn("title", F.raise_error(F.lit("blocked")).cast("string")).withColumn("source", F.lit("b"))
    readers = {"a": lambda: good, "b": lambda: broken, "c": lambda: good.limit(0), "d": lambda: good.select("no_such_column"), "e": lambda: good.limit(0), "off": lambda: good}
    log = I.RunLog(spark, str(tmp_path / "runs"))
    out = I.run(log, "r1", before, readers, "2001-08-01", F.col("price_month_idr") < 100, disabled=("off",))
    assert {s: tuple(c[n] for n in I.COUNTS) for s, c in out.per_source.items()} == {"a": (3, 1, 1, 0, 1), "b": (0,) * 5, "c": (0,) * 5, "d": (0,) * 5, "e": (0,) * 5}
    assert {s: c["error"] is not None for s, c in out.per_source.items()} == {"a": False, "b": True, "c": True, "d": True, "e": False}
    assert {(r["id"], r["price_month_idr"], r["availability"]) for r in out.rows.collect()} == {("a1", 6, "available"), ("a2", 7, "available"), ("b1", 5, "available"), ("c1", 5, "available"), ("d1", 5, "available")}
    row = log.rows().collect()
    assert len(row) == 1 and (row[0]["seen"], row[0]["new"], row[0]["updated"], len(row[0]["errors"])) == (3, 1, 1, 3) and row[0]["finished_at"] is not None
    # a clean source may lose what it no longer lists
    again = I.run(log, "r2", out.rows, {"a": lambda: good.filter("id = 'a2'")}, "2001-08-09", F.col("price_month_idr") < 100, named=("a",))
    assert {r["id"]: r["availability"] for r in again.rows.collect()} == {"a1": "unlisted", "a2": "available", "b1": "available", "c1": "available", "d1": "available"}
    assert log.rows().count() == 2


def test_a_run_that_never_closed_has_no_finish(spark, tmp_path):
    log = I.RunLog(spark, str(tmp_path / "runs"))
    with pytest.raises(ZeroDivisionError):
        I.run(log, "r", stored(spark, []), {"a": lambda: 1 / 0}, "2001-08-01", F.lit(True))  # an error of the program, not of a source
    assert [r["finished_at"] for r in log.rows().collect()] == [None]


def test_nothing_to_run(spark, tmp_path):
    log = I.RunLog(spark, str(tmp_path / "runs"))
    out = I.run(log, "r", stored(spark, []), {}, "2001-08-01", F.lit(True))
    assert out.rows.count() == 0 and out.table().count() == 0


def test_observed_counts_match_the_log(spark, sf):
    out, log = q_ingest._outcome(spark, sf)
    row = log.rows().first()
    assert row["seen"] == sum(c["seen"] for c in out.per_source.values()) > 0 and len(row["errors"]) == 2 and len(row["notes"]) == 8


def test_pass_on_demand(spark, sf, tmp_path):
    rows = q_dedupe.signal_rows(spark, sf)
    log = I.RunLog(spark, str(tmp_path / "runs"))
    want = {(r["keep"], r["gone"]) for r in q_dedupe.dup_merges(spark, sf).collect()}
    pairs = sorted(want)[:4]
    dismissed = spark.createDataFrame([pairs[0], pairs[1][::-1], ("x", "y")], "a string, b string")
    merges, left = I.duplicate_pass(log, "p", rows, dismissed, ["s0"], "ann", q_dedupe._promo(rows))
    assert {(r["keep"], r["gone"]) for r in merges.collect()} == want and [tuple(r) for r in left.collect()] == [("x", "y")]
    row = log.rows().first()
    assert (row["kind"], row["gone"], row["notes"][0]) == ("duplicates", len(want), "run by ann")


def test_the_listings_are_worked_out_once_for_all_sources(spark, sf, monkeypatch):
    """Each reader went through the line items of its own accord."""
    seen = []

    def run(log, run_id, stored, readers, *rest, details, **more):
        seen.extend([stored, details, *[r() for r in readers.values()]])

    monkeypatch.setattr(q_ingest.I, "run", run)
    q_ingest._outcome(spark, sf)
    assert len(seen) == 10 and not [f for df in seen for f in df.inputFiles() if "lineitem" in f]


def test_cards_are_dealt_by_id_once(spark):
    """By id for the last card of each, and then again for the upsert, before."""
    rows = lambda *r: spark.createDataFrame(list(r), "id string, source string, price int")
    cards = I.once(rows(("a", "s", 1), ("a", "s", 3), ("a", "s", 2), ("a", "t", 9), ("b", "s", None)))
    assert sorted((r["id"], r["source"], r["price"] or 0) for r in cards.collect()) == [("a", "s", 3), ("a", "t", 9), ("b", "s", 0)]
    both = cards.hint("merge").join(rows(("a", "s", 1)).withColumnRenamed("source", "other"), "id", "full_outer")
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
