"""Candidates against all pairs, merges against a pass one by one."""

import pytest
from pyspark.sql import functions as F

from hearth.operators import duplicates as D
from hearth.plans import q_dedupe as Q
from oracle import assert_same
from test_similarity import one_by_one


def test_candidates_equal_all_pairs(spark, sf):
    """Every pair of equal bedrooms is compared by the SQL: the combinations of signals lose none, at 0.5 and at 0.6."""
    sql = Q.CANDIDATES.replace(Q.SOME_PAIRS, Q.ALL_PAIRS)
    assert sql != Q.CANDIDATES
    for least in (0.5, 0.6, 0.8):
        assert_same(Q.found_candidates(spark, sf, least).select("a", "b", "score"), sf, f"{sql} SELECT a, b, score FROM C WHERE score >= {least}")


@pytest.mark.parametrize("least", [0.5, 0.6, 0.7, 0.8, 0.95])
@pytest.mark.parametrize("priced", [True, False])
def test_branches_cover_every_sum(least, priced):
    chosen = D.branches(least, priced)
    for state, total in D.sums(priced):
        if total >= 1000 * least:
            assert any(all(state[f] for f in b.fields) and (not priced or state["price"] <= b.price) and state["title"] >= b.title for b in chosen), state
    assert len(chosen) < len(D.PRICED)


def test_lower_scores_are_refused(spark, sf):
    with pytest.raises(ValueError):
        D.candidates(Q.signal_rows(spark, sf), 0.1)


def test_merges_equal_a_pass_one_by_one(spark, sf):
    rows = Q.signal_rows(spark, sf)
    pairs = D.keeper_first(D.automatic_pairs(rows, Q._promo(rows)), ["s0"]).select("keep", "gone", "a", "b").collect()
    want = one_by_one([(r["keep"], r["gone"], (r["a"], r["b"])) for r in pairs])
    got = {(r["keep"], r["gone"]) for r in Q.dup_merges(spark, sf).collect()}
    assert got == want and want


def test_nothing_in_nulls(spark):
    schema = "id long, source string, ref string, area string, bedrooms int, price_month_idr long, title string, description string, land_m2 int, build_m2 int, lat double, lng double, poster string, contacts array<string>, photos array<string>, first_seen timestamp, availability string, merged_into long"
    nothing = (None,) * 14
    rows = [(i, "s", None, *nothing, None) for i in range(3)] + [(9, "s", None, "a", 2, None, *(None,) * 9, None, "available", None)] * 2
    frame = spark.createDataFrame([r[:16] + ("available", None) for r in rows], schema)
    assert D.candidates(frame).count() == 0 and D.automatic_pairs(frame).count() == 0
    assert D.candidates(frame.limit(0)).count() == 0


def test_zero_prices_and_unknown_ones(spark, sf):
    rows = Q.signal_rows(spark, sf).limit(200).withColumn("bedrooms", F.lit(2)).withColumn("price_month_idr", F.when(F.col("quantity") % 3 == 0, F.lit(0)).when(F.col("quantity") % 3 == 1, F.lit(None)).otherwise(F.col("price_month_idr")))
    rows = rows.withColumns({"availability": F.lit("available"), "contacts": F.array(F.lit("one"))}).cache()
    got = {(r["a"], r["b"]) for r in D.candidates(rows).collect()}
    assert got and all(a < b for a, b in got)


def _sent(spark):
    """Bytes written to shuffles up to now."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize("find,most", [(lambda spark, sf: Q.found_candidates(spark, sf, 0.6), 3000), (Q.dup_automatic, 2000)])
def test_titles_are_not_sent_by_row(spark, sf, find, most):
    """Rows are sent once for each choice of signals, as a few numbers, and not for each of their titles' tokens (bytes a row)."""
    live = Q.signal_rows(spark, sf).filter("availability <> 'gone'").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = _sent(spark)
        find(spark, sf).write.format("noop").mode("overwrite").save()
        assert (_sent(spark) - before) / live < most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_side_that_grows_with_the_rows_is_sent_whole(spark, sf):
    """Kept rows are small as compressed files, so they went through the driver to every executor, many times their size."""
    rows = D._numbered(D.prepared(Q.signal_rows(spark, sf).withColumn("url", F.col("id"))))
    titles, sets = D.titles_of(rows)
    pairs = rows.select(F.col("rid").alias("a"), (F.col("rid") + 1).alias("b"), (F.col("rid") % 7).alias("ta"), (F.col("rid") % 5).alias("tb"))
    dice = pairs.select(F.col("ta").alias("x"), F.col("tb").alias("y"), F.lit(0.5).alias("dice")).distinct()
    merges = rows.filter("merged_into is not null").select(F.col("merged_into").alias("keep"), F.col("id").alias("gone"))
    found = [D.with_both(pairs, rows), D.with_dice(pairs, dice), D.verified(pairs, sets, 0.6), D.light(rows, titles, sets), D.apply_merges(rows, merges, ["land_m2"], "2001-08-01")]
    for df in found:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_gaps_look_for_the_best_pairs_only(spark, sf, monkeypatch):
    asked = []

    def candidates(spark, sf_dir, least):
        asked.append(least)
        return spark.range(300).selectExpr("concat('a', id) AS a", "concat('b', id) AS b", "'s1' AS source_a", "'s2' AS source_b", f"IF(id < {250 if least < 1 else 150}, {least}D, NULL) AS score").filter("score is not null")

    monkeypatch.setattr(Q, "_candidates", candidates)
    Q.cross_source_gaps(spark, sf).count()
    assert asked == [1.0, 0.8]
