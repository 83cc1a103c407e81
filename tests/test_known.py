"""Filters of known ids: nothing overlooked, few foreign ids, merged as if built at once, exact behind."""

from pyspark.sql import functions as F

from hearth.operators import known as K


def _ids(spark, first, last, group="F.lit"):
    return spark.range(first, last).select(F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("group"), F.col("id").cast("string").alias("id"))


def test_filter_overlooks_nothing_and_merges(spark):
    ids = _ids(spark, 0, 30_000)
    room = K.sizes(ids)
    assert {r["blocks"] for r in room.collect()} == {16}
    whole = K.bloom(ids)
    parts = K.merged(K.bloom(_ids(spark, 0, 9_000), room), K.bloom(_ids(spark, 9_000, 30_000), room))
    assert sorted((r["group"], r["block"], bytes(r["bits"])) for r in whole.collect()) == sorted((r["group"], r["block"], bytes(r["bits"])) for r in parts.collect())
    assert K.asked(ids, whole).filter("not maybe").count() == 0
    foreign = K.asked(_ids(spark, 50_000, 110_000), whole).filter("maybe").count()
    assert foreign < 60_000 / 100
    # the same number in another group isn't known there
    other = ids.withColumn("group", F.concat(F.lit("h"), "group"))
    assert K.asked(other, whole).filter("maybe").count() == 0


def test_unknown_is_exact_either_way(spark):
    archive = _ids(spark, 0, 4_000)
    batch = _ids(spark, 3_500, 9_000).unionByName(_ids(spark, 3_990, 4_010))
    batch = batch.unionByName(spark.createDataFrame([(None, "1"), ("g1", None), ("new", "1")], "group string, id string")).withColumn("block", F.lit(1))
    want = sorted([(f"g{i % 3}", str(i)) for i in [*range(4_000, 9_000), *range(4_000, 4_010)]] + [("", "1"), ("g1", ""), ("new", "1")])
    batch = batch.withColumnRenamed("block", "extra")
    for sent in (K.SENT, 0):
        got = sorted((r["group"] or "", r["id"] or "") for r in K.unknown(batch, archive, K.bloom(archive), sent).collect())
        assert got == want
    # a filter of another archive that says yes to everything costs work, and no row
    loose = K.bloom(_ids(spark, 0, 9_000))
    assert K.unknown(batch, archive, loose).count() == len(want)
    none = archive.limit(0)
    assert K.unknown(batch, none, K.bloom(none)).count() == batch.count() and K.unknown(batch.limit(0), archive, K.bloom(archive)).count() == 0


def test_archive_is_pruned_before_its_shuffle(spark):
    archive = _ids(spark, 0, 20_000)
    out = K.unknown(_ids(spark, 19_990, 20_400), archive, K.bloom(archive))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    held = K.asked(archive, K.bloom(_ids(spark, 19_990, 20_000)), send=True).filter("maybe").count()
    assert out.count() == 400 and "LeftAnti" in plan and held < 200
    # the filter's test stands below the anti-join, on the archive's side
    assert plan.index("LeftAnti") < plan.rindex("decode") < plan.rindex("Range")


def test_groups_of_files(spark):
    rows = spark.createDataFrame([("/a/posts-77-auto.json", "1", "a"), ("/a/posts-final-x.json", "9", "b"), ("/a/posts-final-x.json", None, "c"), ("/a/other.json", "1", "d"), ("/a/posts-77-b.json", None, None), ("/a/posts-77-b.json", None, "a")], "file string, group_id string, post_id string")
    assert sorted(map(tuple, K.archived_ids(rows).collect())) == [("77", "a"), ("9", "b")]


def test_one_large_group_is_dealt_over_tasks(spark):
    """Ids met their group's room in a join by group alone, so one task held all ids of a group, each four times."""
    held = lambda df: df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    ids = spark.range(200_000).select(F.concat(F.lit("g"), (F.col("id") % 1).cast("string")).alias("group"), F.col("id").cast("string").alias("id"))
    filters = K.bloom(ids)
    assert {r["blocks"] for r in K.rooms(filters).collect()} == {256} and filters.count() == 256 and K.asked(ids, filters).filter("not maybe").isEmpty()
    small, K.DEALT = K.DEALT, 16
    try:
        dealt = K.bloom(ids)
        assert held(dealt) < 64 and dealt.exceptAll(filters).isEmpty()
    finally:
        K.DEALT = small
    plan = K.asked(ids, filters)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
