"""The listings view's plan."""

from hearth.sources.listings import TABLES, listings


def test_line_items_are_read_once_where_no_merge_is_asked(spark, sf):
    """A part's first id, which takes a second pass over all line items, is found for those only who ask for it."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = listings(spark, sf)
    assert "k_partkey" not in plan(rows.select("id", "availability")) and "k_partkey" in plan(rows.select("id", "merged_into"))


def test_dealt_by_part_gives_the_same_rows(spark, sf, tmp_path):
    """A part's first id may be that of a line without an order, which isn't in the view itself."""
    for name in TABLES:
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        (rows.filter("o_orderkey % 5 > 0") if name == "orders" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    for at in (sf, tmp_path):
        rows, dealt = listings(spark, at), listings(spark, at, dealt=True)
        assert dealt.columns == rows.columns and rows.exceptAll(dealt).isEmpty() and dealt.exceptAll(rows).isEmpty() and rows.filter("merged_into is not null").count() > 0


def test_line_items_are_dealt_by_part_once(spark, sf):
    """The first ids were aggregated in a pass of their own, and a join sent all line items to them."""
    dealt = listings(spark, sf, dealt=True).select("id", "merged_into")
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") and plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan and "concat_ws" not in plan[plan.index("RepartitionByExpression") :]
