"""Queries over small tables that hold what only larger ones held before."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hearth.plans import catalog
from oracle import oracle_rows, spark_rows


def over(spark, tmp_path, name, **tables):
    """The query's rows and those of its SQL, over tables of which the given ones are replaced."""
    from oracle import TABLES

    for t in TABLES:
        df = tables.get(t)
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") if df is None else df
        df.coalesce(1).write.parquet(f"{tmp_path}/w-{t}")
        next((tmp_path / f"w-{t}").glob("part-*.parquet")).rename(tmp_path / f"{t}.parquet")
    return spark_rows(catalog.QUERIES[name](spark, str(tmp_path))), oracle_rows(str(tmp_path), catalog.SQL[name])


def events(spark, rows):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.createDataFrame([(i, ts, u, "view", 1.0, '{"k": 1}') for i, ts, u in rows], schema)


def test_ages_count_fractions_of_a_second(spark, tmp_path):
    """A copy that is a tenth of a second younger than twelve hours is not old."""
    noon = datetime(2024, 1, 15)
    got, want = over(spark, tmp_path, "stale_fetches", events=events(spark, [(3, noon + timedelta(seconds=0.1), 1), (9, noon, 1), (15, noon - timedelta(seconds=0.1), 1), (21, noon, 1)]))
    assert got == want and sorted(got[1]) == [(1.0, False), (4.0, True), (7.0, True), (10.0, True)]


def test_titles_as_they_are_written(spark, tmp_path):
    pages = [(1, "<title> A &amp; &quot;B&quot; &lt;c&gt;</title>"), (2, "<p>no title</p>"), (3, "<title></title>"), (4, None)]
    df = spark.createDataFrame(pages, "page_id bigint, html string").select("page_id", F.lit("http://www.a.example/x").alias("url"), "html")
    got, want = over(spark, tmp_path, "page_heads", pages=df)
    assert got == want


def test_first_users_that_arrive_late(spark, tmp_path):
    """The smallest id of a person stands in the middle of the file."""
    at = datetime(2024, 1, 1)
    rows = [(1000 + (i * 37) % 100, at + timedelta(minutes=i), i % 3) for i in range(100)]
    got, want = over(spark, tmp_path, "stream_first_users", events=events(spark, rows))
    assert got == want


def test_vectors_that_are_copies(spark, tmp_path):
    """Every row of a repeated vector has its pairs, not only the one with the smallest id."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id < 60")
    copies = rows.unionByName(rows.filter("vec_id < 20").withColumn("vec_id", F.col("vec_id") + 5000)).unionByName(rows.filter("vec_id < 3").withColumn("vec_id", F.col("vec_id") + 9000))
    got, want = over(spark, tmp_path, "hamming_pairs", embeddings=copies)
    assert got == want and sum(want[1].values()) > 100
