"""Cursors and rows committed together, with runs that are broken off in between."""

import pytest
from pyspark.sql import functions as F

from hearth.streaming import cursors as C

SCHEMA = "id bigint, twice bigint"


def work(rows):
    return rows.select("id", (2 * F.col("id")).alias("twice"))


class Stop(Exception):
    pass


def stop():
    raise Stop


def ids(sink):
    return sorted(r["id"] for r in sink.rows().collect())


def test_runs_go_on_where_the_last_commit_was(spark, tmp_path):
    sink = C.CursorSink(spark, str(tmp_path / "sink"), SCHEMA)
    assert sink.last() == C.Commit(-1, None) and ids(sink) == []
    source = lambda n: spark.range(n).unionByName(spark.createDataFrame([(None,)], "id long"))
    assert C.advance(sink, source(5), "id", work) == C.Commit(0, "4")
    assert C.advance(sink, source(5), "id", work) == C.Commit(0, "4")  # nothing new
    with pytest.raises(Stop):
        C.advance(sink, source(9), "id", work, stop)  # rows are written, the commit isn't
    assert sink.last() == C.Commit(0, "4") and ids(sink) == list(range(5))
    assert C.advance(sink, source(12), "id", work) == C.Commit(1, "11")
    assert ids(sink) == list(range(12))
    assert {r["id"]: r["batch"] for r in sink.rows().collect()} == {i: 0 if i < 5 else 1 for i in range(12)}
    assert sorted(r["id"] for r in sink.rows(0).collect()) == list(range(5))
    chain = [(r["batch"], r["cursor_before"], r["cursor_after"], r["rows"]) for r in sink.commits().orderBy("batch").collect()]
    assert chain == [(0, None, "4", 5), (1, "4", "11", 7)]


def test_a_batch_is_committed_once(spark, tmp_path):
    sink = C.CursorSink(spark, str(tmp_path / "sink"), SCHEMA)
    assert sink.commit(0, work(spark.range(3)), "2")
    assert not sink.commit(0, work(spark.range(100)), "99")
    assert ids(sink) == [0, 1, 2] and sink.last().cursor == "2"


def test_cursors_of_instants(spark, tmp_path):
    sink = C.CursorSink(spark, str(tmp_path / "sink"), "day timestamp_ntz")
    days = lambda n: spark.range(n).select(F.expr("TIMESTAMP_NTZ'2001-01-01' + make_interval(0, 0, 0, CAST(id AS INT))").alias("day"))
    C.advance(sink, days(3), "day", lambda r: r)
    C.advance(sink, days(10), "day", lambda r: r)
    assert sink.rows().count() == 10 and sink.last().cursor.startswith("2001-01-10")


def test_stream_that_is_killed_between_write_and_commit(spark, tmp_path):
    source, sink = tmp_path / "in", C.CursorSink(spark, str(tmp_path / "sink"), SCHEMA)
    for i in range(5):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.parquet(str(source / f"part={i}"))
    read = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    query = C.stream_into(sink, read(), "id", str(tmp_path / "state"), work, fail_at=2)
    with pytest.raises(Exception, match="stopped between"):
        query.awaitTermination()
    assert sink.last().batch == 1 and len(ids(sink)) == 20
    C.stream_into(sink, read(), "id", str(tmp_path / "state"), work).awaitTermination()
    assert ids(sink) == list(range(50)) and sink.last() == C.Commit(4, "49")
    C.stream_into(sink, read(), "id", str(tmp_path / "state"), work).awaitTermination()  # nothing new
    assert ids(sink) == list(range(50))
