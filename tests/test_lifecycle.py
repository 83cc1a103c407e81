"""Batches against a fold in plain Python, numbers of lines, documents of records."""

import json
import random

import pytest

from hearth.operators import lifecycle as Y


def fold(rows, most_bytes, most_rows):
    out, state = {}, {}
    for group, n, size in sorted(rows):
        held, count, batch = state.get(group, (0, 0, 0))
        if count and (held + (size or 0) > most_bytes or count == most_rows):
            held, count, batch = 0, 0, batch + 1
        state[group] = (held + (size or 0), count + 1, batch)
        out[group, n] = batch
    return out


@pytest.mark.parametrize("most_bytes,most_rows", [(100, 7), (100, 1000), (1000, 3), (50, 1), (10**9, 10**6)])
def test_batches_are_those_of_a_fold(spark, most_bytes, most_rows):
    rng = random.Random(most_bytes + most_rows)
    rows = [(g, n, rng.choice([0, 5, 30, 60, 99, 100, 101, 250, None])) for g in range(6) for n in range([0, 1, 2, 40, 90, 200][g])] + [(9, 0, 60), (9, 1, 60), (9, 2, 30)]
    found = Y.batches(spark.createDataFrame(rows, "g int, n int, size int"), "g", "n", "size", most_bytes, most_rows).collect()
    assert {(r["g"], r["n"]): r["batch"] for r in found} == fold(rows, most_bytes, most_rows) and len(found) == len(rows)


def test_batches_of_nothing(spark):
    assert Y.batches(spark.createDataFrame([], "g int, n int, size int"), "g", "n", "size", 10, 10).count() == 0


def test_lines_are_numbered_in_the_order_of_the_files(spark, tmp_path):
    for part in range(5):
        (tmp_path / f"{part}.txt").write_text("".join(f"{part}-{i}\n" for i in range([3, 0, 1, 500, 7][part])))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = spark.read.text(str(tmp_path))
        got = Y.numbered_lines(read).collect()
        assert read.rdd.getNumPartitions() > 3
        want = [r["value"] for r in read.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["value"] for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(1, 512))
    plan = Y.numbered_lines(spark.read.text(str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Aggregate" in plan.split("Window", 1)[1]  # the one window stands on the counts


def test_batch_of_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"key": "x", "n": 1}\nno json\n{"n": 2}\n{"key": "y", "n": 3}\n')
    got = sorted((r["place"], r["key"], r["refused"]) for r in Y.read_batch(spark, str(tmp_path), "key string, n int, _bad string", 3).collect())
    assert got == [(1, "x", None), (2, None, "not json"), (3, None, "no key"), (4, "y", "over the limit")]


def test_documents_of_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"swept": "today", "raw": [{"ref": "RF1", "price": 5}, {"ref": "RF2"}]}, indent=1))
    (tmp_path / "b.json").write_text('{"raw": [{"ref": ')
    (tmp_path / "c.json").write_text('{"raw": []}')
    got = sorted((r["file"][-6:], r["place"] or 0, r["ref"], r["price"], r["broken"] is not None) for r in Y.read_document(spark, str(tmp_path), "ref string, price int").collect())
    assert got == [("a.json", 1, "RF1", 5, False), ("a.json", 2, "RF2", None, False), ("b.json", 0, None, None, True)]


def test_batches_send_no_rows_through_the_driver(spark):
    """Beginnings and hops grow with the rows, however small their files are: no join of them is a broadcast."""
    from hearth.operators import lifecycle as Y

    rows = spark.range(200).selectExpr("id % 5 AS g", "id AS o", "10 AS size")
    out = Y.batches(rows, "g", "o", "size", 60, 7)
    out.collect()
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
