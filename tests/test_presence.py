"""Timers against the batch predicate, over several runs with late rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearth.streaming import events as X
from hearth.streaming import presence as P

DAY = datetime(2001, 1, 1)


def test_states_over_runs_with_late_rows(spark):
    # run, id, day
    sightings = [(0, "a", 0), (0, "b", 0), (0, "c", 0), (0, "d", 0), (1, "a", 1), (1, "x", 4.5), (1, "b", 2.5), (1, "b", 2.5), (2, "c", 5), (2, "x", 5), (2, "d", 4.8), (3, "x", 20), (3, None, 3), (3, "d", 4.2), (0, "a", 0)]
    rows = spark.createDataFrame([(run, i, DAY + timedelta(days=d)) for run, i, d in sightings], "run int, id string, ts timestamp")
    with P.rocksdb(spark):
        got = X.run_in_slices(rows, [F.col("run") == n for n in range(4)], lambda s: P.presence(s.select("id", "ts")))
    told = sorted((r["id"], (r["at"] - DAY) / timedelta(days=1), r["state"]) for r in got.collect())
    want = [("a", 0, "listed"), ("a", 4, "unlisted"), ("b", 0, "listed"), ("b", 5.5, "unlisted"), ("c", 0, "listed"), ("c", 3, "unlisted"), ("c", 5, "listed"), ("c", 8, "unlisted"),
            ("d", 0, "listed"), ("d", 3, "unlisted"), ("d", 4.8, "listed"), ("d", 7.8, "unlisted"), ("x", 4.5, "listed"), ("x", 8, "unlisted"), ("x", 20, "listed")]
    assert [(i, pytest.approx(d), s) for i, d, s in want] == told
    # the last state of each is what a look at the dates says
    last = {i: s for i, _, s in told}
    seen = {}
    for _, i, d in sightings:
        if i:
            seen[i] = max(d, seen.get(i, 0))
    assert last == {i: "listed" if d + 3 >= 20 - 1 else "unlisted" for i, d in seen.items()}
