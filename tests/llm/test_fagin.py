"""Hard negatives against all pairs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import CLASHES
from hearth.llm import fagin
from hearth.llm.q_fagin import OP13_SQL, op13_hard_negatives
from oracle import assert_same


def brute(rows, every=100):
    """(vec_id, label, integer vector), one for each vec_id."""
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for anchor, label, vec in rows:
        if anchor % every:
            continue
        scored = sorted((-dot(vec, v), i, l) for i, l, v in rows if i != anchor)
        for s, positive, _ in [x for x in scored if x[2] == label][:5]:
            own = [(i, -t) for t, i, l in scored if l != label and 30 * -s <= 100 * -t <= 90 * -s]
            out |= {(anchor, positive, rank, i, -s, t) for rank, (i, t) in enumerate(own[:10], 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def found(df):
    rows = df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert len({(r[0], r[1], r[2]) for r in rows}) == len(rows)
    return set(map(tuple, rows))


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(1, 4), st.integers(1, 4))
def test_search_is_that_of_all_rows(seed, count, width, k):
    rng = np.random.default_rng(seed)
    ids, vectors, anchor = rng.permutation(count), rng.integers(-4, 5, (count, width)), rng.integers(-3, 4, width)
    wanted = rng.random(count) < 0.7
    windows = [fagin.Window_(*sorted(rng.integers(-20, 21, 2).tolist())) for _ in range(3)] + [fagin.Window_(fagin.LOWEST, fagin.HIGHEST), fagin.Window_(2, 1)]
    got, scored = fagin.threshold_search(fagin.Lists(ids, vectors), anchor, wanted, windows, k)
    scores = vectors @ anchor
    for w, best in zip(windows, got):
        assert best == [(-s, i) for s, i in sorted((-int(s), int(i)) for s, i, ok in zip(scores, ids, wanted) if ok and w.low <= s <= w.high)[:k]]
    assert scored <= count


def test_search_stops_early():
    """Rows along one direction: the lists agree, and a few rows decide."""
    rng = np.random.default_rng(1)
    vectors = np.rint(rng.uniform(0, 1000, (20_000, 1)) * [3, -2, 1] + rng.normal(0, 5, (20_000, 3))).astype(np.int64)
    lists = fagin.Lists(np.arange(20_000), vectors)
    (best,), scored = fagin.threshold_search(lists, np.array([30, -20, 10]), np.ones(20_000, bool), [fagin.Window_(fagin.LOWEST, fagin.HIGHEST)], 5)
    scores = vectors @ np.array([30, -20, 10])
    assert [s for s, _ in best] == sorted(scores.tolist(), reverse=True)[:5] and scored < 2000


@pytest.mark.parametrize("sizes", [{}, {"SLICE": 40, "SET": 2}, {"SPREAD": 1}])
def test_all_pairs(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(fagin, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) / 3).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(600)]
    rows += [(1000 + i, v, l) for i, v, l in rows[:150]]  # ties
    want = brute([(i, l, [int(np.floor(256 * x)) for x in v]) for i, v, l in rows])
    assert found(fagin.mine(frame(spark, rows), F.col("vec_id") % 100 == 0)) == want and len(want) > 100


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.25], 2), (3, [0.5, 0.25], 2), (2, [0.5, 0.25], 2), (2, [9.0, 9.0], 3), (4, None, 2), (5, [float("nan"), 1.0], 2), (6, [None, 0.5], 2), (7, [float("inf"), 0.5], 2), (8, [0.5, 0.5], None), (None, [0.5, 0.5], 2), (9, [0.6], 2), (10, [], 2), (100, [0.0, 0.0], 2), (200, [-1.0, -1.0], 9), (201, [0.1, 0.1], 9)]
    df = frame(spark, rows)
    for name in [*(c for c in CLASHES if c != "label"), "slice", "set", "vec", "id", "score"]:
        df = df.withColumn(name, F.lit("x"))
    kept = [(0, 1, [256, 128]), (1, 1, [230, 128]), (2, 2, [128, 64]), (3, 2, [128, 64]), (9, 2, [153, 0]), (10, 2, [0, 0]), (100, 2, [0, 0]), (200, 9, [-256, -256]), (201, 9, [25, 25])]
    assert found(fagin.mine(df, F.col("vec_id") % 100 == 0)) == brute(kept) != set()
    assert found(fagin.mine(frame(spark, []), F.col("vec_id") % 100 == 0)) == set()
    assert found(fagin.mine(frame(spark, rows[1:4]), F.col("vec_id") % 100 == 0)) == set()
    with pytest.raises(PySparkException, match="32 bits"):
        fagin.mine(frame(spark, [(0, [1e9], 1)]), F.col("vec_id") % 100 == 0)


def test_query(spark, sf):
    assert_same(op13_hard_negatives(spark, sf), sf, OP13_SQL)
    assert_same(op13_hard_negatives(spark, "/root/testdata/sf0.1"), "/root/testdata/sf0.1", OP13_SQL)
