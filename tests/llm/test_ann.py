import numpy as np
from pyspark.sql import functions as F

from hearth.llm import ann as A
from hearth.llm.q_ann import op4_ann
from hearth.session import table
from helpers import CLASHES


def brute(ids, vectors, queries, k=20):
    out = {}
    for q in queries:
        at = ids.index(q)
        score = [(-float(np.dot(vectors[at], v)), i) for i, v in zip(ids, vectors) if i != q]
        out[q] = [i for _, i in sorted(score)[:k]]
    return out


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = table(spark, sf, "embeddings").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows}
    ids = sorted(vectors)
    want = brute(ids, [vectors[i] for i in ids], [i for i in ids if i % 20 == 0])
    got = {}
    for r in op4_ann(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - float(np.dot(vectors[r["query_id"]], vectors[r["vec_id"]]))) < 1e-9
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (20, [0.0, 2.0], 1), (8, [1.0, 1.0, 1.0], 1), (1, [0.5, 0.5], 1)]
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in CLASHES})
    found, recall = A.search(df, F.col("vec_id") % 20 == 0, k=20)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(1, 0.5), (1, 0.5), (2, 0.5), (20, 0.0)], 20: [(1, 1.0), (1, 1.0), (2, 1.0), (0, 0.0)]}
    assert A.search(frame(spark, []), F.col("vec_id") % 20 == 0)[0].count() == 0
    assert A.search(frame(spark, [(3, [1.0], 0)]), F.col("vec_id") % 20 == 0)[0].count() == 0


def test_tree_visits_every_leaf_once():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(2000, 8))
    tree = A.fit_tree(rows, 2000, leaf_rows=50)
    assert sorted(tree.visits(rows[0] @ tree.centres.T)) == list(range(tree.leaves)) and tree.leaves > 20
    assert set(tree.assign(rows)) <= set(range(tree.leaves))


def test_widened_until_the_target(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(3000, 6)))])
    _, measured = A.search(df, F.col("vec_id") % 20 == 0, k=10, recall=0.95)
    assert measured.recall >= 0.95


def test_the_tree_prunes_and_recall_is_that_of_the_rows(spark):
    """Clustered vectors: under half of all rows are scored, and the rows returned have the recall."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    vectors = centres[rng.integers(0, 40, 12_000)] + 0.15 * rng.normal(size=(12_000, 16))
    df = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(vectors)])
    found, measured = A.search(df, F.col("vec_id") % 50 == 0, k=10)
    assert measured.leaves > 20 and measured.scored < 0.5
    vectors = vectors.astype(np.float32).astype(np.float64)  # as they are stored
    asked = list(range(0, 12_000, 50))
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = {q: set(np.argsort(-s)[:10].tolist()) for q, s in zip(asked, scores)}
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & want[q]) / 10 for q in asked]) >= 0.9


def test_only_rows_of_visited_leaves_are_compared():
    import pandas as pd

    queries = pd.DataFrame({"leaves": [[1], [2]], "query_id": [50, 51], "embedding": [[1.0, 0.0], [1.0, 0.0]]})
    rows = pd.DataFrame({"leaf": [1, 2, 3], "vec_id": [1, 2, 3], "embedding": [[0.1, 0.0], [0.2, 0.0], [0.9, 0.0]]})
    out = A._search_cell(5)(queries, rows)
    assert sorted(zip(out["query_id"], out["vec_id"])) == [(50, 1), (51, 2)]


def test_blocks_hold_bounded_rows():
    held = {0: 3, 1: 4, 2: 9, 3: 25, 4: 1, 5: 10, 7: 2}
    places = A.blocks_of(held, 10)
    assert places[0][0] == places[1][0] != places[2][0] and places[3][1] == 3
    used = {}
    for leaf, (first, parts) in places.items():
        for b in range(first, first + parts):
            used.setdefault(b, []).append(leaf)
    assert all(len(own) == 1 or sum(held[x] for x in own) <= 10 for own in used.values())
    assert 3 not in {x for own in used.values() if len(own) > 1 for x in own}
