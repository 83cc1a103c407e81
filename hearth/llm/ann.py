"""Nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every row is indexed. A query goes through the tree by a priority queue of
inner products with the nodes' centres and lists the leaves in the order of its visits. How many leaves are visited is
widened until, for calibration queries compared with all rows by brute force, the recall reaches its target. A query
is compared with the rows of the leaves that it visits and with no others, so the calibration's recall is that of the
rows returned. For shuffling, neighbouring leaves of few rows share a block, and a leaf of many rows has several; a
query gives k rows a block, so a task holds one block of rows and one of queries at a time.

Scores are sums of products in double precision in the order of the components; ties go to the smaller vec_id. Rows
whose vector is null, zero, of an uncommon length or has null or non-finite components take no part, nor do null
vec_ids. Equal centres and equal products are visited in the order of their numbers. Rows with the query's vec_id
aren't its candidates; if a vec_id that is a query has several vectors, the
smallest asks. Repeated rows are candidates each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.session import settle

#: Rows that the tree is fitted on, and queries of the calibration, at most.
SAMPLE, CALIBRATION = 20_000, 200
BRANCH, LEAF_ROWS = 8, 512
ROW_BLOCK, QUERY_BLOCK = 8192, 1024
RECALL = 0.95


@dataclass
class Measured:
    """Of the calibration: leaves that a query visits, leaves in all, recall, and the share of all rows it is compared with."""

    visits: int
    leaves: int
    recall: float
    scored: float


@dataclass
class Tree:
    centres: np.ndarray  # of all nodes; node 0 is the root
    children: list[list[int]]
    leaf_of: list[int]  # leaf number of a node, -1 for inner nodes

    @property
    def leaves(self) -> int:
        return max(self.leaf_of) + 1

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        out = np.empty(len(rows), np.int64)
        open_nodes = [(0, np.arange(len(rows)))]
        while open_nodes:
            node, at = open_nodes.pop()
            if not self.children[node]:
                out[at] = self.leaf_of[node]
                continue
            own = self.centres[self.children[node]]
            near = ((own * own).sum(axis=1) - 2 * rows[at] @ own.T).argmin(axis=1)
            open_nodes += [(child, at[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def visits(self, products: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first, for a query's inner products with all centres."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf_of[node]
            for child in self.children[node]:
                heapq.heappush(queue, (-products[child], child))


def fit_tree(sample: np.ndarray, total: int, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS, seed: int = 3) -> Tree:
    """k-means in k-means, until a node stands for leaf_rows of all rows or has under 2 x branch of the sample."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((1, sample.shape[1])), [[]], [-1])
    centres = [sample.mean(axis=0)]
    todo = [(0, sample)]
    leaves = 0
    while todo:
        node, rows = todo.pop()
        parts = []
        if len(rows) * total / len(sample) > leaf_rows and len(rows) >= 2 * branch:
            own = rows[rng.choice(len(rows), branch, replace=False)]
            for _ in range(10):
                near = ((own * own).sum(axis=1) - 2 * rows @ own.T).argmin(axis=1)
                own = np.array([rows[near == k].mean(axis=0) if (near == k).any() else own[k] for k in range(branch)])
            near = ((own * own).sum(axis=1) - 2 * rows @ own.T).argmin(axis=1)
            parts = [(own[k], rows[near == k]) for k in range(branch) if (near == k).any()]
        if len(parts) < 2:
            tree.leaf_of[node] = leaves
            leaves += 1
            continue
        for centre, own_rows in parts:
            tree.children[node].append(len(centres))
            todo.append((len(centres), own_rows))
            centres.append(centre)
            tree.children.append([])
            tree.leaf_of.append(-1)
    tree.centres = np.array(centres)
    return tree


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _assign_batches(tree, dim: int):
    def run(batches):
        for batch in batches:
            leaf = tree.value.assign(_stack(batch.column("embedding"), dim))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), batch.column("vec_id"), batch.column("embedding")], names=["leaf", "vec_id", "embedding"])

    return run


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums in the order of the components, the same for equal rows wherever they stand."""
    return np.add.accumulate(rows * query, axis=1)[:, -1]


def best_rows(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k best by exact score, then id; rough: scores that may be off by rounding."""
    if len(rough) > k:
        kth = np.partition(rough, len(rough) - k)[len(rough) - k]
        at = np.flatnonzero(rough >= kth - 1e-9 * (1 + abs(kth)))
    else:
        at = np.arange(len(rough))
    scores = exact_scores(query, rows[at])
    order = np.lexsort((ids[at], -scores))[:k]
    return list(zip(ids[at][order].tolist(), scores[order].tolist()))


def _brute_batches(asked, dim: int, k: int):
    """The k best of each batch for every calibration query, with their leaves."""

    def run(batches):
        ids, vectors = asked.value
        for batch in batches:
            rows, own, leaf = _stack(batch.column("embedding"), dim), batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            if not len(rows):
                continue
            out = []
            for n, query in enumerate(vectors):
                rough = rows @ query
                rough[own == ids[n]] = -np.inf
                out += [(n, int(own[i]), float(rough[i]), int(leaf[i])) for i in np.argsort(-rough, kind="stable")[:k].tolist() if rough[i] > -np.inf]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int32(), pa.int64(), pa.float64(), pa.int32()))], names=["n", "vec_id", "score", "leaf"])

    return run


def calibrate(indexed: DataFrame, queries: DataFrame, tree: Tree, dim: int, k: int, held: dict[int, int], recall: float = RECALL, most: int = CALIBRATION) -> Measured:
    """How many leaves to visit, and what was measured with them. held: rows of each leaf."""
    asked = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(most).collect()
    if not asked:
        return Measured(1, tree.leaves, 1.0, 0.0)
    vectors = np.array([r["embedding"] for r in asked], np.float64).reshape(len(asked), dim)
    sent = indexed.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in asked]), vectors))
    near = indexed.mapInArrow(_brute_batches(sent, dim, k), "n int, vec_id long, score double, leaf int")
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "vec_id"))
    truth = near.withColumn("rank", rank).filter(F.col("rank") <= k).select("n", "leaf").collect()  # k rows a query
    place = [{leaf: i for i, leaf in enumerate(tree.visits(p))} for p in vectors @ tree.centres.T]
    needed = np.sort([place[r["n"]][r["leaf"]] + 1 for r in truth])
    if not len(needed):
        return Measured(tree.leaves, tree.leaves, 1.0, 1.0)
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])  # widened until the target is reached
    met = sum(held.get(leaf, 0) for order in place for leaf, i in order.items() if i < visits)
    return Measured(visits, tree.leaves, float((needed <= visits).mean()), met / (len(asked) * sum(held.values())))


def blocks_of(held: dict[int, int], most: int = ROW_BLOCK) -> dict[int, tuple[int, int]]:
    """leaf -> its first block and its number of blocks, from the rows of each leaf; neighbouring leaves share a block."""
    out, block, room = {}, 0, most
    for leaf, rows in sorted(held.items()):
        parts = -(-rows // most)
        if parts == 1 and rows > room or parts > 1 and room < most:
            block, room = block + 1, most
        out[leaf] = (block, parts)
        block, room = (block + parts, most) if parts > 1 else (block, room - rows)
    return out


def _visit_batches(tree, held, places, dim: int, visits: int, k: int):
    """A row for each block that a query goes to, with the leaves that it visits there."""

    def run(batches):
        counts, blocks = held.value, places.value
        for batch in batches:
            queries, at, to, which = _stack(batch.column("embedding"), dim), [], [], []
            for n, products in enumerate(queries @ tree.value.centres.T):
                rows, own = 0, {}
                for seen, leaf in enumerate(tree.value.visits(products)):
                    if seen >= visits and rows > k:
                        break
                    if leaf in blocks:
                        rows += counts[leaf]
                        first, parts = blocks[leaf]
                        for block in range(first, first + parts):
                            own.setdefault(block, []).append(leaf)
                at += [n] * len(own)
                to += own
                which += own.values()
            at = pa.array(at, pa.int64())
            columns = [pa.array(to, pa.int32()), pa.array(which, pa.list_(pa.int32())), batch.column("query_id").take(at), batch.column("embedding").take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "leaves", "query_id", "embedding"])

    return run


def _search_cell(k: int):
    """The k best rows of a block for each query, among the rows of the leaves that it visits."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, list[tuple[int, float]]] = {}
        if len(queries) and len(rows):
            q, v = np.stack(queries["embedding"]).astype(np.float64), np.stack(rows["embedding"]).astype(np.float64)
            ids, leaf, asks = rows["vec_id"].to_numpy(), rows["leaf"].to_numpy(), queries["query_id"].to_numpy()
            visitors: dict[int, list[int]] = {}
            for n, leaves in enumerate(queries["leaves"]):
                for own in leaves:
                    visitors.setdefault(own, []).append(n)
            for own, asking in visitors.items():
                at = np.flatnonzero(leaf == own)
                for start in range(0, len(asking) if len(at) else 0, 128):
                    some = asking[start : start + 128]
                    for n, rough in zip(some, q[some] @ v[at].T):
                        ok = ids[at] != asks[n]
                        if len(known := best.get(n, [])) == k:  # what is worse than k rows already found can go
                            ok &= rough >= known[-1][1] - 1e-9 * (1 + abs(known[-1][1]))
                        if ok.any():
                            found = best_rows(q[n], v[at[ok]], ids[at[ok]], rough[ok], k)
                            best[n] = sorted(known + found, key=lambda x: (-x[1], x[0]))[:k]
        out = [(queries["query_id"].iat[n], i, s) for n, found in best.items() for i, s in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> tuple[DataFrame, Measured]:
    """query_id, rank, vec_id, score; and what the calibration measured. is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), Measured(0, 0, 1.0, 0.0)
    dim, total = sizes["dim"], sizes["n"]
    rows = rows.filter(F.size("embedding") == dim)
    sample = rows.select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).orderBy("h").limit(SAMPLE).collect()
    tree = fit_tree(np.array([r["embedding"] for r in sample], np.float64), total)
    sent = spark.sparkContext.broadcast(tree)  # at most 2 x SAMPLE / BRANCH nodes
    indexed = settle(rows.mapInArrow(_assign_batches(sent, dim), "leaf int, vec_id long, embedding array<double>"), "indexed")
    queries = rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    held = {r["leaf"]: r["n"] for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
    measured = calibrate(indexed, queries, tree, dim, k, held, recall)
    places = blocks_of(held)
    visit = _visit_batches(sent, spark.sparkContext.broadcast(held), spark.sparkContext.broadcast(places), dim, measured.visits, k)
    visited = settle(queries.mapInArrow(visit, "block int, leaves array<int>, query_id long, embedding array<double>"), "visits")
    leaves = spark.createDataFrame([(leaf, *place) for leaf, place in places.items()], "leaf int, first int, parts int")
    own = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")
    placed = indexed.join(F.broadcast(leaves), "leaf").select(own.alias("block"), "leaf", "vec_id", "embedding")
    asked = F.broadcast(visited.groupBy("block").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts")))  # a row for each block
    left = visited.join(asked, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    right = placed.join(asked, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = ["block", "part"]
    near = left.select(*cell, "leaves", "query_id", "embedding").groupBy(*cell).cogroup(right.select(*cell, "leaf", "vec_id", "embedding").groupBy(*cell)).applyInPandas(_search_cell(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), measured
