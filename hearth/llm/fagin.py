"""Hard negatives by the threshold algorithm.

Rows are dealt into slices by vec_id, and anchors into sets; a task has one slice and one set. It keeps a list of the
slice's rows for each dimension, sorted by the component. For an anchor it goes down all lists at once, from the large
end where the anchor's component is positive and from the small end where it is negative. Rows that turn up get their
integer score by random access to the vector. The threshold is the score that a row would have with the components at
which the lists stand: no row that hasn't turned up has more. A window of wanted scores is done once the threshold
falls strictly below the k-th best score found in it (rows of equal scores may still come before that), or below the
window's least score. The best k of each slice and window are put together by Spark.

Positives are found the same way, among the slice's rows of the anchor's label, with one window over all scores.

Every anchor meets every slice: that is what exact answers over all rows ask for. An anchor is copied once for each
slice, a row once for each set of anchors.

Components are floored to integers of 32 bits and scores must fit 64, else the query fails rather than give wrong
numbers. Rows take no part if the label, the vec_id or the vector is null or a component is null or not finite. Of rows
with the same vec_id the least (by label, then vector) counts. A vector that is shorter than others counts as filled up
with zeros; an empty one scores 0 with all. Ties go to the smaller vec_id. Fewer than k: all of them; none: no row. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.session import settle

#: Rows of a slice and anchors of a set, at most on average; small tables have SPREAD slices of SMALL rows or more.
SLICE, SET, SPREAD, SMALL = 65_536, 65_536, 48, 256
#: How far the lists are gone down at first; doubled each time.
STEP = 8
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


class Lists:
    """Vectors with a list for each dimension, sorted by the component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = vectors.argsort(axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)


@dataclass
class Window_:
    """Wanted scores, both ends included."""

    low: int
    high: int


def threshold_search(lists: Lists, anchor: np.ndarray, wanted: np.ndarray, windows: list[Window_], k: int) -> tuple[list[list[tuple[int, int]]], int]:
    """The first k (score, id) of each window among the wanted rows, and how many rows were scored."""
    count = len(lists.ids)
    up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
    seen, found_at, found = np.zeros(count, bool), np.empty(0, np.int64), np.empty(0, np.int64)
    open_windows = [w for w in windows if w.low <= w.high]
    lowest, highest = min((w.low for w in open_windows), default=0), max((w.high for w in open_windows), default=-1)
    depth, until = 0, min(STEP, count)
    while open_windows:
        new = np.zeros(count, bool)
        if len(up) + len(down) == 0:
            new[:], until = True, count  # no list says anything: all scores are 0
        new[lists.order[depth:until, up]] = True
        new[lists.order[count - until : count - depth, down]] = True
        fresh = np.flatnonzero(new & ~seen)
        seen[fresh] = True
        fresh = fresh[wanted[fresh]]
        scores = lists.vectors[fresh] @ anchor
        inside = (scores >= lowest) & (scores <= highest)
        found_at, found = np.concatenate((found_at, fresh[inside])), np.concatenate((found, scores[inside]))
        if until == count:
            break
        threshold = int(lists.sorted[until - 1, up] @ anchor[up]) + int(lists.sorted[count - until, down] @ anchor[down])
        open_windows = [w for w in open_windows if threshold >= w.low and not _enough(found, w, k, threshold)]
        depth, until = until, min(count, 2 * until)
    best = []
    for w in windows:
        own = np.flatnonzero((found >= w.low) & (found <= w.high))
        own = own[np.lexsort((lists.ids[found_at[own]], -found[own]))[:k]]
        best.append(list(zip(found[own].tolist(), lists.ids[found_at[own]].tolist())))
    return best, int(seen.sum())


def _enough(found: np.ndarray, w: Window_, k: int, threshold: int) -> bool:
    """Whether k scores in the window are strictly above the threshold."""
    return int(np.count_nonzero((found <= w.high) & (found >= max(w.low, threshold + 1)))) >= k


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    sizes = np.array([len(v) for v in column], np.int64)
    flat = np.concatenate([chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks] or [np.empty(0)]).astype(np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _both(rows: pa.Table, anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    width = max(max((len(v) for t in (rows, anchors) for v in t.column("vec")), default=0), 1)
    left, right = _matrix(rows.column("vec"), width), _matrix(anchors.column("vec"), width)
    if len(left) and len(right) and width * int(np.abs(left).max()) * int(np.abs(right).max()) > HIGHEST:
        raise OverflowError("scores of these vectors don't fit 64 bits")
    return left, right


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[] for _ in schema], schema)], schema=schema)


_POSITIVE = pa.schema([("anchor_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_NEGATIVE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_spark = {pa.int64(): "long"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_spark[f.type]}" for f in schema)


def _positive_rows(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        left, right = _both(rows, anchors)
        ids, labels, asked = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), anchors.column("label").to_numpy()
        names = anchors.column("vec_id").to_numpy()
        for label in np.unique(asked) if len(ids) else ():
            lists = Lists(ids[labels == label], left[labels == label])
            for i in np.flatnonzero(asked == label) if len(lists.ids) else ():
                (best,), _ = threshold_search(lists, right[i], lists.ids != names[i], [Window_(LOWEST, HIGHEST)], k)
                out += [(int(names[i]), vec_id, score) for score, vec_id in best]
        return _table(out, _POSITIVE)

    return run


def _negative_rows(k: int, floor: int, ceiling: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        left, right = _both(rows, anchors)
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        lists = Lists(ids, left) if len(ids) else None
        for i, (name, label, positives) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("vec_id", "label", "positives")))):
            if lists is None:
                break
            windows = [Window_(-(-floor * p["score"] // 100), ceiling * p["score"] // 100) for p in positives]
            best, _ = threshold_search(lists, right[i], labels != label, windows, k)
            out += [(name, p["id"], p["score"], vec_id, score) for p, found in zip(positives, best) for score, vec_id in found]
        return _table(out, _NEGATIVE)

    return run


def integer_rows(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, vec (256 times each component, floored): the rows that take part, one for each vec_id."""
    floored = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    small = F.forall("embedding", lambda x: F.abs(x.cast("double")) < float(1 << 23))
    vec = F.when(small, floored.cast("array<int>")).otherwise(F.raise_error("component beyond 32 bits after scaling").cast("array<int>"))
    rows = rows.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), vec.alias("vec"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, floor: int = 30, ceiling: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the first rows of its label. For each, the negatives are the first rows of other labels
    with scores of floor to ceiling percent of the positive's. is_anchor: of vec_id; label: of the input's columns.
    """
    label = F.col("label") if label is None else label
    rows = settle(integer_rows(vectors, label), "vectors")
    anchors = rows.filter(is_anchor)
    total, asked = rows.count(), anchors.count()
    slices = max(-(-total // SLICE), min(SPREAD, -(-total // SMALL)), 1)
    sets = max(-(-asked // SET), 1)
    parts = slices * sets
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda df, column, n: df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sliced = each(rows.withColumn("slice", own("vec_id", slices)), "set", sets).withColumn("cell", F.col("slice") * sets + F.col("set"))

    def search(asking: DataFrame, run, schema: pa.Schema) -> DataFrame:
        asking = each(asking.withColumn("set", own("vec_id", sets)), "slice", slices).withColumn("cell", F.col("slice") * sets + F.col("set"))
        left = sliced.select("cell", "vec_id", "label", "vec").repartition(parts, "cell").groupBy("cell")
        return left.cogroup(asking.drop("slice", "set").repartition(parts, "cell").groupBy("cell")).applyInArrow(run, _ddl(schema))

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    near = first(search(anchors, _positive_rows(positives), _POSITIVE), ["anchor_id"], positives)
    near = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    asking = settle(anchors.join(near, "vec_id"), "anchors")
    far = first(search(asking, _negative_rows(negatives, floor, ceiling), _NEGATIVE), ["anchor_id", "positive_id"], negatives)
    return far.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
