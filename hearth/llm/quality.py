"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network on top.

Every word has a sparse random index vector. A word's vector is the sum of the index vectors of its neighbours (two on
each side) over the whole corpus; words are kept in `BUCKETS` hashed rows, so the table has a fixed size (about 4 MB)
at every scale and may be broadcast. A document is the mean and the root mean square of its words' unit vectors. Words
in capitals and immediate repetitions put markers into the stream of words. The network is trained on the driver on at
most `sample` labelled rows, and its probabilities are calibrated by a temperature on a part of them that training
doesn't see.

Equal rows get equal scores; very long texts are read whole. Null and empty texts have no words and get the score of an empty document. Null doc_ids aren't held out and have no
labels. If a doc_id has several labels the larger counts; null labels don't count. If the labels are all alike or there
are none, all scores are the share of label 1 (0.5 if there are none). Empty tables give no rows. Other columns are
ignored by `scores` and kept by `keep_good`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, DIM, PARTS = 1 << 14, 64, 64
#: Labelled rows that the network is fitted on, at most.
SAMPLE = 8_000
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
EDGE, CAPITALS, AGAIN = 0, 1, 2
_known: dict[str, tuple[int, ...]] = {}


def _ids_of(word: str) -> tuple[int, ...]:
    bucket = 3 + xxhash.xxh32_intdigest(word.lower().encode("utf-8", "surrogatepass")) % (BUCKETS - 3)
    return (CAPITALS, bucket) if len(word) > 1 and word.isupper() else (bucket,)


def word_ids(text: str | None) -> list[int]:
    """A text's words as rows of the table, with markers for capitals and repetitions."""
    out: list[int] = []
    if len(_known) > 100_000:
        _known.clear()
    before = None
    for word in WORD.findall(text or ""):
        ids = _known.get(word)
        if ids is None:
            ids = _known[word] = _ids_of(word)
        if word == before:
            out.append(AGAIN)
        out += ids
        before = word
    return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two places with signs for each row."""
    rng = np.random.default_rng(17)
    return rng.integers(0, DIM, (BUCKETS, 2)), rng.choice([-1.0, 1.0], (BUCKETS, 2))


def fitting(table: np.ndarray) -> Iterator[np.ndarray]:
    """Tables of 32-bit counts that sum up to the table: one, unless a task counted very much."""
    limit = (1 << 31) - 1
    while np.abs(table).max(initial=0) > limit:
        part = np.clip(table, -limit, limit)
        yield part.astype("<i4")
        table = table - part
    yield table.astype("<i4")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    total, seen, any_rows = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS), False
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            stream: list[int] = [EDGE, EDGE]
            for text in batch.column(0).slice(start, 256).to_pylist():
                stream += word_ids(text)
                stream += (EDGE, EDGE)
            any_rows = True
            for at in range(0, len(stream), 1 << 20):  # a very long text is counted in parts that overlap by a window
                ids = np.array(stream[max(0, at - 2) : at + (1 << 20)])
                seen += np.bincount(ids[min(at, 2) :], minlength=BUCKETS)
                for gap in (1, 2):
                    # pairs whose later word is new in this part
                    skip = max(0, min(at, 2) - gap)
                    one, two = ids[skip : len(ids) - gap], ids[skip + gap :]
                    for word, near in ((one, two), (two, one)):
                        for k in (0, 1):
                            total += np.bincount(word * DIM + places[near, k], signs[near, k], BUCKETS * DIM)
    if any_rows:
        for table in fitting(np.concatenate((total.reshape(BUCKETS, DIM), seen[:, None]), axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in np.split(table, PARTS)], pa.binary())], names=["part", "sums"])


def _add_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob, kind in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), ["<i4"] * batch.num_rows):
            sums[part] = sums.get(part, 0) + np.frombuffer(blob, kind).astype("<i8")
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all rows of the table, from all documents."""
    partial = docs.select("text").mapInArrow(_count_batches, "part int, sums binary")
    rows = partial.repartition("part").mapInArrow(_add_batches, "part int, sums binary").collect()  # PARTS rows of a fixed size
    table = np.zeros((BUCKETS, DIM + 1))
    for row in rows:
        table[row["part"] * BUCKETS // PARTS : (row["part"] + 1) * BUCKETS // PARTS] += np.frombuffer(row["sums"], "<i8").reshape(-1, DIM + 1)
    vectors = table[:, :DIM]
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and root mean square of the words' vectors, the mean's length, and the shares of the markers."""
    ids = word_ids(text)
    if not ids:
        return np.zeros(2 * DIM + 3, np.float32)
    rows, counts = np.unique(np.array(ids), return_counts=True)
    share = (counts / counts.sum()).astype(np.float32)
    own = vectors[rows]
    mean, square = share @ own, np.sqrt(share @ (own * own))
    marks = [float(share[rows == m].sum()) for m in (CAPITALS, AGAIN)]
    return np.concatenate((mean, square, [np.linalg.norm(mean)], marks)).astype(np.float32)


class Network:
    """Two layers, tanh between them; calibrated by a temperature."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 5):
        self.base = float(labels.mean()) if len(labels) else 0.5
        self.fitted = len(labels) > 0 and 0 < self.base < 1
        if not self.fitted:
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(labels))
        held, used = order[: len(order) // 5], order[len(order) // 5 :]
        self.mean, self.scale = features[used].mean(axis=0), features[used].std(axis=0) + 1e-3
        x, y = (features - self.mean) / self.scale, labels.astype(float)
        self.w = [rng.normal(0, features.shape[1] ** -0.5, (features.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, t = [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
                h = np.tanh(x[part] @ self.w[0] + self.w[1])
                g = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3][0]))) - y[part]) / len(part)
                back = np.outer(g, self.w[2]) * (1 - h * h)
                grads = [x[part].T @ back + 1e-4 * self.w[0], back.sum(axis=0), h.T @ g + 1e-4 * self.w[2], np.array([g.sum()])]
                t += 1
                for k, grad in enumerate(grads):  # Adam
                    m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                    self.w[k] = self.w[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        if len(held):
            z = self._logits(features[held])
            loss = lambda temp: np.mean(np.logaddexp(0, np.where(y[held] > 0, -z, z) / temp))
            self.temperature = float(min(np.geomspace(0.25, 16, 121), key=loss))

    def _logits(self, features: np.ndarray) -> np.ndarray:
        return np.tanh(((features - self.mean) / self.scale) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._logits(features) / self.temperature)) if self.fitted else np.full(len(features), self.base)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _pool_udf(vectors: Broadcast):
    @F.pandas_udf("array<float>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([pooled(t, vectors.value) for t in texts])

    return of


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Broadcast, Broadcast]:
    """Word vectors and network, both broadcast (fixed sizes)."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", _pool_udf(vectors)("text").alias("x"))
    # copies of a doc_id would add rows beyond the bound
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("x").alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    features = np.array([r["x"] for r in rows], np.float32).reshape(len(rows), 2 * DIM + 3)
    return vectors, context.broadcast(Network(features, np.array([int(r["quality"] > 0) for r in rows])))


def score_udf(vectors: Broadcast, network: Broadcast):
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(network.value.probability(np.array([pooled(t, vectors.value) for t in texts]).reshape(len(texts), -1)), dtype=float)

    return of


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels, sample)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_udf(*model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    model = train(docs, labels, sample)
    return docs.withColumn("__hearth_score", score_udf(*model)("text")).filter(F.col("__hearth_score") >= threshold).drop("__hearth_score")
