import numpy as np
from pyspark.sql import functions as F

from hearth.llm import quality as Q
from hearth.llm.q_quality import op6_quality
from hearth.session import table
from helpers import CLASHES, ODD, docs, prose


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label > 0
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op6_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    score, label = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    assert len(rows) > 50 and auc(score, label) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_labels_of_held_out_rows_have_no_effect(spark, sf):
    labels, documents = table(spark, sf, "labels"), table(spark, sf, "documents")
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r["doc_id"]: r["score"] for r in Q.scores(documents, x).collect()} for x in (labels, turned))
    assert one == two


def test_only_the_text_counts(spark, sf):
    documents = table(spark, sf, "documents")
    other = documents.withColumns({"lang": F.lit("xx"), "source": F.lit("zz"), "n_chars": F.lit(0)})
    labels = table(spark, sf, "labels")
    assert {tuple(r) for r in Q.scores(documents, labels).collect()} == {tuple(r) for r in Q.scores(other, labels).collect()}


def test_odd_rows(spark):
    frame = docs(spark, [*ODD, *(prose(i, 50) for i in range(40))]).withColumns({c: F.lit(1) for c in CLASHES})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in Q.scores(frame, labels).collect()}
    assert len(got) == 50 and got[0] == got[1] and got[8] == got[9] and all(0 <= s <= 1 for s in got.values())
    assert Q.keep_good(frame, labels).columns == frame.columns
    none = labels.filter("false")
    assert {r["score"] for r in Q.scores(frame, none).collect()} == {0.5}
    assert Q.scores(frame.filter("false"), labels).count() == 0
    assert {r["score"] for r in Q.scores(frame, labels.withColumn("quality", F.lit(1))).collect()} == {1.0}


def test_counts_are_the_same_in_parts():
    import pyarrow as pa

    texts = [prose(i, 30) for i in range(20)]
    whole = next(Q._count_batches(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    split = next(Q._count_batches(iter([pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]) for t in texts])))
    one, two = (np.frombuffer(b"".join(x.column("sums").to_pylist()), "<i4").reshape(-1, Q.DIM + 1) for x in (whole, split))
    assert (one[3:, -1] == two[3:, -1]).all() and (one[3:] == two[3:]).all()


def test_vectors_and_pooling_equal_plain_python(spark):
    """Word by word: neighbours' index vectors summed, then a document's mean and root mean square."""
    texts = [*ODD, prose(1, 300), "CAPS word word, again 12 12!", prose(2, 80) + " SHOUT"]
    places, signs = Q.index_vectors()
    sums = np.zeros((Q.BUCKETS, Q.DIM))
    for text in texts:
        stream = [Q.EDGE, Q.EDGE, *Q.word_ids(text), Q.EDGE, Q.EDGE]
        for i, word in enumerate(stream):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(stream):
                    for k in (0, 1):
                        sums[word, places[stream[j], k]] += signs[stream[j], k]
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    got = Q.word_vectors(docs(spark, texts))
    assert np.allclose(got[3:], want[3:], atol=1e-6)  # markers' rows see neighbouring documents
    for text in texts:
        ids = Q.word_ids(text)
        x = Q.pooled(text, got)
        if ids:
            rows = got[ids]
            assert np.allclose(x[: Q.DIM], rows.mean(axis=0), atol=1e-5) and np.allclose(x[Q.DIM : 2 * Q.DIM], np.sqrt((rows * rows).mean(axis=0)), atol=1e-5)
        else:
            assert not x.any()


def test_large_counts_are_split():
    big = np.array([[3_000_000_000, -5], [1, 2]])
    parts = list(Q.fitting(big))
    assert sum(p.astype(np.int64) for p in parts).tolist() == big.tolist() and all(p.dtype == np.dtype("<i4") for p in parts)
