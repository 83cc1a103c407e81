import corpus_pipeline
from pyspark.sql import functions as F

from hearth.llm import quality as Q
from hearth.llm.q_pii import KEY, KEY_SETTING, key_of, secret_of
from hearth.llm import simhash as S
from hearth.session import settle, table
from helpers import CLASHES, ODD, docs, prose
from test_bpe import brute as brute_bpe
from test_bpe import tokenizer
from test_decontam import brute as brute_hits


def test_stages_one_by_one(spark, sf):
    """Each stage's decisions take effect on all that its predecessor kept, and columns stay those of documents."""
    docs = table(spark, sf, "documents")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = settle(stage(spark, docs, sf), name)
        if name != "bpe":
            assert docs.columns == names and docs.dtypes == table(spark, sf, "documents").dtypes
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
            rows = before.collect()
            clean = {r["doc_id"] for r, x in zip(rows, brute_hits([r["text"] for r in rows], items)) if not x[1]}
            assert set(kept[name]) == clean
        if name == "pii":
            assert set(kept[name]) == {r["doc_id"] for r in before.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in kept[name].values())
            texts = {i: r["text"] for i, r in kept[name].items()}
    tok = tokenizer()
    assert {i: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for i, r in kept["bpe"].items()} == {i: brute_bpe(t, tok) for i, t in texts.items()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == set(kept["bpe"])
    scored = {r["doc_id"]: r["score"] for r in Q.scores(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()}
    assert set(kept["quality"]) == {i for i, s in scored.items() if s >= Q.THRESHOLD}
    assert len(kept["near_duplicates"]) == S.deduplicate(spark.createDataFrame(list(kept["quality"].values()), table(spark, sf, "documents").schema)).count()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "bpe"]


def test_stages_take_odd_rows(spark, sf):
    """Null ids and texts, empty and very long texts, repeated rows, clashing columns, and empty tables, at every stage."""
    long = prose(5, 60_000)
    rows = [*enumerate(ODD), (None, "a text without an id"), (3, "one"), (40, long), (41, long), (42, "write to jane.doe@example.com or call")]
    frame = docs(spark, rows).withColumns({c: F.lit(1) for c in CLASHES})
    none = frame.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out, empty = stage(spark, frame, sf), stage(spark, none, sf)
        assert empty.count() == 0, name
        if name != "bpe":
            assert out.columns == frame.columns == empty.columns, name
        got = out.collect()
        if name in ("pii", "decontamination", "bpe"):
            assert len(got) == len(rows), name
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in got]
            assert ids.count(40) == 1 and 41 not in ids and 9 not in ids and [i for i in ids if i in (0, 1, 2)] == [0]
        if name == "pii":
            texts = {r["doc_id"]: r["text"] for r in got if r["doc_id"] is not None}
            assert texts[0] is None and texts[1] == "" and texts[40] == long and "jane.doe" not in texts[42]


def test_key_is_a_setting(spark):
    assert key_of(spark) == KEY
    spark.conf.set(KEY_SETTING, "own")
    try:
        assert key_of(spark) == "own"
    finally:
        spark.conf.unset(KEY_SETTING)


def test_secret_of_a_run(spark):
    assert secret_of(spark) != secret_of(spark) and KEY not in secret_of(spark)
    spark.conf.set(KEY_SETTING, "own")
    try:
        assert secret_of(spark) == "own"
    finally:
        spark.conf.unset(KEY_SETTING)
