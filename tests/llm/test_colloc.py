"""Collocations against counts of all phrases in plain Python."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import CLASHES, ODD, prose
from hearth.llm import colloc
from hearth.llm.q_colloc import OP11_SQL, op11_collocations
from oracle import assert_same


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", piece) if w] for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower)]


def brute(rows, least, longest=5, first=2000):
    """(lang, text) -> lang, rank, phrase, a, l, r, n, score, cut."""
    counts = {}
    for lang, text in rows:
        own = counts.setdefault(lang or "und" if lang != "" else "", Counter())
        for words in pieces(text):
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        n = sum(f for g, f in own.items() if len(g) == 1)
        often = {g: f for g, f in own.items() if f >= least and len(g) > 1}
        inside = {}
        for g, f in often.items():
            for k in range(1, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(f, inside.get(g[i : i + k], 0))
        scored = []
        for g, a in often.items():
            if inside.get(g, 0) < a:
                score, cut = min((1000 * a * n // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), cut, own[g[:cut]], own[g[cut:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n, -score, cut) for rank, (score, a, p, cut, l, r) in enumerate(sorted(scored)[:first], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut").collect()))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")


ROWS = [("en" if i % 3 else "de", prose(i, 120, 12) + ("." if i % 2 else "! Of the w1 w2 w3 w4, so to say\tof  the w1 w2") + " w1\x01 w1\x01 w2") for i in range(40)]
ROWS += [(None, t) for t in ODD] + [("und", "one two one two. One TWO"), ("", "one two one two one two"), ("fr", "é è é è É è\né 汉字 é 汉字 é 汉字 🙂🙂 🙂 🙂🙂 🙂 🙂🙂 🙂")]


@pytest.mark.parametrize("least,first,ranges,chunk", [(3, 2000, None, 1 << 20), (2, 5, 1, 300), (4, 2000, 3, 1000), (2, 2000, 1000, 5000)])
def test_counts_of_all_phrases(spark, monkeypatch, least, first, ranges, chunk):
    monkeypatch.setattr(colloc, "CHUNK", chunk)
    got = found(colloc.collocations(frame(spark, ROWS), least, 5, first, ranges))
    assert got == brute(ROWS, least, 5, first) and len(got) > 15


def test_word_that_begins_a_third_of_all_phrases(spark):
    rng = np.random.default_rng(2)
    rows = [("en", " ".join(f"the w{int(x)}" for x in rng.zipf(1.5, 200) % 40)) for _ in range(60)]
    for ranges in (2, 40):
        assert found(colloc.collocations(frame(spark, rows), 3, 5, 2000, ranges)) == brute(rows, 3)


def test_odd_rows(spark):
    long = [("en", "a b c " * 30_000), ("en", None), ("en", "")]
    assert found(colloc.collocations(frame(spark, long), 100)) == brute(long, 100)
    assert found(colloc.collocations(frame(spark, []), 1)) == [] == found(colloc.collocations(frame(spark, [("en", None), (None, "one")]), 1))
    df = frame(spark, ROWS)
    for name in [*CLASHES, "lang2", "phrase", "f", "range", "parts", "longer", "salt", "score"]:
        df = df.withColumn(name, F.lit("x"))
    assert found(colloc.collocations(df, 3)) == brute(ROWS, 3)


@settings(max_examples=100, deadline=None)
@given(st.text("aB .,\t\n\x01é", max_size=60), st.integers(1, 5))
def test_words_of_a_chunk(text, n):
    words = colloc.Words(text.encode())
    own = [tuple(p[i : i + n]) for p in pieces(text) for i in range(len(p) - n + 1)]
    at = words.starts(n)
    names = words.names.to_pylist()
    assert [tuple(names[words.ids[a + j]] for j in range(n)) for a in at] == own
    if own:
        phrases, often = words.counts(at, n)
        assert dict(zip(phrases.to_pylist(), often.tolist())) == Counter(map(" ".join, own))
    bits = np.zeros(1 << 17, np.uint8)
    for phrase in {" ".join(g) for g in own}:
        slot = colloc.phrase_hash("en", phrase) % (1 << 20)
        bits[slot >> 3] |= 128 >> (slot & 7)
    assert np.flatnonzero(words.frequent("en", n, bits)).tolist() == at.tolist()


def test_scores_beyond_64_bits(spark):
    a, n, cuts = 4_000_000_000_000, 9_000_000_000_000_000, [(5_000_000_000_000_001, 4_000_000_000_007), (4_000_000_000_007, 5_000_000_000_000_001), (4_000_000_000_000, 4_000_000_000_000)]
    df = spark.createDataFrame([(a, n, cuts)], "a long, n long, cuts array<struct<l:long,r:long>>")
    s = df.select(colloc.scores(F.col("cuts"), "a", "n").alias("s")).first()["s"]
    score, cut = min((1000 * a * n // (l * r), i) for i, (l, r) in enumerate(cuts))
    assert (s["score"], s["cut"]) == (score, cut)


def test_query(spark, sf):
    assert_same(op11_collocations(spark, sf), sf, OP11_SQL)
