"""Lempel-Ziv fingerprints against sets of phrases in plain Python."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import CLASHES, ODD, docs, prose
from hearth.llm import lempel
from hearth.llm.q_lempel import op12_fingerprints
from hearth.session import table


def phrases(text: str) -> set[bytes]:
    data, found, at = (text or "").encode(), set(), 0
    for i in range(1, len(data) + 1):
        if data[at:i] not in found:
            found.add(data[at:i])
            at = i
    return found


def jaccard(a: str, b: str) -> float:
    a, b = phrases(a), phrases(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """(doc_id, text) -> doc_id, n_chars, digest of the edited text, the edited text, the next one."""
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, after)
    return out


def fingerprint(text: str) -> str:
    lempel.grow(entries := {}, 0, text.encode())
    return lempel.spelled(lempel.signatures([np.fromiter(entries, np.int64, len(entries))])[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc é", max_size=80), max_size=4))
def test_signatures_are_those_of_the_phrase_sets(texts):
    tries = []
    for text in texts:
        lempel.grow(entries := {}, 0, text.encode())
        words, names = phrases(text), {0: b""}
        for key, number in entries.items():
            names[number] = names[key & ~255] + bytes([key & 255])
        assert set(names.values()) - {b""} == words
        tries.append(np.fromiter(entries, np.int64, len(entries)))
    got = lempel.signatures(tries)
    for i, text in enumerate(texts):
        want = np.full(lempel.BINS, -1, object)
        for phrase in phrases(text):
            h = 0
            for byte in phrase:
                h = (h * int(lempel._BASE) + int(lempel._MIX[byte])) % (1 << 64)
            h ^= h >> 33
            h = h * 0xFF51AFD7ED558CCD % (1 << 64)
            h ^= h >> 29
            slot, rest = h >> 57, h << 7 & (1 << 64) - 1
            want[slot] = rest if want[slot] == -1 else min(want[slot], rest)
        assert got[i].tolist() == [0 if x == -1 else (x >> 16) % 65535 + 1 for x in want]


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=60), st.integers(0, 60))
def test_parse_goes_on_where_it_stopped(text, cut):
    whole, parts = {}, {}
    lempel.grow(whole, 0, text.encode())
    lempel.grow(parts, lempel.grow(parts, 0, text[:cut].encode()), text[cut:].encode())
    assert whole == parts


def check(df, rows):
    got, want = {r["doc_id"]: r for r in df.collect()}, expected(rows)
    assert got.keys() == want.keys()
    for i, (n, digest, text, edited, after) in want.items():
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, digest, fingerprint(text), fingerprint(edited))
        assert abs(r["near_edited"] - jaccard(text, edited)) < 0.25 and abs(r["near_next"] - jaccard(text, after)) < 0.25


@pytest.mark.parametrize("ranges", [None, 1, 3, 1000])
def test_successors_over_ranges(spark, monkeypatch, ranges):
    rows = [(7 * i % 101, prose(i // 2, 40 + i)) for i in range(101)]
    plain = lempel.firsts
    monkeypatch.setattr(lempel, "firsts", lambda keys: plain(keys, ranges))
    check(lempel.successors(docs(spark, rows)), rows)


def test_odd_rows(spark):
    long = prose(5, 60_000)
    rows = [(i, t) for i, t in enumerate(ODD + [long, long, "ab" * 20_000])]
    check(lempel.successors(docs(spark, rows)), rows)
    check(lempel.successors(docs(spark, rows[3:4])), rows[3:4])
    assert lempel.successors(docs(spark, [])).count() == 0 and lempel.fingerprints(docs(spark, [])).count() == 0


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "null id"), (3, "a b c"), (3, "a b c"), (3, "other"), (-(1 << 63), "least")]
    df = spark.createDataFrame([(*r, "en", "web", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in [*CLASHES, "more", "range", "o1", "o2", "o3"]:
        df = df.withColumn(name, df["source"])
    got = lempel.successors(df).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [-(1 << 63), 3, 3, 3] and len(got) == 5
    # in descending order the row after the least id is that without one
    assert next(r for r in got if r["doc_id"] == -(1 << 63))["edited_sha256"] == hashlib.sha256(b"leanu").hexdigest()
    prints = {r["fingerprint"] for r in got if r["doc_id"] == 3}
    assert prints == {fingerprint("a b c"), fingerprint("other")}


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    check(op12_fingerprints(spark, sf), rows)
    own = {r["doc_id"]: r["fingerprint"] for r in lempel.fingerprints(table(spark, sf, "documents")).collect()}
    assert own == {r["doc_id"]: r["fingerprint"] for r in op12_fingerprints(spark, sf).collect()}
