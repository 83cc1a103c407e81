import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hearth.llm import simhash as S
from hearth.llm.q_simhash import op1_simhash
from hearth.session import table
from helpers import CLASHES, ODD, docs, prose


def brute_print(text, k=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    links = [(a, b) for a, b in combinations(ids, 2) if bin(prints[a] ^ prints[b]).count("1") <= 3]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_query_equals_brute_force(spark, sf):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op1_simhash(spark, sf).collect()}
    prints = {r["doc_id"]: brute_print(r["text"]) for r in table(spark, sf, "documents").collect()}
    roots = brute_components(prints)
    assert got == {i: (f"{p:016x}", roots[i]) for i, p in prints.items()}


def test_odd_rows(spark):
    frame = docs(spark, ODD).withColumns({c: F.lit(1) for c in CLASHES})
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in S.near_duplicates(frame).collect()}
    assert [got[i] for i in (0, 1, 2)] == [(0, 0)] * 3  # without words: linked like any other
    assert got[9] == got[8]
    assert S.near_duplicates(docs(spark, [])).count() == 0


def test_links_of_close_fingerprints(spark):
    """All pairs within the radius are connected, whichever bits differ; cells are cut into chunks."""
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    prints = {b for b in base}
    for b in base:
        for _ in range(4):
            prints.add(b ^ sum(1 << int(i) for i in rng.choice(64, 3, replace=False)))
    prints = sorted(prints)
    frame = spark.createDataFrame([(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in S.group(frame).collect()}
    roots = brute_components(dict(enumerate(prints)))
    assert all(got[int(np.uint64(p).view(np.int64))] == roots[i] for i, p in enumerate(prints))
    chunked = S.link(frame.select("fp"), chunk=2).collect()
    assert {x for r in chunked for x in r} == {x for r in S.link(frame.select("fp")).collect() for x in r}


def test_deduplicate_keeps_one_of_each_group(spark):
    long = prose(1, 300)
    words = long.split()
    near = " ".join(["new"] + words[:100] + ["other", "words"] + words[102:])  # over 0.8 of the five-word shingles
    far = " ".join(w if i % 12 else "zz" for i, w in enumerate(words))  # well under 0.8
    texts = [(5, long), (2, near), (9, long), (9, long), (3, far), (None, long), (7, prose(2, 300)), (8, ""), (6, None)]
    frame = docs(spark, texts).withColumns({c: F.lit(1) for c in CLASHES})
    out = S.deduplicate(frame)
    assert out.columns == frame.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 3, 6, 7]
    assert S.deduplicate(docs(spark, [])).count() == 0


def test_similar_pairs_on_whole_table(spark):
    """No two kept texts have 0.8 of their five-word shingles in common."""
    frame = table(spark, "/root/testdata/sf0.01", "documents")
    kept = [r["text"].lower().split() for r in S.deduplicate(frame).collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in kept]
    holders: dict = {}
    for i, s in enumerate(sets):
        for x in sorted(s)[:: max(1, len(s) // 12)]:
            holders.setdefault(x, []).append(i)
    near = {(a, b) for ids in holders.values() if len(ids) < 50 for a, b in combinations(ids, 2)}
    assert not [(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_sketch_similarity():
    a, b = (np.arange(lo, lo + 500, dtype="<u4") for lo in (0, 100))
    assert S.similarity_of(a, b) == 400 / 600
    big = np.sort(np.random.default_rng(0).choice(1 << 32, 20_000, replace=False).astype("<u4"))
    one, two = big[:18_000], big[2_000:]
    one, two = (np.sort(x) for x in (np.random.default_rng(3).permutation(big)[:18_000], np.random.default_rng(4).permutation(big)[:18_000]))
    exact = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
    assert abs(S.similarity_of(one[: S.SKETCH], two[: S.SKETCH]) - exact) < 0.05


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_copies_with_a_repeated_line_are_similar(spark):
    """Sets of shingles count, not how often a shingle occurs: fingerprints of such copies differ in many bits."""
    texts = []
    for seed in range(12):
        text = prose(100 + seed, 400)
        texts += [text, text + " " + " ".join([prose(200 + seed, 10)] * 50)]
    assert all(jaccard(a, b) >= 0.9 for a, b in zip(texts[::2], texts[1::2]))
    assert max((S.fingerprint(a, 5) ^ S.fingerprint(b, 5)).bit_count() for a, b in zip(texts[::2], texts[1::2])) > 24
    assert sorted(r["doc_id"] for r in S.deduplicate(docs(spark, texts)).collect()) == list(range(0, 24, 2))


def test_long_sets_are_compared_whole():
    """Just over and just under the bar, where the least hashes of both sets say otherwise."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        pool = rng.choice(1 << 32, 6_000, replace=False).astype("<u4")
        for shared in (4_801, 4_799):  # of 6000
            sides = np.sort(pool[:5_400]), np.sort(np.concatenate((pool[5_400 - shared : 5_400], pool[5_400:])))
            a, b = S.similar_in_cells(np.zeros(2, np.int64), np.array([1, 2], np.uint64), [x.tobytes() for x in sides], 0.8)
            assert len(a) == (shared >= 4_800)


def test_buckets_discard_no_similar_pair():
    rng = np.random.default_rng(6)
    for size in (1, 4, 5, 9, 100, 3_000):
        pool = rng.choice(1 << 32, size, replace=False).astype("<u4")
        for lost in {0, size // 10, size // 5, size // 4}:
            sides = [np.sort(pool), np.sort(pool[: size - lost])]
            a, _ = S.similar_in_cells(np.zeros(2, np.int64), np.array([1, 2], np.uint64), [x.tobytes() for x in sides], 0.8)
            assert len(a) == ((size - lost) / size >= 0.8)
