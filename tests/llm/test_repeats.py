import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from hearth.llm import repeats as R
from hearth.llm.q_repeats import OP9_SQL, op9_repeats
from hearth.session import table
from helpers import CLASHES, ODD, docs
from oracle import assert_same


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if hit[i] and not (i and hit[i - 1]))
        out.append((len(t), sum(hit), runs, bytes(c for c, h in zip(t, hit) if not h)))
    return out


def planted(seed, count=40):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    shared = [letters(rng.randrange(10, 90)) for _ in range(6)]
    texts = ["".join(letters(rng.randrange(0, 40)) + rng.choice([*shared, ""]) for _ in range(rng.randrange(0, 5))) for _ in range(count)]
    return [*texts, "ab" * 60, "z" * 100, texts[3], None, ""]


def test_equals_brute_force_at_a_small_length(spark):
    for seed, most in ((1, 100_000), (2, 3)):  # with few contexts a task also by the way of hot grams
        texts = planted(seed)
        out = R.remove_repeats(docs(spark, texts).withColumns({c: F.lit(1) for c in CLASHES}), 40, 20, most)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def test_query_equals_brute_force(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op9_repeats(spark, sf).collect()}
    want = [(*x[:3], hashlib.sha256(x[3]).hexdigest()) for x in brute([r["text"] for r in rows], 400)]
    assert [got[r["doc_id"]] for r in rows] == want


def test_hot_grams_that_share_a_context(spark):
    """Two grams between the same bytes: no string of 40 bytes repeats, however many contexts a task takes."""
    rng = random.Random(11)
    part = lambda: "".join(rng.choice("abcdefgh") for _ in range(20))
    pool = sorted((part() for _ in range(3000)), key=lambda p: int(R.gram_hashes(R.np.frombuffer(p.encode(), R.np.uint8), 20)[0]))
    a, b, (p, s, p2, s2) = pool[0], pool[1], pool[-4:]
    texts = [x + m + y for x, y in ((p, s), (p2, s2)) for m in (a, b)]
    for most in (100_000, 1):
        assert [r["n_removed"] for r in R.remove_repeats(docs(spark, texts), 40, 20, most).collect()] == [0] * 4


def test_hot_places_and_copies(spark):
    """Many texts with one passage and many copies of one text: joined by broadcast, with the same result."""
    texts = planted(7, 20) + [f"start {i} " + "the passage that stands in many of the texts, word for word " * 2 + f"end {i}" for i in range(60)] + ["one text in many copies, of over forty bytes"] * 50
    for keys in (1_000, 2):
        R.HOT_KEYS, old = keys, R.HOT_KEYS
        try:
            got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in R.remove_repeats(docs(spark, texts), 40, 20).collect()}
        finally:
            R.HOT_KEYS = old
        assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def test_maximal_repeats_are_whole(spark):
    """The occurrences of a repeat are equal strings, all of them in reach are given, and they cover what is removed."""
    texts = planted(5)
    frame = docs(spark, texts)
    keys = {bytes(r["tkey"]): r["text"].encode() for r in R.keyed_texts(frame).collect()}
    for most in (100_000, 3):
        found = R.Repeats(frame, 40, 20, most)
        groups = defaultdict(set)
        for r in found.occurrences().collect():
            groups[r["repeat"], r["bytes"]].add((bytes(r["tkey"]), r["at"]))
        assert groups
        leads = {r["repeat"]: r["lead"] for r in found.groups().collect()}
        for (name, size), places in groups.items():
            assert size >= 40 and len(places) > 1
            strings = {keys[k][at : at + size] for k, at in places}
            assert len(strings) == 1
            if most == 3:
                continue
            # left- and right-extension diversity, if the repeat ends within the reach of its anchor
            for one, other, length in ((-1, 0, leads[name]), (size, size + 1, size - 20 - leads[name])):
                beside = {keys[k][at + one : at + other] if at + one >= 0 else b"" for k, at in places}
                assert len(beside) > 1 or b"" in beside or length == 20
        covered = defaultdict(set)
        for (_, size), places in groups.items():
            for k, at in places:
                covered[k].update(range(at, at + size))
        want = defaultdict(set)
        for r in found.spans().collect():
            want[bytes(r["tkey"])].update(range(r["at"], r["until"]))
        assert covered == want


def test_odd_rows(spark):
    got = {r["doc_id"]: r for r in R.remove_repeats(docs(spark, ODD), 10, 5).collect()}
    assert (got[0]["n_bytes"], got[0]["n_spans"]) == (0, 0)
    assert got[7]["n_removed"] == 5000 and got[8]["n_removed"] == len(ODD[8]) == got[9]["n_removed"]
    assert R.remove_repeats(docs(spark, [])).count() == 0


def test_very_long_text_and_null_ids(spark):
    """A passage that stands at both ends of a text of a megabyte, and in a row without an id."""
    rng = random.Random(3)
    passage, middle = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (450, 1_000_000))
    rows = [(1, passage + middle + passage), (None, "q" + passage), (None, "q" + passage)]
    got = R.remove_repeats(docs(spark, rows).withColumns({c: F.lit(1) for c in CLASHES})).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["n_spans"]) for r in got) == [(0, 451, 1), (0, 451, 1), (1, 900, 2)]


def test_matches_oracle(spark, sf):
    assert_same(op9_repeats(spark, sf), sf, OP9_SQL)
