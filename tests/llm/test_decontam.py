import re

from pyspark.sql import functions as F

from hearth.llm import decontam as D
from hearth.llm.q_decontam import OP5_SQL, op5_decontaminate
from helpers import CLASHES, ODD, docs, prose
from oracle import assert_same


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(texts, items, width=10):
    wins = {}
    for name, text in items:
        own = words(text)
        for i in range(max(1, len(own) - width + 1) if own else 0):
            wins.setdefault(tuple(own[i : i + width]), set()).add(name)
    out = []
    for text in texts:
        own, hit, names = words(text), set(), set()
        for n in {len(w) for w in wins}:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    names |= wins[tuple(own[i : i + n])]
        out.append((len(own), len(hit), sorted(names)))
    return out


ITEMS = [("a", prose(1, 30)), ("b", "Short item, of FIVE words"), ("c", "rare rare rare rare rare rare rare rare rare rare rare rare"), ("d", ""), ("e", None), ("f", "é 汉字"), ("g", prose(1, 30)), ("b", "Short item, of FIVE words")]
TEXTS = [*ODD, "x " + prose(1, 30) + " y", prose(1, 9), " ".join(prose(1, 30).split()[3:16]), "so: short-item of five WORDS!", "rare " * 40, "É 汉字 é 汉字", prose(2, 3000)]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id string, text string")


def test_equals_brute_force_on_both_paths(spark):
    for limit in (D.BROADCAST_ROWS, 0):  # windows broadcast, and shuffled
        frame = docs(spark, TEXTS).withColumns({c: F.lit(1) for c in CLASHES})
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in D.scan(frame, bench(spark), broadcast_rows=limit).collect()}
        assert [got[i] for i in range(len(TEXTS))] == brute(TEXTS, ITEMS)


def test_matches_oracle(spark, sf):
    assert_same(op5_decontaminate(spark, sf), sf, OP5_SQL)


def test_decontaminate_drops_documents_with_hits(spark):
    frame = docs(spark, TEXTS).withColumns({c: F.lit(1) for c in CLASHES})
    for limit in (D.BROADCAST_KEYS, 0):
        out = D.decontaminate(frame, bench(spark), broadcast_keys=limit)
        assert out.columns == frame.columns
        assert sorted(r["doc_id"] for r in out.collect()) == [i for i, x in enumerate(brute(TEXTS, ITEMS)) if not x[1]]


def test_empty_tables(spark):
    assert D.scan(docs(spark, []), bench(spark)).count() == 0
    assert [r["n_hit"] for r in D.scan(docs(spark, ["a b"]), bench(spark, [])).collect()] == [0]
