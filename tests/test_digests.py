"""Digests under a size, against the stages gone through one by one in plain Python."""

import json
import random

from hearth.operators import digests as G

SCHEMA = "id long, p struct<new array<struct<title string, reasons array<string>>>, flagged array<struct<title string, reasons array<string>>>, changes array<struct<title string>>, feedback array<struct<title string, text string>>, viewings array<struct<title string, notes string>>>"


def size(p):
    return len(json.dumps(p, ensure_ascii=False, separators=(",", ":")).encode())


def cut(text, most):
    return text if text is None or len(text) <= most else text[:most] + "…"


def by_hand(p, most):
    """As many of the stages as it takes."""
    p, stage = json.loads(json.dumps(p)), 0
    if size(p) >= most:
        stage = 1
        for row in p["new"] + p["flagged"]:
            row["title"], row["reasons"] = cut(row["title"], 60), row["reasons"] and row["reasons"][:4]
    if stage == 1 and size(p) >= most:
        stage = 2
        for name, field in (("changes", None), ("feedback", "text"), ("viewings", "notes")):
            for row in p[name]:
                row["title"] = cut(row["title"], 40)
                if field:
                    row[field] = cut(row[field], 200)
    for number, name in ((3, "new"), (4, "flagged")):
        if stage == number - 1 and size(p) >= most:
            stage = number
            while len(p[name]) > 5 and size(p) >= most:
                p[name].pop()
    return stage, p


def test_stages_one_by_one(spark):
    rng = random.Random(4)
    word = lambda n: None if rng.random() < 0.1 else "".join(rng.choice("aé –\"\\/\n😀x") for _ in range(rng.randrange(n)))
    offer = lambda: {"title": word(120), "reasons": None if rng.random() < 0.2 else [word(20) for _ in range(rng.randrange(8))]}
    payloads = []
    for i in range(120):
        many = lambda make, i=i: [make() for _ in range(rng.randrange(1 + i // 4))]
        payloads.append({"new": many(offer), "flagged": many(offer), "changes": many(lambda: {"title": word(90)}), "feedback": many(lambda: {"title": word(90), "text": word(500)}), "viewings": many(lambda: {"title": word(90), "notes": word(500)})})
    most = 6_000
    out = G.within_budget(spark.createDataFrame(list(enumerate(payloads)), SCHEMA), "p", G.digest_stages(most), most).collect()
    seen = set()
    for row in out:
        stage, want = by_hand(payloads[row["id"]], most)
        assert (row["stages"], row["p"].asDict(True), row["bytes"]) == (stage, want, size(want))
        seen.add(stage)
    assert seen == {0, 1, 2, 3, 4} and len(out) == 120


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(1, None), (2, {"new": [], "flagged": [], "changes": [], "feedback": [], "viewings": []})], SCHEMA)
    got = {r["id"]: (r["p"] is None, r["stages"]) for r in G.within_budget(rows, "p", G.digest_stages(10), 10).collect()}
    assert got == {1: (True, 0), 2: (False, 4)}
    assert G.within_budget(rows.limit(0), "p", G.digest_stages(10), 10).count() == 0
