import math

from pyspark.sql import functions as F

from hearth.llm import licence as L
from hearth.llm.q_licence import op2_licences
from hearth.session import table
from helpers import CLASHES, ODD, docs, prose

LINES = [(f, t) for f, texts in L.TEMPLATES.items() for t in texts]
NEAR = ["The library has a general license for the public to read.", "Version 2.0 of the film was released in spring.", "A copy of the terms is at the office."]
UNLISTED = ["Released under the terms of the Sleepycat License.", "SPDX-License-Identifier: Zlib", "Licensed under the Academic Free License, Version 3.0."]
# other wording: no notice of these stands in the training rows
REWORDED = [
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "This notice may not be removed or altered from any source distribution of the software.",
    "PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform or display publicly this code.",
    "Everybody is allowed to redistribute the code in modified or unmodified form provided the copyright notice stays in place.",
    "The authors accept no liability and give no warranty, express or implied, for the software.",
]


def wrapped(text, width):
    out = [""]
    for word in text.split():
        out[-1] = f"{out[-1]} {word}".strip()
        if len(out[-1]) >= width:
            out.append("")
    return [x for x in out if x]


def found(frame):
    got = {}
    for r in L.scan(frame).collect():
        got.setdefault(r["doc_id"], []).append((r["paragraph"], r["family"]))
    return got


def test_families_near_misses_wrapped_and_unlisted(spark):
    texts = [f"{prose(i, 20)}\n{t}\n{prose(i + 1, 20)}" for i, (_, t) in enumerate(LINES)]
    long = [(f, t) for f, t in LINES if len(t) > 70]
    broken = [prose(i, 9) + "\n" + "\n".join(wrapped(t, 32)) for i, (_, t) in enumerate(long)]
    plain = [*NEAR, *ODD, *(prose(i, 60) for i in range(40)), "word " * 200_000]
    reworded = [*REWORDED, *("\n".join(wrapped(t, 32)) for t in REWORDED)]
    unlisted = [*UNLISTED, *reworded]
    frame = docs(spark, [*texts, *broken, *unlisted, *plain]).withColumns({c: F.lit(1) for c in CLASHES})
    got = found(frame)
    for i, (family, _) in enumerate([*LINES, *long]):
        assert (1, family) in got.get(i, []), (family, got.get(i))
    first = len(LINES) + len(long)
    assert [got.get(first + i) for i in range(len(UNLISTED))] == [[(0, "unknown")]] * len(UNLISTED)
    told = [got.get(first + len(UNLISTED) + i) for i in range(len(reworded))]
    assert told.count([(0, "unknown")]) >= 6 and all(x in (None, [(0, "unknown")]) for x in told), told  # measured: 6 of 10
    assert not [i for i in got if i >= first + len(unlisted)]


def test_query_finds_template_lines_and_nothing_else(spark, sf):
    known = {t for texts in L.TEMPLATES.values() for t in texts}
    want = {(r["doc_id"], n) for r in table(spark, sf, "documents").collect() for n, line in enumerate((r["text"] or "").split("\n")) if line.strip() in known}
    rows = op2_licences(spark, sf).collect()
    lines = {(r["doc_id"], r["paragraph"] + i) for r in rows for i in range(r["lines"])}
    assert want <= lines
    extra = [r["text"] for r in rows if not {(r["doc_id"], r["paragraph"] + i) for i in range(r["lines"])} & want]
    assert not [t for t in extra if "licen" not in t.lower()]


def test_equals_plain_python(spark):
    """Paragraphs, probabilities and shares computed row by row from the model's coefficients."""
    texts = [*(f"{prose(i, 12)}\n{t}" for i, (_, t) in enumerate(LINES)), *NEAR, *UNLISTED, *ODD, "use this file\nat will\n\nunder the license, version\nthat you may not use"]
    gate = L.LineGate(docs(spark, texts))
    rows = L.paragraphs(docs(spark, texts), gate).cache()
    model = L.LicenceModel(rows)
    places = {g: i for i, g in enumerate(model.counts.vocabulary)}
    single = dict(zip(gate.counts.vocabulary, gate.model.coefficients.toArray()))
    weights, bias = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    want = {}
    for i, text in enumerate(texts):
        lines = (text or "").split("\n")
        words = lambda x: "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in x.lower()).split()
        scores = [gate.model.intercept + sum(single.get(w, 0.0) for w in set(words(x))) for x in lines]
        hits = [n for n, x in enumerate(lines) if x and scores[n] >= gate.cut]
        runs = []
        for n in hits:
            runs[-1].append(n) if runs and n - runs[-1][-1] <= 2 else runs.append([n])
        for run in runs:
            w = words(" ".join(lines[run[0] : run[-1] + 1]))
            grams = {" ".join(w[j : j + k]) for k in (1, 2, 3) for j in range(len(w) - k + 1)}
            z = [(b + sum(row[places[g]] for g in grams if g in places)) / model.temperature for row, b in zip(weights, bias)]
            e = [math.exp(x - max(z)) for x in z]
            p = [x / sum(e) for x in e]
            best = max(range(len(p) - 1), key=lambda k: (p[k], -k))
            name = model.names[best]
            share = max([len(set(L._pairs(t)) & set(L._pairs(w))) / len(set(L._pairs(t))) for f, t in L._template_words() if f == name], default=0.0)
            want[i, run[0]] = (run[-1] - run[0] + 1, name, round(p[best], 9), round(1 - p[-1], 9), round(share, 9))
    out = model.predict(rows).withColumn("share", L.template_share(F.col("pairs"), F.col("family")))
    got = {(r["doc_id"], r["paragraph"]): (r["lines"], r["family"], round(r["probability"], 9), round(r["is_license"], 9), round(r["share"], 9)) for r in out.collect()}
    assert got == want and len(want) > 30


def test_empty_table_and_equal_rows(spark):
    assert L.scan(docs(spark, [])).count() == 0
    twice = docs(spark, [(1, LINES[0][1]), (1, LINES[0][1]), (None, LINES[0][1])])
    assert sorted((r["doc_id"] or 0, r["lines"]) for r in L.scan(twice).collect()) == [(0, 1), (1, 1), (1, 1)]
