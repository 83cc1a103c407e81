"""License scans: a paragraph classifier over sparse word n-grams, confirmed by templates.

Lines are scored first: a logistic regression over single words, trained on license notices, pieces of them, near misses
and lines of the corpus. A line is a hit if it scores as high as all but a share of 1 - `recall` of the held-out license
rows. Hits that stand next to each other, or with one line between, are joined into a paragraph together with the line
between, so that wrapped notices and whole license texts are read as one. A multinomial logistic regression over the
words, word pairs and triples of all notices and near misses tells license families from other licenses ("unknown") and
from what is no license. It is trained on the templates, whole, shortened and cut, on notices of other licenses, on near
misses, and on a bounded sample of the corpus's own different paragraphs. Its probabilities are calibrated by a
temperature on held-out rows. A paragraph whose probability of being a license is `needed` or more comes out: under the
likeliest family if at least `confirm` of the word pairs of one of the family's templates stand in it, else as "unknown".

Null and empty texts have no paragraphs; very long lines are scored and classified whole. Of equal probabilities the
family that comes first among the templates wins. Repeated rows give repeated hits; an empty table gives no rows. Columns
other than doc_id and text are ignored. Only DataFrame functions and Spark's own feature and regression stages are used.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.session import settle

# Public license notices, by SPDX family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Lines that share words with licenses and aren't any.
NEAR_MISSES = [
    "The driver must carry a license at all times.",
    "Version 3 of the work is under review.",
    "The general public was invited to the library.",
    "This work is part of the terms of the contract.",
    "You may obtain a copy of this file at the office.",
    "The software is free of charge for any person.",
    "Permission is hereby granted to enter the building.",
    "The source code and the binary are in the same place.",
    "It was released under the name of the author.",
    "Use of this file is subject to the terms below.",
    "He was licensed under the old rules.",
    "The foundation published version 2 of the report.",
    "He needs a license for the boat, and a copy of it in the car.",
    "Under the terms of the treaty the island is free.",
    "The public library closed; the public office is open.",
    "Copy the terms and conditions to the file and distribute the copies.",
    "A general license to fish is granted by the office.",
    "All rights of the members are reserved to the club.",
    "The office keeps the terms of each contract on file.",
    "The permission of the owner is needed to enter the garden.",
    "Water is distributed free of charge in the village.",
    "He may use the garden and copy the key.",
    "The source of the river is in the north.",
    "The company paid for the damages to the car.",
    "The warranty of the fridge ends in May.",
    "Changes of the program were announced on the notice board.",
    "The shop has a license to sell bread to the public.",
    "She got her general pilot license last spring.",
    "The town pays a license fee for each public reading room.",
    "Version 5 of the game came out last year.",
    "The original work of the painter hangs in the public hall.",
]
# Notices of licenses without a template: examples of the class "unknown", as they stand and as names in usual forms.
OTHER_NOTICES = [
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "This software is provided as-is, without any express or implied warranty; in no event will the authors be held liable for any damages arising from its use.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "Use of this source code is governed by a license that can be found in the LICENSE file.",
    "All rights reserved; no license is granted to copy, modify or distribute this file.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "The licensor grants you a worldwide, royalty-free, nonexclusive license to reproduce, modify and distribute the covered work.",
    "You may use, reproduce and modify this material for noncommercial purposes only, provided that this notice is retained.",
    "The copyright holders disclaim all liability for damages arising from the use of this code.",
    "Redistribution of this code, modified or unmodified, is permitted as long as the copyright notice is kept.",
    "Any rights in individual contents of this database are licensed under the Database Contents License.",
    "Modified files must carry prominent notices stating that you changed them, and must keep all attribution notices of the source form.",
    "The above copyright notice and this permission notice must not be removed from copies or substantial portions of the code.",
    "The author grants the licensee a perpetual, irrevocable right to use, display and perform the program.",
    "There is no warranty for the program, to the extent permitted by law; it comes without any implied warranty of merchantability or fitness for a purpose.",
    "Derived versions of the software must be renamed and marked as different from the original.",
]
OTHER_NAMES = [
    ("ISC License", "ISC"),
    ("Eclipse Public License, version 2.0", "EPL-2.0"),
    ("Artistic License 2.0", "Artistic-2.0"),
    ("Boost Software License, Version 1.0", "BSL-1.0"),
    ("SIL Open Font License, Version 1.1", "OFL-1.1"),
    ("European Union Public Licence, version 1.2", "EUPL-1.2"),
    ("Common Development and Distribution License", "CDDL-1.0"),
    ("Microsoft Public License", "MS-PL"),
    ("Open Database License", "ODbL-1.0"),
    ("Open Software License, version 3.0", "OSL-3.0"),
    ("PostgreSQL License", "PostgreSQL"),
    ("Example Community License", "LicenseRef-Example"),
]
FORMS = ["Licensed under the {0}.", "Released under the terms of the {0}.", "This work is licensed under the {0}.", "SPDX-License-Identifier: {1}"]
OTHERS = OTHER_NOTICES + [form.format(*name) for name in OTHER_NAMES for form in FORMS]
# Function words: a pair of them says nothing about licenses.
COMMON = "a all an and any are as at be by can case for from in is it its may no not of on or other than that the their this to with without you".split()
UNKNOWN, NONE = "unknown", "none"
#: Corpus lines and paragraphs in the training sets, at most.
SAMPLE = 2_000
#: Share of held-out license rows that score as high as a hit; words of a piece of a notice.
RECALL, PIECE = 0.99, 6
CONFIRM, NEEDED = 0.6, 0.5


def line_words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), "[^a-z0-9]+"), "")


def _clean(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _grams(df: DataFrame) -> DataFrame:
    """Adds pairs and grams (words, pairs and triples) of the column words."""
    df = NGram(n=2, inputCol="words", outputCol="pairs").transform(df)
    return NGram(n=3, inputCol="words", outputCol="triples").transform(df).withColumn("grams", F.concat("words", "pairs", "triples")).drop("triples")


def _template_words() -> list[tuple[str, list[str]]]:
    return [(family, _clean(t)) for family, texts in TEMPLATES.items() for t in texts]


def _counter(sizes: tuple[int, ...], column: str) -> CountVectorizerModel:
    """Marks the words (pairs, triples) of notices and near misses; all others are as common among licenses as elsewhere."""
    texts = [w for _, w in _template_words()] + [_clean(t) for t in OTHERS + NEAR_MISSES]
    grams = {" ".join(w[i : i + n]) for w in texts for n in sizes for i in range(len(w) - n + 1)}
    grams -= set(COMMON)
    return CountVectorizerModel.from_vocabulary(sorted(grams), inputCol=column, outputCol="features").setBinary(True)


def _examples() -> list[tuple[str, list[str], bool]]:
    """Family, words, and whether the row is held out: notices whole, without a word, cut, and thinned."""
    rows = []
    for family, words in [*_template_words(), *((UNKNOWN, _clean(t)) for t in OTHERS)]:
        shorter = [words[:i] + words[i + 1 :] for i in range(len(words))] if len(words) > 4 else []
        cuts = [words[: -(-len(words) * 3 // 4)], words[len(words) // 4 :]] if len(words) > 8 else []
        # a notice too short to be cut weighs as much as the variants of another
        rows += [(family, words, False)] * (3 if shorter else 12) + [(family, w, i % 4 == 3) for i, w in enumerate(shorter + cuts)]
        # every other word alone: without its pairs, single words have to tell; no template would confirm these
        rows += [(UNKNOWN, words[k::2], False) for k in (0, 1) if len(words) > 12]
    rows += [(NONE, _clean(t)[k::2], False) for t in NEAR_MISSES for k in (0, 1)]
    return rows + [(NONE, _clean(t), i % 4 == 3) for i, t in enumerate(NEAR_MISSES * 4)]


def _rows(spark: SparkSession, rows: list[tuple[str, list[str], bool]]) -> DataFrame:
    """A few hundred rows, as the lines of one literal."""
    text = "\n".join("\t".join((family, " ".join(words), str(held))) for family, words, held in rows)
    cells = spark.range(1).select(F.explode(F.split(F.lit(text), "\n")).alias("row")).select(F.split("row", "\t").alias("c"))
    return cells.select(F.get("c", F.lit(0)).alias("family"), F.split(F.get("c", F.lit(1)), " ").alias("words"), (F.get("c", F.lit(2)) == "True").alias("held"))


def template_share(pairs: Column, family: Column) -> Column:
    """The largest share of a template's word pairs that the paragraph has."""
    out = F.lit(0.0)
    for name in TEMPLATES:
        shares = []
        for _, words in (x for x in _template_words() if x[0] == name):
            own = sorted(set(_pairs(words)))
            shares.append(F.size(F.array_intersect(pairs, F.array(*map(F.lit, own)))) / len(own))
        out = F.when(family == name, F.greatest(F.lit(0.0), *shares)).otherwise(out)
    return out


def _like_a_license(words: str) -> Column:
    """Whether corpus rows (words, pairs) may be licenses themselves: no examples of what isn't."""
    like = reduce(F.greatest, [template_share(F.col("pairs"), F.lit(n)) for n in TEMPLATES])
    return (like >= 0.3) | F.exists(words, lambda w: w.startswith("licen") | w.isin("spdx", "copyright", "warranty"))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line") != "").withColumn("h", F.xxhash64("line"))


class LineGate:
    """Scores lines by their single words; trained on notices and on different lines of a corpus."""

    def __init__(self, docs: DataFrame, sample: int = SAMPLE, recall: float = RECALL):
        spark = docs.sparkSession
        # hashes alone are made distinct: lines themselves are read for the few that are chosen
        chosen = _lines(docs).select("h").distinct().orderBy("h").limit(sample)
        own = _lines(docs).join(F.broadcast(settle(chosen, "chosen")), "h").groupBy("h").agg(F.min("line").alias("line"))
        own = _grams(own.withColumn("words", line_words(F.col("line")))).filter(~_like_a_license("words"))
        own = own.select(F.lit(NONE).alias("family"), "words", (F.col("h") % 4 == 0).alias("held"))
        examples = _examples()
        notices = [(f, w) for f, w, held in examples if f != NONE and not held and len(w) > 2 * PIECE]
        pieces = [(f, w[i : i + PIECE]) for f, w in notices for i in range(0, len(w) - PIECE // 2, PIECE)]
        pieces = [(f, w, i % 4 == 3) for i, (f, w) in enumerate(pieces) if not set(w) <= set(COMMON)]
        known = _rows(spark, examples + pieces).unionByName(own)
        self.counts = _counter((1,), "words")
        rows = settle(self.counts.transform(known).withColumn("label", (F.col("family") != NONE).cast("double")), "gate")
        sizes = {r["label"]: r["n"] for r in rows.filter("not held").groupBy("label").agg(F.count("*").alias("n")).collect()}
        weight = F.when(F.col("label") == 1, 1.0 / sizes[1.0]).otherwise(1.0 / sizes[0.0]) * 1000
        fit = LogisticRegression(weightCol="weight", regParam=1e-2, maxIter=60).fit(rows.filter("not held").withColumn("weight", weight))
        self.model = fit.setProbabilityCol("").setPredictionCol("")
        held = [r["score"] for r in self.score(rows.filter("held and label = 1").drop("features")).select("score").collect()]  # a few hundred rows
        self.cut = float(np.quantile(held, 1 - recall, method="lower"))

    def score(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(self.counts.transform(rows)).withColumn("score", F.get(vector_to_array("rawPrediction"), F.lit(1)))
        return scored.drop("features", "rawPrediction")


def paragraphs(docs: DataFrame, gate: LineGate) -> DataFrame:
    """doc_id, paragraph (number of its first line, from 0), lines (how many it spans), text, words, pairs, grams."""
    # equal rows are told apart by where they stand in the scan, before lines are shuffled by document
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split("text", "\n").alias("lines"))
    cells = F.transform("lines", lambda x, i: F.struct(i.alias("n"), x.alias("line"), F.get("lines", i - 1).alias("before")))
    lines = rows.select("doc_id", "row", F.explode(cells).alias("c")).select("doc_id", "row", "c.*").filter(F.col("line") != "")
    scored = gate.score(lines.withColumn("words", line_words(F.col("line"))))
    hits = settle(scored.filter(F.col("score") >= gate.cut).select("doc_id", "row", "n", "line", "before"), "hits")
    order = Window.partitionBy("row").orderBy("n")
    gap = F.col("n") - F.lag("n").over(order)
    runs = hits.withColumn("gap", gap).withColumn("run", F.sum(F.coalesce((F.col("gap") > 2).cast("int"), F.lit(1))).over(order))
    piece = F.when(F.col("gap") == 2, F.concat_ws(" ", "before", "line")).otherwise(F.col("line"))
    joined = runs.groupBy("doc_id", "row", "run").agg(F.array_sort(F.collect_list(F.struct("n", piece.alias("line")))).alias("l"))
    first, last = F.get("l.n", F.lit(0)), F.element_at("l.n", -1)
    joined = joined.select("doc_id", first.alias("paragraph"), (last - first + 1).alias("lines"), F.array_join("l.line", " ").alias("text"))
    return _grams(joined.withColumn("words", line_words(F.col("text"))))


class LicenceModel:
    """Trained on the notices and on different paragraphs of a corpus."""

    def __init__(self, found: DataFrame, sample: int = SAMPLE):
        spark = found.sparkSession
        self.names = [*TEMPLATES, UNKNOWN, NONE]
        own = found.select("words", F.xxhash64("words").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(sample)
        own = _grams(own).filter(~_like_a_license("words")).select(F.lit(NONE).alias("family"), "words", (F.col("h") % 4 == 0).alias("held"))
        rows = _grams(settle(_rows(spark, _examples()).unionByName(own), "examples"))
        self.counts = _counter((1, 2, 3), "grams")
        number = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(self.names) for x in (n, float(i))]), F.col("family"))
        rows = self.counts.transform(rows).withColumn("label", number)
        # each family weighs the same, other licenses half as much as all families, and what is none as much as all of them
        sizes = {r["family"]: r["n"] for r in rows.filter("not held").groupBy("family").agg(F.count("*").alias("n")).collect()}
        shares = {UNKNOWN: len(TEMPLATES) / 2, NONE: 1.0 * len(TEMPLATES)}
        weight = F.element_at(F.create_map(*[F.lit(x) for n, c in sizes.items() for x in (n, 100 * shares.get(n, 1.0) / c)]), F.col("family"))
        self.model = LogisticRegression(family="multinomial", weightCol="weight", regParam=4e-3, maxIter=80).fit(rows.filter("not held").withColumn("weight", weight))
        self.temperature = self._calibrate(rows.filter("held"))

    def _calibrate(self, held: DataFrame) -> float:
        """The temperature of the least cross-entropy, classes weighing as in training; held: a few hundred rows."""
        rows = self.model.transform(held).select("label", vector_to_array("rawPrediction").alias("raw")).collect()
        raw, label = np.array([r["raw"] for r in rows]), np.array([int(r["label"]) for r in rows])
        weight = np.where(label == len(self.names) - 1, len(self.names) - 1.0, 1.0) / np.bincount(label, minlength=len(self.names))[label]

        def loss(t: float) -> float:
            z = raw / t
            z -= z.max(axis=1, keepdims=True)
            return float(weight @ (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), label]))

        return float(min(np.geomspace(0.1, 10, 41), key=loss))

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds the calibrated probability of being a license, the likeliest license class and its probability."""
        out = self.model.transform(self.counts.transform(rows)).withColumn("z", vector_to_array("rawPrediction")).drop("probability", "prediction", "rawPrediction", "features")
        e = F.transform("z", lambda x: F.exp((x - F.array_max("z")) / self.temperature))
        out = out.withColumn("e", e).withColumn("p", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, y: s + y)))
        licences = F.slice("p", 1, len(self.names) - 1)
        best = F.array_max(licences)
        name = F.element_at(F.array(*map(F.lit, self.names)), F.array_position(licences, best).cast("int"))
        return out.withColumns({"is_license": 1 - F.element_at("p", -1), "probability": best, "family": name}).drop("z", "e", "p")


def scan(docs: DataFrame, sample: int = SAMPLE, confirm: float = CONFIRM, needed: float = NEEDED, recall: float = RECALL) -> DataFrame:
    """doc_id, paragraph, lines, family, probability, is_license, template_share, text: a row for each license paragraph."""
    docs = docs.select("doc_id", "text")
    found = settle(paragraphs(docs, LineGate(docs, sample, recall)), "paragraphs")
    rows = LicenceModel(found, sample).predict(found).filter(F.col("is_license") >= needed)
    rows = rows.withColumn("template_share", template_share(F.col("pairs"), F.col("family")))
    family = F.when(F.col("template_share") >= confirm, F.col("family")).otherwise(UNKNOWN)
    return rows.select("doc_id", "paragraph", "lines", family.alias("family"), "probability", "is_license", "template_share", "text")
