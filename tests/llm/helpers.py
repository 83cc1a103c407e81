"""Fixtures of the training-data operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    """documents rows: texts, or (doc_id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], DOCS)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


#: Columns that the operators use inside, here as columns of the input.
CLASHES = ["tkey", "words", "fp", "h", "g", "label", "seq", "leaf", "cell", "k", "n", "key", "start", "gram", "context"]
ODD = [None, "", "   ", "one", "two words", "ÄÖ ü ñ 汉字 🙂", "a\x00b\tc\n\nd", "x" * 5000, "same text twice here", "same text twice here"]
