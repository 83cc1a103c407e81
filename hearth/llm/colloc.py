"""Collocations: phrases whose words occur together more often than their parts would by chance.

Phrases of 1 to `longest` words are counted exactly, by the phrases themselves. A phrase is counted only where both of
its parts that are one word shorter are frequent, which no frequent phrase can do without: words first, then pairs, then
longer ones over those runs of words whose neighbours are frequent pairs. Whether a part is frequent is asked of a
bitmap of bounded size, whose wrong answers cost a count but never change one.

The counts of frequent phrases are then kept as two streams: in prefix order (by first word, then second, and so on) and
in suffix order (by last word, then the one before it). In prefix order a phrase comes after its own beginnings, so one
pass with a stack gives each phrase the counts of all its beginnings (left counts), and each phrase the most frequent
phrase of one more word (extension count). The suffix stream gives the counts of all its ends (right counts) and the
extensions to the left. A merge join of the two, sorted by phrase, brings them together. The streams are dealt in ranges
of their order; a range is sent copies of the beginnings of its first phrase, so no word is bound to one task.

A phrase that is part of a longer one as often as it occurs at all is dropped: it is enough to look at extensions by one
word, since the phrases between it and the longer one are then as frequent. Counts are 64-bit, scores exact.

Null texts are empty ones; null languages are "und". Rows count as they stand, also repeated ones and those without a
doc_id. Empty texts and pieces have no words. Very long texts are counted whole. Ties in score go to the more frequent,
then to the phrase that is less by its bytes. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.llm.bitmap import bitmap, may_hold, room
from hearth.llm.ranges import firsts
from hearth.session import settle

#: Bytes of text of one language that are gone through at once.
CHUNK = 8 << 20
#: Parts in which the first phrases of a language are found before those of the parts are put together.
SALTS = 64
_BLANKS, _BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.array([1 if b in _BLANKS else 2 if b in _BREAKS else 0 for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_FACTOR = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


class Words:
    """The words of a chunk: number in the dictionary, and whether the next word is in the same piece."""

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        kind = _KIND[data]
        word = kind == 0
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        chars = pa.py_buffer(_LOWER[data[word]])
        coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), chars]).dictionary_encode()
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.names, self.ids, self.joined = coded.dictionary, coded.indices.to_numpy().astype(np.int64), piece[1:] == piece[:-1]

    def starts(self, n: int) -> np.ndarray:
        """Where n words of one piece begin."""
        count = len(self.ids) - n + 1
        ok = np.ones(max(0, count), bool)
        for j in range(n - 1):
            ok &= self.joined[j : j + count] if count > 0 else ok
        return np.flatnonzero(ok)

    def frequent(self, lang: str, n: int, bits: np.ndarray) -> np.ndarray:
        """For each word, whether the n words from it on are one piece's and may be a frequent phrase."""
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.names.to_pylist()], np.uint64)
        at = self.starts(n)
        total = np.full(len(at), xxhash.xxh64_intdigest(lang), np.uint64)
        for j in range(n):
            total = total * np.uint64(_FACTOR) + own[self.ids[at + j]]
        out = np.zeros(len(self.ids) + 1, bool)
        out[at] = may_hold(bits, (total ^ (total >> np.uint64(32))).view(np.int64))
        return out

    def counts(self, at: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
        """Phrases of n words that begin at the given places, and how often."""
        code = self.ids[at]
        for j in range(1, n):
            code = np.unique(code * len(self.names) + self.ids[at + j], return_inverse=True)[1]
        _, first, often = np.unique(code, return_index=True, return_counts=True)
        parts = [self.names.take(pa.array(self.ids[at[first] + j])) for j in range(n)]
        return (parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")), often

    def runs(self, pair: np.ndarray) -> str:
        """Stretches of three or more words whose neighbours are pairs, as pieces."""
        linked = pair[:-1]
        begins = np.flatnonzero(linked & ~np.concatenate(([False], linked[:-1])))
        ends = np.flatnonzero(linked & ~np.concatenate((linked[1:], [False]))) + 2
        begins, ends = begins[ends - begins > 2], ends[ends - begins > 2]
        sizes = ends - begins
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        at = np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[-1])
        words = pa.ListArray.from_arrays(pa.array(offsets), self.names.take(pa.array(self.ids[at])))
        return "\n".join(pc.binary_join(words, " ").to_pylist())


def phrase_hash(lang: str, phrase: str) -> int:
    """The same as Words.frequent asks for, signed."""
    total = xxhash.xxh64_intdigest(lang)
    for word in phrase.split(" "):
        total = (total * _FACTOR + xxhash.xxh64_intdigest(word)) & _ALL
    total ^= total >> 32
    return total - (1 << 64) if total >> 63 else total


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    open_texts, sizes = {}, {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            open_texts.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            if sizes[lang] >= CHUNK or sum(sizes.values()) >= 4 * CHUNK:
                for done in [lang] if sizes[lang] >= CHUNK else list(sizes):
                    sizes.pop(done)
                    yield done, Words(b"\n".join(open_texts.pop(done)))
    for lang, texts in open_texts.items():
        yield lang, Words(b"\n".join(texts))


def _count_rows(n: int, bits: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for lang, words in _chunks(batches):
            at = words.starts(n)
            if own is not None and len(at):
                part = words.frequent(lang, n - 1, own)
                at = at[part[at] & part[at + 1]]
            if len(at):
                phrases, often = words.counts(at, n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(often), pa.string()), phrases, pa.array(often, pa.int64())], names=["lang", "phrase", "f"])

    return run


def _run_rows(bits: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(bits.value, np.uint8)
        for lang, words in _chunks(batches):
            text = words.runs(words.frequent(lang, 2, own))
            if text:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([text])], names=["lang", "text"])

    return run


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [phrase_hash(*row) for row in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64())], names=["h"])


def _map_of(phrases: DataFrame) -> Broadcast:
    return bitmap(phrases.select("lang", "phrase").mapInArrow(_hash_rows, "h long"), room(phrases.count()))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beginnings and extensions of phrases, which come in order of their words, by range and language."""
    stack: list[list] = []  # words, count, most frequent extension
    at = None
    out: list[list] = [[], [], [], [], []]

    def leave(depth: int) -> None:
        while len(stack) > depth:
            words, f, most = stack.pop()
            if words[1:]:
                for column, value in zip(out, (at[1], words, f, [entry[1] for entry in stack], most)):
                    column.append(value)

    def flush() -> pa.RecordBatch:
        kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64())
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["lang", "words", "f", "parts", "longer"])
        for column in out:
            column.clear()
        return made

    for batch in batches:
        for own, lang, words, f in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "words", "f"))):
            if (own, lang) != at:
                leave(0)
                at = (own, lang)
            leave(next((i for i, entry in enumerate(stack) if words[: i + 1] != entry[0]), len(stack)))
            if stack:
                stack[-1][2] = max(stack[-1][2], f)
            stack.append([words, f, 0])
        yield flush()
    leave(0)
    yield flush()


def stream(phrases: DataFrame, words: Column, ranges: int | None = None) -> DataFrame:
    """lang, words, f, parts (counts of the first 1, 2, ... words), longer (most frequent phrase of one more word).

    phrases: lang, phrase, f, with all beginnings of each phrase; words: those of the phrase in the stream's order.
    """
    rows = phrases.select("lang", words.alias("words"), "f")
    heads = firsts(rows.select("lang", "words"), ranges)
    begins: dict[tuple, list[int]] = {}
    for i, (lang, own) in enumerate(heads):
        for n in range(1, len(own)):
            begins.setdefault((lang, *own[:n]), []).append(i)

    @F.pandas_udf("array<int>")
    def cells(lang: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for key in zip(lang, map(list, words)):
            own = bisect_right(heads, key) - 1
            out.append([own, *(i for i in begins.get((key[0], *key[1]), ()) if i != own)])
        return pd.Series(out)

    parts = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("*", F.explode(cells("lang", "words")).alias("range")).repartition(parts, "range")
    found = dealt.sortWithinPartitions("range", "lang", "words").mapInArrow(_scan, "lang string, words array<string>, f long, parts array<long>, longer long")
    # a phrase that was copied has extensions in several ranges
    return found.groupBy("lang", "words").agg(F.max("f").alias("f"), F.max("parts").alias("parts"), F.max("longer").alias("longer"))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to `longest` words with f >= least, and (lang, n) with the words in all."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    add = lambda source, n, bits: source.mapInArrow(_count_rows(n, bits), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = settle(add(texts, 1, None), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    last = words.filter(F.col("f") >= least)
    found, source = last, texts
    for n in range(2, longest + 1):
        bits = _map_of(last)
        if n == 3:
            source = settle(texts.mapInArrow(_run_rows(bits), "lang string, text string"), "runs")
        last = settle(add(source, n, bits).filter(F.col("f") >= least), "phrases")
        found = found.unionByName(last)
    return found, totals


def scores(pairs: Column, a: str, n: str) -> Column:
    """The lowest (score, cut) of the cuts (l, r): floor(1000 a n / (l r)), in decimals of 38 digits."""
    exact = lambda c: c.cast("decimal(19,0)")
    above = (exact(F.col(a) * 1000) * exact(F.col(n))).cast("decimal(38,0)")
    below = lambda p: (exact(p["l"]) * exact(p["r"])).cast("decimal(38,0)")
    return F.array_min(F.transform(pairs, lambda p, i: F.struct(F.call_function("div", above, below(p)).alias("score"), i.alias("cut"), p["l"].alias("l"), p["r"].alias("r"))))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, ranges: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut (words before the cut): each language's first phrases by score."""
    phrases, totals = frequent_phrases(docs, least, longest)
    words = F.split("phrase", " ")
    phrase = lambda w: F.array_join(w, " ").alias("phrase")
    ahead = stream(phrases, words, ranges).select("lang", phrase("words"), F.col("f").alias("a"), "parts", "longer")
    back = stream(phrases, F.reverse(words), ranges).select("lang", phrase(F.reverse("words")), F.reverse("parts").alias("ends"), F.col("longer").alias("longer_back"))
    both = ahead.join(back.hint("merge"), ["lang", "phrase"]).filter(F.greatest("longer", "longer_back") < F.col("a")).join(totals, "lang")
    cuts = F.transform(F.arrays_zip("parts", "ends"), lambda p: F.struct(p["parts"].alias("l"), p["ends"].alias("r")))
    scored = both.select("lang", "phrase", "a", "n", scores(cuts, "a", "n").alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score", (F.col("s.cut") + 1).alias("cut"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("rank") <= first).drop("rank", "salt")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
