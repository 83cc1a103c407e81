"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed from left to right into phrases: each is the longest phrase so far with one more byte,
and goes into the dictionary. What texts have in common they parse into common phrases, so the resemblance of two
dictionaries (the Jaccard coefficient of the phrase sets) says how well one text would compress the other. A dictionary
is estimated by a minimum-hash signature: phrases are hashed into BINS bins by the upper bits, and a bin keeps its least
hash. The likeness of two signatures is the share of equal bins among those that aren't empty in both.

Dictionaries are tries: an entry is a parent and a byte, and hashes of all phrases of many texts are made at once by
doubling the paths to the root, so the bytes of phrases are never put together.

Null texts are empty ones: no phrases, all bins empty. Two empty signatures have likeness 1, an empty and another one
0. Equal texts have equal fingerprints, whatever rows they stand in. Texts are parsed whole, also very long ones: a
text's dictionary is in memory once, and that of one more text's first half. Rows are compared in descending doc_id
(null last), those with equal doc_id by a hash of the text; which of fully equal rows comes first makes no difference.
Other columns are ignored. An empty table gives no rows; a single row is its own successor.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.ranges import firsts

BINS = 128
_MIX = np.array([xxhash.xxh64_intdigest(bytes([b]), 12) for b in range(256)], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.iinfo(np.uint64).max


def grow(entries: dict[int, int], at: int, data: bytes) -> int:
    """Parse data on from the phrase `at` (0: none begun); entries maps parent and byte to the phrase, 256 * its number."""
    known, last = entries.get, len(entries) << 8
    for byte in data:
        found = known(at | byte)
        if found is None:
            last += 256
            entries[at | byte] = last
            at = 0
        else:
            at = found
    return at


def _numbers(entries: dict[int, int]) -> np.ndarray:
    return np.fromiter(entries, np.int64, len(entries))


def signatures(dictionaries: list[np.ndarray]) -> np.ndarray:
    """A row of BINS numbers for each dictionary (its entries in order): 0 for an empty bin, else 16 bits of its least hash."""
    sizes = np.array([len(d) + 1 for d in dictionaries], np.int64)
    roots = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(sizes)), sizes)
    entries = np.concatenate([np.concatenate(([0], d)) for d in dictionaries] or [np.empty(0, np.int64)])
    parent = (entries >> 8) + roots[own]
    hashes, factor = _MIX[entries & 255], np.full(len(entries), _BASE)
    hashes[roots], factor[roots], parent[roots] = 0, 1, roots
    while (parent != roots[own]).any():  # paths double: as many rounds as the logarithm of the longest phrase
        hashes += hashes[parent] * factor
        factor *= factor[parent]
        parent = parent[parent]
    hashes ^= hashes >> np.uint64(33)
    hashes *= np.uint64(0xFF51AFD7ED558CCD)
    hashes ^= hashes >> np.uint64(29)
    phrase = np.ones(len(entries), bool)
    phrase[roots] = False
    shift = np.uint64(64 - BINS.bit_length() + 1)
    least = np.full(len(sizes) * BINS, _EMPTY)
    np.minimum.at(least, own[phrase] * BINS + (hashes[phrase] >> shift).astype(np.int64), hashes[phrase] << np.uint64(64 - int(shift)))
    kept = (least >> np.uint64(16)) % np.uint64(65535) + np.uint64(1)
    return np.where(least == _EMPTY, 0, kept).astype(np.uint16).reshape(-1, BINS)


def spelled(signature: np.ndarray) -> str:
    """4 hexadecimal digits a bin."""
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard coefficient of the phrase sets of each pair of rows."""
    some = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(some == 0, 1.0, same / np.maximum(some, 1))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        dictionaries = []
        for text in batch.column("text").to_pylist():
            grow(entries := {}, 0, text.encode())
            dictionaries.append(_numbers(entries))
        prints = [spelled(row) for row in signatures(dictionaries)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, dictionaries), pa.int64()), pa.array(prints, pa.string())], names=["doc_id", "n_phrases", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_phrases, fingerprint (4 hexadecimal digits a bin)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_fingerprint_rows, "doc_id long, n_phrases long, fingerprint string")


class _Row:
    """A parsed text, and its dictionary as it was after the first half."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.keep = doc_id, text, len(text) - len(text) // 2
        entries: dict[int, int] = {}
        at = grow(entries, 0, text[: self.keep].encode())
        self.half, self.half_at = entries.copy(), at
        grow(entries, at, text[self.keep :].encode())
        self.entries = _numbers(entries)

    def edited(self, after: str) -> tuple[np.ndarray, str]:
        """Dictionary and digest of the text whose second half is the beginning of another; takes the first half's."""
        other = after[: len(self.text) - self.keep]
        grow(self.half, self.half_at, other.encode())
        found, self.half = _numbers(self.half), {}
        return found, hashlib.sha256((self.text[: self.keep] + other).encode()).hexdigest()


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _successor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in order, the next range's first row (more) after each range's own."""
    last, last_print = None, None
    for batch in _slices(batches):
        pairs, rows = [], []  # (row, its edited dictionary and digest, number of the row after it)
        for doc_id, text, more in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "more"))):
            if more and last is None:
                continue  # a further copy of the next range's first row
            row = _Row(doc_id, text)
            rows.append(row)
            if last is not None:
                pairs.append((last, *last.edited(text), len(rows) - 1))
            last = None if more else row
        if not rows:
            continue
        prints = signatures([r.entries for r in rows])
        number = {id(r): i for i, r in enumerate(rows)}
        if pairs:
            own = np.stack([prints[number[id(r)]] if id(r) in number else last_print for r, *_ in pairs])
            edited = signatures([p[1] for p in pairs])
            near, near_next = likeness(own, edited), likeness(own, prints[[p[3] for p in pairs]])
            columns = ([p[0].doc_id for p in pairs], [len(p[0].text) for p in pairs], [p[2] for p in pairs], [spelled(x) for x in own], [spelled(x) for x in edited], near, near_next)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_SCHEMA.replace(",", "").split()[::2])
        last_print = prints[-1]


def successors(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text and the next document, in descending doc_id (after the last comes the first).

    The edited text has its second half (rounded down) replaced by as many first code points of the next document.
    near_edited, near_next: likeness of the document's fingerprint to theirs. Texts are shuffled once.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").isNull().cast("long").alias("o1"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("o2"), F.xxhash64("text").alias("o3")]
    heads = firsts(known.select(*order))

    @F.pandas_udf("array<int>")
    def ranges(o1: pd.Series, o2: pd.Series, o3: pd.Series) -> pd.Series:
        out = []
        for key in zip(o1, o2, o3):
            own = bisect_right(heads, key) - 1
            out.append([own, (own - 1) % len(heads)] if key == heads[own] else [own])
        return pd.Series(out)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = known.select("doc_id", "text", *order)
    rows = keyed.select("*", F.posexplode(ranges("o1", "o2", "o3")).alias("more", "range"))
    rows = rows.repartition(parts, "range").sortWithinPartitions("range", "more", "o1", "o2", "o3")
    return rows.select("doc_id", "text", (F.col("more") == 1).alias("more")).mapInArrow(_successor_rows, _SCHEMA)
