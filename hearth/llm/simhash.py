"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has a bit set if it is set in over half of its shingles' hashes. Fingerprints link at `radius` or
fewer differing bits. Different fingerprints are dealt into cells: with six blocks of bits, two fingerprints that
differ in three bits agree on three whole blocks, so every link lies in a cell of equal blocks. In a cell each
fingerprint has a table of Hamming distances to reference fingerprints (pivots). As a distance changes by at most the
number of differing bits, a pair whose tables differ by more than the radius in any coordinate is discarded; survivors
are verified. Cells of many fingerprints are compared in pairs of bounded chunks, and each task gives a spanning
forest of its links, never all pairs.

`deduplicate` also finds texts of a given similarity (the Jaccard coefficient of their sets of shingles), which differ
in too many bits for blocks to agree: there the cells are bands of minima of the shingles' hashes (a pair of similarity
0.8 shares one of the 12 with a chance of 0.998). There the tables count each set's hashes in buckets: as the counts of
two sets differ by no more than the sets do, a pair whose counts differ too much for the similarity is discarded, and
no similar pair is. Survivors are verified by their whole sets of shingles.

Null and empty texts have fingerprint zero and link with each other. Null doc_ids get the component's smallest doc_id.
Very long texts are hashed whole, in parts. Repeated rows get equal results; an empty table gives none; other columns are ignored by `near_duplicates` and kept by
`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.llm.bitmap import bitmap, may_hold
from hearth.llm.components import components
from hearth.session import settle

PIVOTS = 32
CHUNK = 512
#: Bands and minima in a band; buckets in which a set's hashes are counted, and how many of them go into a coarse one.
BANDS, BAND_ROWS, SKETCH, COARSE = 12, 4, 1024, 16
_TURNS = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 9) | 1 for i in range(BANDS * BAND_ROWS)], dtype=np.uint64)


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, "<u8")
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    return np.array([digest(line[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[part : part + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64-bit fingerprint."""
    hashes = shingle_hashes(text, shingle)
    return majority(hashes) if len(hashes) else 0


def sketch(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """Band keys of a set of shingles, and its hashes (32 bits each, sorted)."""
    if not len(hashes):
        return [], b""
    least = np.full(len(_TURNS), np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[part : part + 4096, None] * _TURNS).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist(), np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes()


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard coefficient of two sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def bucket_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes of each set lie in each bucket."""
    counts = np.zeros((len(sets), SKETCH), np.int32)
    for row, own in zip(counts, sets):
        row[:] = np.bincount(own % SKETCH, minlength=SKETCH)
    return counts


def differing(counts: np.ndarray, a: np.ndarray, b: np.ndarray, part: int = 2048) -> np.ndarray:
    """Sum of the differences of counts for each pair of rows: at most the number of hashes that one of both sets lacks."""
    return np.concatenate([np.abs(counts[a[i : i + part]] - counts[b[i : i + part]]).sum(axis=1) for i in range(0, len(a), part)] or [np.empty(0, np.int64)])


def fingerprint_udf(shingle: int):
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return of


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed, spread over all bits."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 7) for i in range(count)], dtype=np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def local_roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of count nodes the smallest node linked with it."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_in_cells(cell: np.ndarray, fps: np.ndarray, refs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by cell -> spanning links (fingerprint, root) among the rows of equal cells."""
    table = distance_table(fps, refs)
    found_a, found_b = [], []
    at, step = np.arange(len(fps)), 1
    while True:
        at = at[at + step < len(fps)]
        at = at[cell[at] == cell[at + step]]
        if not len(at):
            break
        left = at
        for part in range(0, len(refs), 8):  # discard by the largest coordinate difference, some coordinates at a time
            left = left[np.abs(table[left, part : part + 8] - table[left + step, part : part + 8]).max(axis=1, initial=0) <= radius]
        left = left[np.bitwise_count(fps[left] ^ fps[left + step]) <= radius]
        found_a.append(left)
        found_b.append(left + step)
        step += 1
    if not found_a:
        return fps[:0], fps[:0]
    root = local_roots(len(fps), np.concatenate(found_a), np.concatenate(found_b))
    child = np.flatnonzero(root != np.arange(len(fps)))
    return fps[child], fps[root[child]]


def similar_in_cells(cell: np.ndarray, fps: np.ndarray, sets: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """As links_in_cells, for pairs whose sets are similar; pairs that are connected already aren't verified."""
    own = [np.frombuffer(s, "<u4") for s in sets]
    fine = bucket_counts(own)
    coarse = fine.reshape(len(own), -1, COARSE).sum(axis=2, dtype=np.int32)
    sizes, root = np.array([len(s) for s in own]), np.arange(len(fps))
    at, step, found = np.arange(len(fps)), 1, []
    while True:
        at = at[at + step < len(fps)]
        at = at[cell[at] == cell[at + step]]
        if not len(at):
            break
        left = at[root[at] != root[at + step]]
        for counts in (sizes[:, None], coarse, fine):  # sets of n and m members and the similarity s differ in at most (n + m)(1 - s) / (1 + s)
            most = (sizes[left] + sizes[left + step]) * (1 - similarity) / (1 + similarity)
            left = left[differing(counts, left, left + step) <= most + 1e-6]
        new = [i for i in left.tolist() if similarity_of(own[i], own[i + step]) >= similarity]
        if new:
            found += [(i, i + step) for i in new]
            root = local_roots(len(fps), *np.array(found).T)
        step += 1
    child = np.flatnonzero(root != np.arange(len(fps)))
    return fps[child], fps[root[child]]


def _similar_batches(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None

        def linked(rows: pa.Table):
            a, b = similar_in_cells(rows["cell"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["shingles"].to_pylist(), similarity)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([kept, rows]) if kept else rows
            cell = rows["cell"].to_numpy()
            last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on in the next batch
            if last:
                yield linked(rows.slice(0, last))
            kept = rows.slice(last)
        if kept:
            yield linked(kept)

    return run


def _link_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, kept_cell, kept_fp = pivots(), np.empty(0, np.int64), np.empty(0, np.int64)

        def linked(cell, fp):
            a, b = links_in_cells(cell, fp.view(np.uint64), refs, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cell = np.concatenate((kept_cell, batch.column("cell").to_numpy()))
            fp = np.concatenate((kept_fp, batch.column("fp").to_numpy()))
            last = np.searchsorted(cell, cell[-1]) if len(cell) else 0  # the last cell may go on in the next batch
            kept_cell, kept_fp = cell[last:].copy(), fp[last:].copy()
            if last:
                yield linked(cell[:last], fp[:last])
        if len(kept_cell):
            yield linked(kept_cell, kept_fp)

    return run


def link(prints: DataFrame, radius: int = 3, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Different fingerprints (fp) -> links (a, b) with the components of all pairs within the radius."""
    blocks = blocks or 2 * radius
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(sum(masks[j] for j in c))))) for i, c in enumerate(combinations(range(blocks), blocks - radius))]
    rows = chunked_cells(prints.select("fp", F.explode(F.array(*keys)).alias("key")), chunk)
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_link_batches(radius), "a long, b long").distinct()


def chunked_cells(cells: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key, fp and others -> cell and the rest: keys of several rows, those of many as pairs of bounded chunks."""
    shared = cells.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
    rows = cells.join(shared, "key").withColumn("own", F.pmod(F.xxhash64(*[c for c in cells.columns if c != "key"], F.lit(1)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("cell", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).drop("key", "n", "parts", "own", "other")


def _sets_of(bits: Broadcast, shingle: int):
    """Sets of shingles of the texts whose hash may be asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, told = np.frombuffer(bits.value, np.uint8), set()
        for batch in batches:
            out = {}
            hashes = batch.column("h").to_numpy()
            for at in np.flatnonzero(may_hold(own, hashes)).tolist():
                if hashes[at] not in told:
                    told.add(hashes[at])
                    shingles = sketch(shingle_hashes(batch.column("text")[at].as_py(), shingle))[1]
                    out[text_number(shingles)] = shingles
            if len(told) > 1 << 18:
                told.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["text_no", "shingles"])

    return run


def similar(docs: DataFrame, slim: DataFrame, shingle: int, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) of fingerprints of similar texts; slim: h (the text's hash), fp, text_no and bands of docs.

    Sets of shingles are made again for the texts in shared cells, so that those of all texts are never shuffled.
    """
    texts = slim.groupBy("fp", "text_no").agg(F.first("bands").alias("bands"))
    rows = settle(chunked_cells(texts.select("fp", "text_no", F.explode("bands").alias("key")), chunk), "cells")
    asked = slim.select("text_no", "h").join(rows.select("text_no").distinct(), "text_no", "left_semi").groupBy("text_no").agg(F.min("h").alias("h"))
    sets = docs.select("text", F.xxhash64("text").alias("h")).mapInArrow(_sets_of(bitmap(asked.select("h")), shingle), "text_no long, shingles binary")
    rows = rows.join(sets.groupBy("text_no").agg(F.first("shingles").alias("shingles")), "text_no").select("cell", "fp", "shingles")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_similar_batches(similarity), "a long, b long").distinct()


def group(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Rows with doc_id and fp -> fp, component_id (the smallest doc_id that links reach)."""
    each = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("d")), "prints")
    roots = components(link(each.select("fp"), radius)).withColumnRenamed("node", "fp")
    each = each.join(roots, "fp", "left").select("fp", "d", F.coalesce("root", "fp").alias("root"))
    return each.join(each.groupBy("root").agg(F.min("d").alias("component_id")), "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id."""
    prints = settle(docs.select("doc_id", fingerprint_udf(shingle)("text").alias("fp")), "fingerprints")
    return prints.join(group(prints, radius), "fp").select("doc_id", "fp", "component_id")


def text_number(shingles: bytes) -> int:
    return xxhash.xxh3_64_intdigest(shingles) - (1 << 63)


def sketch_udf(shingle: int):
    @F.pandas_udf("fp long, text_no long, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        def one(text):
            hashes = shingle_hashes(text, shingle)
            bands, shingles = sketch(hashes)
            return np.array(majority(hashes) if len(hashes) else 0, np.uint64).view(np.int64), text_number(shingles), bands

        return pd.DataFrame([one(t) for t in texts], columns=["fp", "text_no", "bands"])

    return of


def deduplicate(docs: DataFrame, shingle: int = 5, radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """One document of each component stays, with all its columns: that of the smallest doc_id (null last).

    Links: fingerprints within the radius, and texts of the similarity.
    """
    k = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("h")]
    slim = settle(docs.select(*k, sketch_udf(shingle)("text").alias("s")).select("none", "doc_id", "h", "s.*"), "fingerprinted")
    each = slim.groupBy("fp").agg(F.min(F.struct("none", "doc_id", "h")).alias("k"))
    links = link(each.select("fp"), radius).unionByName(similar(docs, slim, shingle, similarity))
    roots = components(links).withColumnRenamed("node", "fp")
    best = each.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("k").alias("k")).select("k.*")
    names = [f"__hearth_{n}" for n in ("none", "doc_id", "h")]
    rows = docs.withColumns(dict(zip(names, k))).join(best.toDF(*names), names)
    return rows.dropDuplicates(names).select(*docs.columns)  # equal rows: one of them stays
