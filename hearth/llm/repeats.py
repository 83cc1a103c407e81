"""Exact repeats of `length` or more bytes, by interval trees over enhanced suffix arrays.

Anchors are positions that are picked by content: of any length - gram + 1 neighbouring positions, that (or those, in
a tie) whose `gram` following bytes have the least hash. Equal strings of `length` bytes hold the same anchors at the
same places, so every repeat is found among the occurrences of one anchor's gram. Grams that occur once are dropped.

An anchor's context is what stands before and after its gram, in reach. A context that occurs twice repeats as a
whole. The different contexts of a gram are gathered by gram, once each. Their suffixes are sorted; a stack scan over
the common prefixes of neighbours gives the interval tree. In each interval the left contexts are sorted and scanned
likewise: members that differ in the byte to the left (left-extension diversity) part into intervals of their own. An
interval of both that spans `length` bytes and isn't inside one child is a maximal repeat (in reach of its anchor);
it is given with all its occurrences, and what is removed is what these groups cover.

A gram with more than `most` different contexts isn't gathered in one task: its strings of `length` bytes around the
anchor are counted by gram and hash, spread over the cluster. That covers the same bytes; the groups that it gives are
the repeated strings of `length` bytes, each with all its occurrences.

Null and empty texts have no bytes. Matches never go across texts. Texts that occur more than once repeat as a whole,
if they have `length` bytes. Overlapping occurrences count. Very long texts are hashed in blocks and cut whole. Ties
of hashes are all anchors. An empty table gives no rows. Repeated rows and null doc_ids are documents like any other.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.bitmap import bitmap, may_hold
from hearth.session import settle

LENGTH, GRAM = 400, 200
#: Different contexts of one gram that one task takes: about 100 MB.
MOST = 100_000
#: Keys that have over a HOT_KEYS-th of all rows are joined by broadcast: there are fewer than HOT_KEYS of them.
HOT_KEYS = 1_000
_MIX = np.array([xxhash.xxh64_intdigest(bytes([b]), 3) for b in range(256)], dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 16


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _BLOCK + 8192), _powers(_INVERSE, _BLOCK + 8192)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the bytes [i, i + gram) for each i; equal strings have equal hashes."""
    count = len(raw) - gram + 1
    out = np.empty(max(0, count), np.uint64)
    for at in range(0, count, _BLOCK):
        part = _MIX[raw[at : at + _BLOCK + gram - 1]]
        total = np.cumsum(part * _UP[: len(part)], dtype=np.uint64)
        own = total[gram - 1 :].copy()
        own[1:] -= total[: len(own) - 1]
        own *= _DOWN[: len(own)]
        own ^= own >> np.uint64(29)
        own *= np.uint64(0xBF58476D1CE4E5B9)
        own ^= own >> np.uint64(32)
        out[at : at + len(own)] = own
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    count = len(x) - width + 1
    size = -(-len(x) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a text's anchors."""
    if len(raw) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = length - gram + 1
    hashes = gram_hashes(raw, gram)
    least = _sliding_min(hashes, width)
    # a position is an anchor if it is the least of a window that holds it: the largest of its windows' least
    edge = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    top = ~_sliding_min(~edge, width)
    at = np.flatnonzero(hashes == top)
    return at, hashes[at].view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """A few texts at a time: what is made of them is many times their size."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1024):
            grams, places = [], []
            for key, text in zip(batch.column("tkey").to_pylist(), batch.column("text").to_pylist()):
                at, hashes = anchors(np.frombuffer(text.encode(), np.uint8), length, gram)
                grams.append(hashes)
                places.append(at ^ np.frombuffer(key[:8], "<i8"))
            one = pa.table({"gram": np.concatenate(grams or [np.empty(0, np.int64)]), "place": np.concatenate(places or [np.empty(0, np.int64)])})
            one = one.group_by("gram").aggregate([("place", "min"), ("place", "max")])  # of this batch; Spark goes on
            yield from one.select(["gram", "place_min", "place_max"]).rename_columns(["gram", "low", "high"]).to_batches()

    return run


def _name(data: bytes, a: int, gram: int, reach: int) -> tuple[int, int, int, int]:
    """Hashes of the gram and of the anchor's context, and the bytes of the context before and behind the gram."""
    start = max(0, a - reach)
    whole = data[start : a + gram + reach]
    lead = a - start
    return xxhash.xxh3_64_intdigest(data[a : a + gram]) - (1 << 63), xxhash.xxh3_64_intdigest(whole, lead) - (1 << 63), lead, len(whole) - lead - gram


def _marked(batch: pa.RecordBatch, own: np.ndarray, length: int, gram: int, by_place: bool) -> Iterator[tuple[bytes, bytes, int, int]]:
    """Text's key and bytes, position and place of the anchors whose gram (or place) may be in the map; a text once."""
    done = set()
    for key, text in zip(batch.column("tkey").to_pylist(), batch.column("text").to_pylist()):
        if key in done:
            continue
        done.add(key)
        data = text.encode()
        at, hashes = anchors(np.frombuffer(data, np.uint8), length, gram)
        if len(at):
            places = at ^ np.frombuffer(key[:8], "<i8")
            ok = may_hold(own, places if by_place else hashes)
            for a, place in zip(at[ok].tolist(), places[ok].tolist()):
                yield key, data, a, place


def _place_rows(bits, length: int, gram: int):
    """A row for each anchor of a repeated gram."""
    kinds = (pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(bits.value, np.uint8)
        for batch in _slices(batches):
            rows = [(*_name(data, a, gram, length - gram), key, a, place) for key, data, a, place in _marked(batch, own, length, gram, False)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=["gram", "context", "lead", "tail", "tkey", "at", "place"])

    return run


def _context_rows(places, hot, length: int, gram: int, want_hot: bool):
    """The bytes of the contexts at the given places, of hot grams or of the others."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, many, told = np.frombuffer(places.value, np.uint8), np.frombuffer(hot.value, np.uint8), set()
        for batch in _slices(batches):
            rows = []
            if len(told) > 1 << 17:
                told.clear()
            for _, data, a, _ in _marked(batch, own, length, gram, True):
                name, context, lead, _ = _name(data, a, gram, length - gram)
                if (name, context) not in told and bool(may_hold(many, np.array([name]))[0]) == want_hot:
                    told.add((name, context))
                    rows.append((name, context, data[a - lead : a], data[a + gram : a + length]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds)], names=["gram", "context", "before", "after"])

    return run


def _matrix(strings: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer(b"".join(s.ljust(reach, b"\0") for s in strings), np.uint8).reshape(len(strings), reach), sizes


def _common(rows: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> list[int]:
    """Bytes that each string has in common with the one before it in order."""
    a, b = order[:-1], order[1:]
    differ = rows[a] != rows[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[a], sizes[b])).tolist()


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan: (first, last, common prefix) of each interval of the tree with at least `least` in common."""
    stack: list[tuple[int, int]] = []  # common prefix, first
    for i, c in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > c:
            depth, first = stack.pop()
            yield first, i, depth
        if c >= least and (not stack or stack[-1][0] < c):
            stack.append((c, first))


def maximal_repeats(before: list[bytes], after: list[bytes], reach: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Bytes to the left and right of the anchor, and members (indices) of each maximal repeat with `reach` outside it."""
    left, left_sizes = _matrix([b[::-1] for b in before], reach)
    right, right_sizes = _matrix(after, reach)
    order = np.array(sorted(range(len(after)), key=after.__getitem__))
    rank_left, child = np.empty((2, len(before)), np.int64)
    rank_left[sorted(range(len(before)), key=lambda i: before[i][::-1])] = np.arange(len(before))
    common = np.array(_common(right, right_sizes, order), np.int64)
    for first, last, depth in intervals(common.tolist(), 0):
        members = order[first : last + 1]
        # the children of the interval: members part where neighbours have just `depth` in common
        child[members] = np.concatenate(([0], np.cumsum(common[first:last] == depth)))
        by_left = members[np.argsort(rank_left[members])]
        for one, two, width in intervals(_common(left, left_sizes, by_left), reach - depth):
            group = by_left[one : two + 1]
            if (child[group] != child[group[0]]).any():
                yield width, depth, group


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Different rows (context, before, after) of one gram after another; the batches are sorted by gram and context."""
    key, rows = None, []
    for batch in _slices(batches, 1024):
        for gram, *row in zip(*(batch.column(c).to_pylist() for c in ("gram", "context", "before", "after"))):
            if gram != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = gram, []
            if not rows or rows[-1][0] != row[0]:
                rows.append(row)
    if len(rows) > 1:
        yield key, rows


def _widest_rows(reach: int):
    """How far the maximal repeats that a context belongs to go to the left and right of the anchor."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [[], [], [], []]

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["gram", "context", "lead", "tail"])
            for column in out:
                column.clear()
            return batch

        for key, rows in _grouped(batches):
            lead, tail = np.full((2, len(rows)), -1)
            for width, depth, group in maximal_repeats([r[1] for r in rows], [r[2] for r in rows], reach):
                lead[group] = np.maximum(lead[group], width)
                tail[group] = np.maximum(tail[group], depth)
            found = np.flatnonzero(lead >= 0)
            for column, values in zip(out, ([key] * len(found), [rows[i][0] for i in found.tolist()], lead[found].tolist(), tail[found].tolist())):
                column += values
            if len(out[0]) > 4096:
                yield flush()
        yield flush()

    return run


def _repeat_rows(gram: int, reach: int):
    """One row for each maximal repeat, with its contexts in a list."""
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _grouped(batches):
            found = maximal_repeats([r[1] for r in rows], [r[2] for r in rows], reach)
            out = [(key, f"{key}#{i}", width + gram + depth, width, [rows[m][0] for m in group.tolist()]) for i, (width, depth, group) in enumerate(found)]
            for start in range(0, len(out), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[start : start + 1024]), kinds)], names=["gram", "repeat", "bytes", "lead", "contexts"])

    return run


def _window_rows(reach: int):
    """For grams with very many contexts: a hash of each string of `length` bytes that holds the gram."""
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for key, context, before, after in zip(*(batch.column(c).to_pylist() for c in ("gram", "context", "before", "after"))):
                for lead in range(max(0, reach - len(after)), min(reach, len(before)) + 1):
                    digest = xxhash.xxh3_128_digest(lead.to_bytes(4, "little") + before[len(before) - lead :] + after[: reach - lead])
                    rows.append((key, digest, context, lead, reach - lead))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=["gram", "window", "context", "lead", "tail"])

    return run


def keyed_texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.unhex(F.md5(text)).alias("tkey"), text.alias("text"))


class Repeats:
    """Anchors of repeated grams and their contexts, and what is found among them."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST):
        self.gram, self.reach = gram, length - gram
        texts = keyed_texts(docs)
        seen = texts.mapInArrow(_anchor_rows(length, gram), "gram long, low long, high long").groupBy("gram").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        bits = bitmap(seen.filter("low < high").select("gram"))
        schema = "gram long, context long, lead short, tail short, tkey binary, at int, place long"
        self.places = settle(texts.mapInArrow(_place_rows(bits, length, gram), schema), "places")
        of = self.places.groupBy("gram", "context").agg(F.count("*").alias("rows"), F.min("place").alias("low"), F.max("place").alias("high"), F.first("lead").alias("lead"), F.first("tail").alias("tail"))
        # copies of a text give the same places
        whole = (F.col("low") < F.col("high")) & (F.col("lead") + F.col("tail") >= self.reach)
        self.contexts = settle(of.select("gram", "context", "rows", F.col("low").alias("place"), "lead", "tail", whole.alias("whole")), "contexts")
        # a gram whose contexts all repeat as a whole needs no tree
        several = self.contexts.groupBy("gram").agg(F.count("*").alias("n"), F.every("whole").alias("done")).filter("n > 1 and not done").drop("done")
        self.wanted = bitmap(self.contexts.join(several.select("gram"), "gram", "left_semi").select("place"))
        hot = settle(several.filter(F.col("n") > most).select("gram"), "hot")
        self.any_hot, self.hot = not hot.isEmpty(), bitmap(hot)
        self.bytes_of = lambda want_hot: texts.mapInArrow(_context_rows(self.wanted, self.hot, length, gram, want_hot), "gram long, context long, before binary, after binary")

    def _cells(self) -> DataFrame:
        return self.bytes_of(False).repartition("gram").sortWithinPartitions("gram", "context")

    def _windows(self) -> DataFrame:
        """Repeated strings of `length` bytes of the hot grams, by context."""
        schema = "gram long, window binary, context long, lead int, tail int"
        rows = self.bytes_of(True).dropDuplicates(["gram", "context"]).mapInArrow(_window_rows(self.reach), schema)
        often = rows.groupBy("gram", "window").agg(F.count("*").alias("n")).filter("n > 1")
        return rows.join(often.select("gram", "window"), ["gram", "window"])

    def groups(self) -> DataFrame:
        """Maximal repeats: gram, repeat, bytes, lead, context; a row for each context."""
        trees = self._cells().mapInArrow(_repeat_rows(self.gram, self.reach), "gram long, repeat string, bytes int, lead int, contexts array<long>")
        trees = trees.select("gram", "repeat", "bytes", "lead", F.explode("contexts").alias("context"))
        size = (F.lit(self.gram) + F.col("lead") + F.col("tail")).cast("int").alias("bytes")
        name = lambda *parts: F.concat_ws(":", "gram", *parts).alias("repeat")
        out = trees.unionByName(self.contexts.filter("whole").select("gram", name("context"), size, F.col("lead").cast("int").alias("lead"), "context"))
        if self.any_hot:
            out = out.unionByName(self._windows().select("gram", name(F.lit("w"), F.hex("window")), size, "lead", "context"))
        return out

    def occurrences(self) -> DataFrame:
        """repeat, bytes, tkey, at: a row for each occurrence of a repeat in a text."""
        places = self.places.select("gram", "context", "tkey", "at").distinct()
        return self.groups().join(places, ["gram", "context"]).select("repeat", "bytes", "tkey", (F.col("at") - F.col("lead")).alias("at"))

    def spans(self) -> DataFrame:
        """tkey, at, until: the bytes around each anchor that the groups cover."""
        widest = self._cells().mapInArrow(_widest_rows(self.reach), "gram long, context long, lead int, tail int")
        if self.any_hot:
            widest = widest.unionByName(self._windows().select("gram", "context", "lead", "tail"))
        widest = widest.unionByName(self.contexts.filter("whole").select("gram", "context", F.col("lead").cast("int"), F.col("tail").cast("int")))
        widest = settle(widest.groupBy("gram", "context").agg(F.max("lead").alias("lead"), F.max("tail").alias("tail")), "widest")
        places, key = self.places.select("gram", "context", "tkey", "at"), ["gram", "context"]
        total = self.contexts.agg(F.sum("rows")).first()[0] or 0
        hot = F.broadcast(self.contexts.filter(F.col("rows") * HOT_KEYS > total).select(*key))
        own = F.broadcast(widest.join(hot, key))
        found = places.join(hot, key, "left_anti").join(widest, key).unionByName(places.join(own, key))
        return found.select("tkey", (F.col("at") - F.col("lead")).alias("at"), (F.col("at") + self.gram + F.col("tail")).alias("until"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        cols = [[], [], [], [], []]
        for doc_id, text, ats, untils in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ats", "untils"))):
            data, kept, end, removed, runs = text.encode(), [], 0, 0, 0
            for at, until in sorted(zip(ats or (), untils or ())):
                if at > end or not runs:
                    kept.append(data[end:at])
                    runs += 1
                    end = at
                if until > end:
                    removed += until - end
                    end = until
            kept.append(data[end:])
            for col, value in zip(cols, (doc_id, len(data), removed, runs, b"".join(kept))):
                col.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    merged = Repeats(docs, length, gram, most).spans().groupBy("tkey").agg(F.collect_set(F.struct("at", "until")).alias("s"))
    merged = merged.select("tkey", F.col("s.at").alias("ats"), F.col("s.until").alias("untils"))
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(text))
    keyed = docs.select(F.col("doc_id").cast("long"), key.alias("tkey"), text.alias("text"))
    size = F.octet_length(text)
    copies = settle(docs.groupBy(key.alias("tkey"), size.alias("size")).agg(F.count("*").alias("n")).filter("n > 1"), "copies")
    total = copies.agg(F.sum("n")).first()[0] or 0
    hot = copies.filter(F.col("n") * HOT_KEYS > total)
    whole = lambda rows: rows.filter(F.col("size") >= length).select("tkey", F.array(F.lit(0)).alias("ats"), F.array("size").alias("untils"))
    cuts = merged.join(copies, "tkey", "left_anti").unionByName(whole(copies))
    often = keyed.join(F.broadcast(hot.select("tkey")), "tkey", "left_semi").join(F.broadcast(whole(hot)), "tkey", "left")
    rest = keyed.join(F.broadcast(hot.select("tkey")), "tkey", "left_anti")
    short = rest.filter(F.octet_length("text") < length).withColumns({c: F.lit(None).cast("array<int>") for c in ("ats", "untils")})
    found = rest.filter(F.octet_length("text") >= length).join(cuts, "tkey", "left").unionByName(short).unionByName(often)
    return found.select("doc_id", "text", "ats", "untils").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
