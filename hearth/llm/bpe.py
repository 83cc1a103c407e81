"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts texts into chunks at places that depend on the bytes around them, so a passage that many texts
share gives the same chunks in all of them. Chunks that occur more than once are encoded once for the whole corpus;
the rest are encoded where they are. A chunk is encoded between its first and last sure cut (a space or line feed after
a printable ASCII character: no pre-token goes across it, and the pre-tokenizer never looks back). At the join of two
chunks what lies between the sure cuts on both sides is encoded again, on through chunks without a sure cut, so
the ids agree exactly with those of the whole text.

A byte-level vocabulary whose ids stand in the order of its merges is encoded by tiktoken, which gives the tokenizers
library's ids in a third of the time; other vocabularies, and texts that tiktoken refuses (millions of blanks in a
row), by the tokenizers library itself.

Null texts are empty texts. Equal texts get equal results. Repeated rows get a row each. An empty table gives no rows. Other
columns are ignored. Very long texts are encoded whole: a text's pieces meet in one task, as its digests need all of
them in order.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.bitmap import bitmap, may_hold
from hearth.session import settle

VOCABULARY = "byte_bpe_50k.json"
MIN_CHUNK, MEAN_BITS = 256, 10
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 11) for b in range(256)], dtype=np.uint32)
FIRST_CUT, LAST_CUT = re.compile(rb"[!-~](?=[ \n])"), re.compile(rb"(?s).*[!-~](?=[ \n])")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: byte-level tokens name bytes by printable characters, the rest of them by 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    out = [b""] * (1 + max([*model["model"]["vocab"].values(), *(x["id"] for x in model["added_tokens"])]))
    for token, i in model["model"]["vocab"].items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    for x in model["added_tokens"]:
        out[x["id"]] = x["content"].encode()
    return out


@lru_cache(maxsize=2)
def _fast(path: str):
    """tiktoken's encoder of the same vocabulary; None where it would not be the same."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, plain = whole["model"], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    in_order = [model["vocab"].get("".join(m)) for m in pairs] == list(range(256, 256 + len(pairs)))
    usual = all(not x[k] for x in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if whole["normalizer"] or {k: whole["pre_tokenizer"].get(k) for k in plain} != plain or not in_order or not usual:
        return None
    added = {x["content"]: x["id"] for x in whole["added_tokens"]}
    ranks = {t: i for i, t in enumerate(_token_bytes(path)) if i not in added.values()}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def encode_texts(texts: list[bytes], path: str) -> list[np.ndarray]:
    """The ids of each text (uint32)."""
    fast, out = _fast(path), []
    for text in texts:
        ids = None
        if fast:
            try:
                ids = fast.encode_to_numpy(text.decode(), allowed_special="all")
            except ValueError:  # its patterns' stack is bounded
                pass
        if ids is None:
            ids = np.array(_tokenizer(path).encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
        out.append(ids)
    return out


def _packed(ids: np.ndarray, path: str) -> bytes:
    return ids.astype("<u2" if len(_token_bytes(path)) <= 1 << 16 else "<u4").tobytes()


def _unpacked(ids: bytes, path: str) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(_token_bytes(path)) <= 1 << 16 else "<u4").astype("<u4")


def decode_ids(ids: np.ndarray, path: str) -> str:
    if _fast(path):
        return b"".join(map(_token_bytes(path).__getitem__, ids.tolist())).decode("utf-8", "replace")
    return _tokenizer(path).decode(ids.tolist(), skip_special_tokens=False)


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks, cut between characters."""
    if len(data) <= 2 * MIN_CHUNK:
        return [data] if data else []
    raw = np.frombuffer(data, np.uint8)
    rolled = GEAR[raw]
    for width in (1, 2, 4, 8):  # a window of 16 bytes
        wider = rolled.copy()
        wider[width:] += rolled[:-width] << np.uint32(width)
        rolled = wider
    out, start = [], 0
    for end in (np.flatnonzero(rolled >> np.uint32(32 - MEAN_BITS) == 0) + 1).tolist():
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if end - start >= MIN_CHUNK and end < len(data):
            out.append(data[start:end])
            start = end
    return [*out, data[start:]]


def sure_cuts(piece: bytes) -> tuple[int, int] | None:
    first = FIRST_CUT.search(piece)
    return (first.end(), LAST_CUT.match(piece).end()) if first else None


def _digests(ids: np.ndarray, path: str) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode_ids(ids, path).encode()).hexdigest()


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [xxhash.xxh3_128_digest(c) for t in batch.column(0).to_pylist() for c in chunks(t.encode())]
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary())], names=["h"])


def _lead(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(h[:8] for h in hashes), ">i8").astype(np.int64)


def _shared(text: bytes, bits: np.ndarray) -> tuple[list[bytes], list[bytes], list[bool]]:
    parts = chunks(text)
    hashes = [xxhash.xxh3_128_digest(c) for c in parts]
    return parts, hashes, may_hold(bits, _lead(hashes)).tolist() if parts else []


def _shared_chunks(bits):
    def run(batches):
        own = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            found = {}
            for t in batch.column(0).to_pylist():
                found |= {h: c for c, h, s in zip(*_shared(t.encode(), own)) if s}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["h", "chunk"])

    return run


PIECE = "tkey binary, seq int, h binary, solid boolean, ids binary, head binary, tail binary"


def _encoded(pieces: list[bytes], path: str) -> list[tuple[bool, bytes | None, bytes, bytes | None]]:
    """solid, ids, head, tail of each piece."""
    cuts = [sure_cuts(p) for p in pieces]
    ids = iter(encode_texts([p[c[0] : c[1]] for p, c in zip(pieces, cuts) if c], path))
    return [(False, _packed(next(ids), path), p[: c[0]], p[c[1] :]) if c else (True, None, p, None) for p, c in zip(pieces, cuts)]


def _encode_chunks(path: str):
    def run(batches):
        for batch in batches:
            cols = list(zip(*_encoded(batch.column("chunk").to_pylist(), path))) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(cols[0], pa.bool_()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["h", "solid", "ids", "head", "tail"])

    return run


def _pieces(bits, path: str):
    """Texts without shared chunks are done here (seq -1, their digests in ids); others give their pieces."""

    def run(batches):
        own = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            rows, alone, done = [], [], set()
            for tkey, text in zip(batch.column("tkey").to_pylist(), batch.column("text").to_pylist()):
                if tkey in done:
                    continue
                done.add(tkey)
                data = text.encode()
                parts, hashes, shared = _shared(data, own)
                if not any(shared):
                    alone.append((tkey, data))
                    continue
                runs: list[tuple[bytes | None, bytes]] = []
                for c, h, s in zip(parts, hashes, shared):
                    if not s and runs and runs[-1][0] is None:
                        runs[-1] = (None, runs[-1][1] + c)
                    else:
                        runs.append((h if s else None, c))
                enc = iter(_encoded([c for h, c in runs if h is None], path))
                rows += [(tkey, i, h, *(next(enc) if h is None else (None, None, None, None))) for i, (h, _) in enumerate(runs)]
            for (tkey, _), ids in zip(alone, encode_texts([d for _, d in alone], path)):
                rows.append((tkey, -1, None, None, json.dumps(_digests(ids, path)).encode(), None, None))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["tkey", "seq", "h", "solid", "ids", "head", "tail"])

    return run


RESULT = "tkey binary, n_tokens long, ids_sha256 string, decoded_sha256 string"


def join_pieces(pieces: list[tuple[bool, bytes | None, bytes, bytes | None]], path: str) -> np.ndarray:
    """The ids of the text that the pieces make up."""
    ids: list[np.ndarray] = []
    open_text = b""
    for solid, inner, head, tail in pieces:
        open_text += head
        if not solid:
            ids += [*encode_texts([open_text], path), _unpacked(inner, path)]
            open_text = tail
    return np.concatenate([*ids, *encode_texts([open_text], path)])


def _assemble(path: str):
    def run(batches):
        key, parts = None, []

        def result(out):
            cols = list(zip(*out)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.string(), pa.string()))], names=["tkey", "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("tkey", "solid", "ids", "head", "tail"))):
                if row[0] != key:
                    if parts:
                        out.append((key, *_digests(join_pieces(parts, path), path)))
                    key, parts = row[0], []
                parts.append(row[1:])
            yield result(out)
        if parts:
            yield result([(key, *_digests(join_pieces(parts, path), path))])

    return run


def checked(path: str) -> str:
    """The path, if no added token goes across a sure cut: none may hold a blank or a line feed."""
    with open(path, encoding="utf-8") as file:
        added = [x["content"] for x in json.load(file)["added_tokens"]]
    if wrong := [x for x in added if re.search(r"[ \n]", x)]:
        raise ValueError(f"added tokens with blanks: {wrong}")
    return path


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = checked(path or vocabulary_path())
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.md5(text)).alias("tkey"), text.alias("text"))
    counts = keyed.select("text").mapInArrow(_hash_chunks, "h binary").groupBy("h").agg(F.count("*").alias("n"))
    bits = bitmap(counts.filter("n > 1").select(F.conv(F.substring(F.hex("h"), 1, 16), 16, -10).cast("long").alias("slot")))
    shared = keyed.select("text").mapInArrow(_shared_chunks(bits), "h binary, chunk binary").groupBy("h").agg(F.first("chunk").alias("chunk"))
    encoded = shared.mapInArrow(_encode_chunks(path), "h binary, solid boolean, ids binary, head binary, tail binary")

    pieces = settle(keyed.select("tkey", "text").mapInArrow(_pieces(bits, path), PIECE), "pieces")
    done = pieces.filter("seq = -1").dropDuplicates(["tkey"]).select("tkey", F.from_json(F.col("ids").cast("string"), "array<string>").alias("d"))
    done = done.select("tkey", F.get("d", F.lit(0)).cast("long").alias("n_tokens"), F.get("d", F.lit(1)).alias("ids_sha256"), F.get("d", F.lit(2)).alias("decoded_sha256"))
    parts = pieces.filter("seq >= 0").dropDuplicates(["tkey", "seq"])
    refs = parts.filter("h is not null").select("tkey", "seq", "h").join(encoded, "h")
    names = ["tkey", "seq", "solid", "ids", "head", "tail"]
    parts = parts.filter("h is null").select(*names).unionByName(refs.select(*names))
    joined = parts.repartition("tkey").sortWithinPartitions("tkey", "seq").mapInArrow(_assemble(path), RESULT)
    return keyed.select("doc_id", "tkey").join(done.unionByName(joined), "tkey").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
