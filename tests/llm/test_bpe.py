import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearth.llm import bpe as B
from hearth.llm.q_bpe import op7_bpe
from hearth.session import table
from helpers import CLASHES, ODD, docs, prose


def brute(text, tok):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), digest(np.array(ids, "<u4").tobytes()), digest(tok.decode(ids, skip_special_tokens=False).encode())


def tokenizer():
    tok = Tokenizer.from_file(B.vocabulary_path())
    tok.no_truncation()
    tok.no_padding()
    return tok


def digests(frame):
    return {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in B.encode(frame).collect()}


def test_query_equals_the_library(spark, sf):
    tok = tokenizer()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op7_bpe(spark, sf).collect()}
    assert got == {r["doc_id"]: brute(r["text"], tok) for r in table(spark, sf, "documents").collect()}


def test_shared_chunks_and_odd_texts(spark):
    tok, rng = tokenizer(), random.Random(3)
    passage = prose(7, 900)
    odd = "".join(rng.choice([" ", "\n", "\t", "a", "é", "汉", "🙂", "'s", "1", "  ", "\x00", "<|endoftext|>"]) for _ in range(4000))
    texts = [*ODD, passage, "Start. " + passage + " end", odd, "x" + odd + passage, passage * 3, "no spaces " + "y" * 9000 + passage, "y" * 9000, " " * 1_000_000 + "x"]
    got = digests(docs(spark, texts).withColumns({c: F.lit(1) for c in CLASHES}))
    assert got == {i: brute(t, tok) for i, t in enumerate(texts)}
    assert B.encode(docs(spark, [])).count() == 0


def test_chunks_follow_the_content():
    passage = prose(9, 3000).encode()
    own, shifted = B.chunks(passage), B.chunks(b"some words before " + passage)
    assert b"".join(own) == passage and len(set(own) & set(shifted)) >= len(own) - 2


def test_fast_encoder_equals_the_library():
    """All characters, between letters, digits, blanks and signs; and random rows of the vocabulary's tokens."""
    tok, path, rng = tokenizer(), B.vocabulary_path(), random.Random(1)
    assert B._fast(path)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c} {c}!{c}\n{c}{c}b  {c}" for c in chars[::7]] + [f"a{c} {c}" for c in chars[:70_000]]
    tokens = [t.decode("utf-8", "ignore") for t in B._token_bytes(path)]
    texts += ["".join(rng.choices(tokens, k=40)) for _ in range(3000)]
    want = tok.encode_batch(texts, add_special_tokens=False)
    assert all(a.tolist() == b.ids for a, b in zip(B.encode_texts([t.encode() for t in texts], path), want))
    other = Tokenizer.from_file(B.vocabulary_path("word_bpe_49k.json")).encode("Some words", add_special_tokens=False).ids
    assert B.encode_texts([b"Some words"], B.vocabulary_path("word_bpe_49k.json"))[0].tolist() == other


def test_added_tokens_with_blanks_are_refused(tmp_path):
    import json

    import pytest

    path = tmp_path / "v.json"
    path.write_text(json.dumps({"added_tokens": [{"content": "<a b>", "id": 0}]}))
    with pytest.raises(ValueError):
        B.checked(str(path))
    assert B.checked(B.vocabulary_path()) == B.vocabulary_path()


def test_a_passage_in_most_texts(spark):
    passage = prose(3, 900)
    texts = [prose(50 + i, 40) + " " + passage + " " + prose(90 + i, 40) for i in range(12)]
    tok = tokenizer()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in B.encode(docs(spark, texts)).collect()}
    assert got == {i: brute(t, tok) for i, t in enumerate(texts)}
