"""Encoding and decoding against the tokenizers library."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sparkwarden.llm import bpe
from sparkwarden.llm.vocabulary import vocab_path
from tokenizers import Tokenizer

EDGE = [None, "", " ", "\n", "  a", "a  ", "'s", " 's", "\n's", "don't I'll we've", "''s", "<|endoftext|>", "a <|endoftext|>  b", "<|endoftext|><|endoftext|>",
        "é中👍", "٣²½", "\x00\x1f\x85", "ꟊ Ᲊ", "aaaa" * 50, "word " * 3000]


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(vocab_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocab_path())


def agree(vocab, library, texts):
    ids, bounds = vocab.encode(texts)
    decoded = vocab.decode(ids, bounds)
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[bounds[i]: bounds[i + 1]].tolist() == want, text
        assert decoded[i].decode() == library.decode(want, skip_special_tokens=False)


def test_edge_cases(vocab, library):
    agree(vocab, library, EDGE)


def test_mixed_pieces(vocab, library):
    r = random.Random(7)
    pieces = ["'", "'s", "'re", "s", "t", " ", "  ", "\n", "\t", "a", "Z", "1", "é", "中", "👍", "̀", "²", "<|endoftext|>", "<|", "!!", "don't", "ll"]
    agree(vocab, library, ["".join(r.choices(pieces, k=r.randint(0, 14))) for _ in range(4000)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(vocab, library, texts):
    agree(vocab, library, texts)


def test_forgetting_words_changes_nothing(vocab):
    texts = ["some words and other words", "again some"]
    first = vocab.encode(texts)
    vocab.forget()
    assert all(np.array_equal(a, b) for a, b in zip(first, vocab.encode(texts), strict=True))


def test_frames(spark, library):
    df = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(EDGE)] + [(1, "", [9])], "doc_id long, text string, ids array<int>")
    back = bpe.decode(bpe.encode(df, vocab_path()), vocab_path()).collect()
    assert len(back) == len(EDGE) + 1 and all(r.decoded == (r.text or "") for r in back)
    for r in bpe.digests(df, vocab_path(), ["doc_id"]).collect():
        ids = library.encode(EDGE[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert bpe.encode(df.limit(0), vocab_path()).count() == 0


def test_a_worker_holds_little_beside_its_vocabulary(spark, monkeypatch):
    """A batch of four million characters is encoded in pieces; a worker stands beside an executor that is nearly full."""
    df = spark.createDataFrame([(0, "")], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: f)
    run = bpe.digests(df, vocab_path(), ["doc_id"], with_ids=True)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "__text": [" ".join(rng.choices(words, k=570)) for _ in range(1000)]})
    bpe.vocabulary(vocab_path())
    tracemalloc.start()
    try:
        assert sum(len(out) for out in run(iter([batch]))) == 1000
        assert tracemalloc.get_traced_memory()[1] < 30e6
    finally:
        tracemalloc.stop()
