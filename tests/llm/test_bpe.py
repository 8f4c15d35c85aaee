"""Token ids against the tokenizer library, and exact round trips."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken

from corpuslab.llm import bpe
from corpuslab.llm.queries import vocabulary

TEXTS = [
    None, "", " ", "\n\n  x", "Hello world, it's 12345!", "a" * 5000, "ab" * 3000, "日本語テキスト" * 40, "\u0000\u0001 x", "<|endoftext|> z",
    "🙂" * 300, "é" * 200, "tabs\tand\r\nlines  \n", "".join(random.Random(1).choice("abcdeé ") for _ in range(20_000)),
    "".join(random.Random(2).choice("xyzq") for _ in range(30_000)),
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(vocabulary()), special_tokens={})


def test_ids_and_round_trip(spark, library):
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(TEXTS)] + [(1, "", b"y")], "doc_id long, text string, ids binary")
    decoded = bpe.decode(bpe.encode(docs, vocabulary(), public_tokenizers.PATTERN), vocabulary(), public_tokenizers.PATTERN)
    once = bpe.round_trip(docs, vocabulary(), public_tokenizers.PATTERN)
    assert sorted(map(tuple, bpe.digests(once).collect())) == sorted(map(tuple, bpe.digests(decoded).collect()))
    for r in bpe.digests(decoded, keep_ids=True).collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        ids = library.encode_ordinary(TEXTS[r.doc_id] or "")
        assert list(array("I", bytes(r.ids))) == ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(raw).hexdigest()


def test_full_cache_gives_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    codec = bpe.Codec(bpe.read_ranks(vocabulary()), public_tokenizers.PATTERN)
    for text in TEXTS[1:]:
        assert list(array("I", codec.encode(text))) == library.encode_ordinary(text)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, vocabulary(), public_tokenizers.PATTERN).count() == 0
