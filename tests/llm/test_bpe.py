"""Token ids against two public libraries, and round trips."""

import base64
import os
import random

import pytest

from hitlore.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary files")
random.seed(1)
TEXTS = [
    "Hello world", "a" * 3000, "ab" * 2000 + " " * 300 + "x", "x\u0085y᠎ z​  a", "日本語テキスト" * 20, " \n\n\t  a  b  ", "<|endoftext|> hi",
    "👩‍🔧🚋 ﬁ ½ Ⅷ ٣", "\r\n\r\n x", "'S 'LL don't we've", "\x00\x01", "   ", "\n", "1234567890" * 40,
]
TEXTS += ["".join(chr(random.choice([random.randrange(32, 127), random.randrange(0x80, 0x3000), random.randrange(0x4E00, 0x4F00), 32, 10])) for _ in range(random.randrange(1, 50))) for _ in range(200)]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(1000, "", "x"), (1001, None, "x"), (None, "a", "x"), (0, TEXTS[0], "x")]
    return bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()


def test_as_the_libraries(got):
    import tiktoken
    from tokenizers import Tokenizer

    import public_tokenizers as P

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    k = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {r.doc_id: r.ids for r in got}
    for i, text in enumerate(TEXTS):
        assert ids[i] == t.encode(text, add_special_tokens=False).ids == k.encode_ordinary(text), repr(text[:50])


def test_defined_cases_and_round_trip(got):
    assert len(got) == len(TEXTS) + 4
    ids = {r.doc_id: r.ids for r in got}
    assert ids[1000] == [] and ids[1001] == [] and len(ids[None]) == 1
    decode = bpe.decoder()
    assert all(decode(ids[i]) == text.encode() for i, text in enumerate(TEXTS))


def test_empty_table_and_kept_columns(spark):
    df = spark.createDataFrame([("k", "b b", 7)], "doc_id string, text string, source int")
    assert bpe.encode(df, keep=("source",)).collect()[0].asDict() == {"doc_id": "k", "source": 7, "ids": bpe.encode(df).first().ids}
    assert bpe.encode(df.limit(0)).count() == 0


def test_memory_of_pieces_is_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "KEPT", 10)
    encoder = bpe.Encoder(bpe.Merges.load())
    for i in range(30):
        encoder.encode(pa.array([f"w{i}", f"x{i}", "same"]))
        assert len(encoder.known) <= 13


def test_long_pieces_one_by_one_are_those_of_rows():
    import numpy as np

    rng, merges = random.Random(2), bpe.Merges.load()
    letters = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(700))
    for piece in (b"a" * 999, b"aaab" * 300, b"hahaha" * 100 + b"xy", letters, bytes(rng.randrange(256) for _ in range(600)), ("über" * 150).encode(), b"ab"):
        width = max(2, 1 << (len(piece) - 1).bit_length())
        assert np.array_equal(bpe._encode_long(piece, width, merges), bpe._encode_rows([piece], width, merges)[0])
