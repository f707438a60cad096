"""Byte-level BPE against the tiktoken library, and back."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from faultline.llm import bpe
from faultline.llm.queries import RANKS


@pytest.fixture(scope="module")
def reference():
    with open(P.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(P.path(RANKS), P.PATTERN)


def check(codec, reference, texts):
    ids, borders = codec.encode(pa.array(texts, pa.string()))
    data, ends = codec.decode(ids, borders)
    for k, t in enumerate(texts):
        assert ids[borders[k] : borders[k + 1]].tolist() == reference.encode_ordinary(t or "")
        assert data[ends[k] : ends[k + 1]].tobytes() == (t or "").encode()


def test_every_character(codec, reference):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    check(codec, reference, ["".join(chars[i : i + 7]) for i in range(0, len(chars), 7)])


def test_spaces_shortenings_and_split_characters(codec, reference):
    pick = random.Random(1)
    parts = list(" \t\n\r\x0b\x0c\x1c\x85  　'’aZé9٣日👍-_") + ["'s", "'LL", "  ", " \n", "<|endoftext|>", "don't"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 25))) for _ in range(20_000)]
    check(codec, reference, texts + ["", None, "a" * 3000, " " * 500, "👍" * 500])


def test_offsets(codec):
    texts = ["naïve 👍🏽 日本", None, "", "ab"]
    ids, borders = codec.encode(pa.array(texts))
    start, end = codec.offsets(ids, borders)
    for k, t in enumerate(texts):
        spans = list(zip(start[borders[k] : borders[k + 1]], end[borders[k] : borders[k + 1]]))
        data = (t or "").encode()
        at = 0
        for (a, b), i in zip(spans, ids[borders[k] : borders[k + 1]]):
            piece = codec.table[codec.at[i] : codec.at[i + 1]].tobytes()
            assert t[a:b].encode().find(piece) >= 0 and b - a <= len(piece)
            assert len(t[:a].encode()) <= at < len(t[:b].encode())
            at += len(piece)
        assert at == len(data)


def test_table(make_docs, codec, reference, spark):
    texts = ["one", None, "", "one", "long " * 50_000]
    df = make_docs(texts).withColumnRenamed("source", "bpe_n")
    out = bpe.encode_decode(df, "text", P.path(RANKS), P.PATTERN, offsets=True)
    assert out.columns == ["doc_id", "text", "lang", "n_chars", "bpe_ids", "bpe_n", "bpe_text", "bpe_starts", "bpe_ends"]
    for r in out.collect():
        want = reference.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(r.bpe_ids, "<u4").tolist() == want and r.bpe_n == len(want) == len(r.bpe_starts)
        assert r.bpe_text == (texts[r.doc_id] or "").encode()
    assert bpe.encode_decode(make_docs([]), "text", P.path(RANKS), P.PATTERN).collect() == []
