import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.codec(open(PATH, "rb").read(), P.PATTERN)


def ids(text):
    return np.frombuffer(CODEC.encode_texts([text])[0], "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'stéßñ09a!  \x1c\x85")), max_size=60))
def test_matches_the_library(text):
    assert ids(text) == ENCODING.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode_texts([text])[0]) == text.encode()


@pytest.mark.parametrize("text", ["", "the the the", "a" * 5000, " " * 3000 + "x", "ab" * 700 + "é" * 400, "Ciónmente " * 50])
def test_long_pieces(text):
    assert ids(text) == ENCODING.encode_ordinary(text)


def test_digests(spark):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (1, "Hello wörld")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS n_tokens")
    got = sorted(tuple(r) for r in bpe.digests(docs, PATH, P.PATTERN).collect())
    want = []
    for key, text in rows:
        own = ENCODING.encode_ordinary(text or "")
        want.append((key, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(docs.where("false"), PATH, P.PATTERN).collect() == []
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH)
    assert sorted(r.text for r in back.collect()) == sorted((t or "") for _, t in rows)
