import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = P.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
CHUNKS = packing.ChunkTokenizer(open(PATH, "rb").read())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sStTJÉéßñ09a!.,&\u030c\x1c\x85İΣक़")), max_size=60))
def test_ids_of_whole_texts(text):
    assert np.frombuffer(CHUNKS.encode([text])[0], "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_special_strings_in_texts():
    for text in ("a <|endoftext|> b", "x<|startoftext|>y <|", "<| <|endoftext|"):
        assert np.frombuffer(CHUNKS.encode([text])[0], "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_sum_of_squares(sizes):
    sizes = np.sort(np.array(sizes, np.int64))[::-1]
    bins, offsets, gaps = packing.sum_of_squares(sizes, 64)
    count = {}
    for b, o, s in zip(bins.tolist(), offsets.tolist(), sizes.tolist(), strict=True):
        assert count.get(b, 0) == o
        fits = {64 - used for used in count.values() if 0 < 64 - used and 64 - used >= s}
        if o == 0:
            assert not fits
        else:  # no other gap leaves a smaller sum of squares
            total = lambda c: sum(n * n for n in np.unique([64 - u for u in c.values() if u < 64], return_counts=True)[1].tolist())
            after = {g: total(count | {next(k for k, u in count.items() if 64 - u == g): 64 - g + s}) for g in fits}
            assert after[64 - o] == min(after.values())
        count[b] = o + s
    assert all(64 - count[b] == g for b, g in enumerate(gaps.tolist()))


def test_pack(spark):
    rows = [(i, "word " * (i * 7 % 90) if i % 11 else None) for i in range(300)] + [(5, "again"), (5, "again"), (None, "no id"), (900, "long text " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS piece", "1 AS sequence_id")
    pieces = packing.token_pieces(docs, PATH, 64, keep_ids=True)
    got = packing.pack(pieces, 64).collect()
    whole = {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        whole.setdefault(r.doc_id, []).append(r)
    for key, text in rows:
        ids = [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]
        if key not in (5, None):
            own = sorted(whole[key], key=lambda r: r.piece)
            assert [x for r in own for x in r.ids] == ids and [r.start for r in own] == [64 * k for k in range(len(own))]
            assert all(r.length == 64 for r in own[:-1])
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 64) * 1.03 + 2
    assert packing.pack(packing.token_pieces(docs.where("false"), PATH, 64), 64).collect() == []
