"""The registered queries themselves over the smallest tables, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from millrace.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    rows = pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id")
    return {int(k): t or "" for k, t in zip(rows.doc_id, rows.text, strict=True)}


def run(spark, name):
    return getattr(queries, name)(spark, DATA).toPandas()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def held_out(doc_id, of, remainder):
    return zlib.crc32(str(doc_id).encode()) % of == remainder


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def test_op1(spark, docs):
    found = run(spark, "op1_improbable_features").set_index("doc_id")
    ids = sorted(docs, reverse=True)
    assert sorted(found.index) == sorted(docs)
    for at, key in enumerate(ids):
        own, other = docs[key], docs[ids[(at + 1) % len(ids)]]
        half = len(own) // 2
        row = found.loc[key]
        assert row.n_chars == len(own) and row.edited_sha256 == sha((own[: len(own) - half] + other[:half]).encode())
    by_text = found.assign(text=[docs[k] for k in found.index]).groupby("text").fingerprint.nunique()
    assert by_text.max() == 1 and found[["near_edited", "near_next"]].stack().between(0, 1).all()
    assert found.near_edited.mean() > 0.4 > 0.2 > found.near_next.mean()


def test_op2(spark):
    rows = pd.read_parquet(f"{DATA}/embeddings.parquet")
    x = np.floor(256 * np.stack(rows.embedding.to_numpy()).astype(float)).astype(np.int64)
    ids, want = rows.vec_id.to_numpy(), []
    for q in np.flatnonzero(ids % 50 == 0):
        best = sorted((-int(s), int(v)) for s, v in zip(x @ x[q], ids, strict=True) if v != ids[q])[:5]
        want += [(int(ids[q]), rank, v, -s) for rank, (s, v) in enumerate(best, 1)]
    found = run(spark, "op2_cover_tree_top_k")[["query_id", "rank", "vec_id", "score"]]
    assert sorted(map(tuple, found.to_numpy().tolist())) == sorted(want)


def test_op4(spark, docs):
    found = run(spark, "op4_language_masks")
    lang = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id").lang
    assert sorted(found.doc_id) == sorted(docs) and found.score.between(0, 1).all()
    assert [held_out(k, 4, 2) for k in found.doc_id] == found.held_out.tolist()
    bare = [not any(c.isalpha() for c in docs[k]) for k in found.doc_id]
    assert (found.lang_pred[bare] == "und").all() and set(found.lang_pred) <= {*lang.dropna(), "und"}
    judged = found[found.held_out & ~np.array(bare)]
    assert (judged.lang_pred.to_numpy() == lang.loc[judged.doc_id].to_numpy()).mean() > 0.9


def test_op5(spark, docs):
    found = run(spark, "op5_rule_ensemble")
    assert sorted(found.doc_id) == sorted(docs) and found.score.between(0, 1).all()
    assert [held_out(k, 5, 0) for k in found.doc_id] == found.held_out.tolist()
    assert found.predicted.tolist() == (found.score >= 0.3).astype(int).tolist()
    labels = pd.read_parquet(f"{DATA}/labels.parquet").set_index("doc_id").quality
    judged = found[found.held_out & found.doc_id.isin(labels.index)]
    truth = labels.loc[judged.doc_id].to_numpy()
    good, bad = judged.score[truth == 1].to_numpy(), judged.score[truth == 0].to_numpy()
    if len(good) and len(bad):
        assert (np.sign(good[:, None] - bad[None]) / 2 + 0.5).mean() > 0.8


def test_op6(spark, docs):
    found = run(spark, "op6_context_mixing").set_index("doc_id")
    assert sorted(found.index) == sorted(docs)
    tokens = {k: [*words(t), None] for k, t in docs.items()}
    counts = Counter(w for k, own in tokens.items() if not held_out(k, 7, 2) for w in own)
    total, unit = sum(counts.values()), math.log10(sum(counts.values()) + len(counts) + 1)
    for key, own in tokens.items():
        row = found.loc[key]
        known = sum(counts[w] > 0 for w in own)
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held_out(key, 7, 2), len(own), known, total)
        assert row.base_score == pytest.approx(sum(math.log10(counts[w] + 1) - unit for w in own), rel=1e-9)
    assert (found.score < 0).all() and np.isfinite(found.score).all()


def test_op7(spark, docs):
    sets = {}
    for key, text in docs.items():
        own = words(text)
        sets[key] = {tuple(own[i : i + 4]) for i in range(max(1, len(own) - 3))} if own else set()
    up = {k: k for k in docs}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    found = run(spark, "op7_ngram_jaccard")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.itertuples()} == {k: (len(sets[k]), root(k)) for k in docs}


def test_op8(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = run(spark, "op8_sum_of_squares_packing").sort_values(["doc_id", "piece"])
    want = []
    for key, text in sorted(docs.items()):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        parts = [ids[s : s + 2048] for s in range(0, len(ids), 2048)]
        want += [(key, i, 2048 * i, len(p), zlib.crc32(p.tobytes())) for i, p in enumerate(parts)]
    assert list(map(tuple, found[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == want
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 2048
    assert found.sequence_id.nunique() <= math.ceil(found.length.sum() / 2048) + 1


def test_op10(spark, docs):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = run(spark, "op10_byte_bpe").set_index("doc_id")
    assert sorted(found.index) == sorted(docs)
    for key, text in docs.items():
        ids = np.array(plain.encode_ordinary(text), "<u4")
        row = found.loc[key]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(text.encode()))


def test_op3_and_op9_cover_their_tables(spark, docs):
    assert sorted(run(spark, "op9_line_templates").doc_id) == sorted(docs)
    assert len(run(spark, "op3_warc_derivatives")) >= len(pd.read_parquet(f"{DATA}/pages.parquet"))
