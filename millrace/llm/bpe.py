"""Byte-level BPE encoding and decoding in length-bucketed, padded numpy matrices.

Pre-tokens of a batch are deduplicated, bucketed by length and laid out as rows of a padded matrix. In each
round every row merges its leftmost pair of least rank; pair ranks come from a hashed table and rows are
compacted by one cell. Rows without a mergeable pair leave the matrix. Pre-tokens above the widest bucket go
to an exact linked-list encoder, so no length is cut.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_slices

#: Row widths of the matrices.
WIDTHS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128)
#: Cells of one matrix, which bounds its memory.
CELLS = 1 << 20
#: Pre-tokens that a worker remembers.
CACHE = 500_000
NONE = np.int32(2**31 - 1)


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class PairTable:
    """Ranks of adjacent id pairs in an open-addressed table: a pair of ids is the key, the id of the joined bytes the value."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                if left is not None and (right := ranks.get(token[cut:])) is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        self.bits = max(10, int(4 * len(keys) + 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        self.probes, slot = 0, self._slot(keys)
        while len(keys):
            self.probes += 1
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            left = self.keys[slot] != keys
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where a pair doesn't merge. Padding is a negative id."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        pending = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0) & (left >= 0) & (right >= 0))
        for _ in range(self.probes - 1):
            if not len(pending):
                break
            slot[pending] = (slot[pending] + 1) & (len(self.keys) - 1)
            at, key = slot[pending], keys[pending]
            out[pending] = np.where(self.keys[at] == key, self.values[at], NONE)
            pending = pending[(self.keys[at] != key) & (self.keys[at] >= 0)]
        return out


class Codec:
    """Encodes and decodes by a rank table, as a rank-ordered byte-pair tokenizer does."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.pairs = PairTable(ranks)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.cache: dict[str, bytes] = {}

    def merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of each piece; no piece is longer than width."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        cells = np.full((len(pieces), width), -1, np.int32)
        cells[np.arange(width) < sizes[:, None]] = self.first[data]
        rows, out = np.arange(len(pieces)), [None] * len(pieces)
        score = self.pairs.rank(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(len(pieces), -1)
        while len(rows):
            at = score.argmin(axis=1) if score.shape[1] else np.zeros(len(rows), np.int64)
            least = score[np.arange(len(rows)), at] if score.shape[1] else np.full(len(rows), NONE)
            done = least == NONE
            if done.any():
                for row, ids in zip(rows[done].tolist(), cells[done], strict=True):
                    out[row] = ids[ids >= 0]
                rows, cells, score, at, least = rows[~done], cells[~done], score[~done], at[~done], least[~done]
                if not len(rows):
                    break
            r = np.arange(len(rows))
            cells[r, at] = least
            w = cells.shape[1] - 1
            keep = np.arange(w) + (np.arange(w) > at[:, None])
            cells = np.take_along_axis(cells, keep, axis=1)
            if w == 1:
                score = np.empty((len(rows), 0), np.int32)
                continue
            keep = np.arange(w - 1)[None, :] + (np.arange(w - 1) >= at[:, None])
            score = np.take_along_axis(score, np.minimum(keep, w - 1), axis=1)
            before, after = at > 0, at < w - 1
            score[r[before], at[before] - 1] = self.pairs.rank(cells[r[before], at[before] - 1], cells[r[before], at[before]])
            score[r[after], at[after]] = self.pairs.rank(cells[r[after], at[after]], cells[r[after], at[after] + 1])
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one piece of any length: a heap of pairs over a linked list."""
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda a, b: self.ranks.get(self.vocab[ids[a]] + self.vocab[ids[b]])
        scores = self.pairs.rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(score, i, ids[i], ids[i + 1]) for i, score in enumerate(scores) if score != NONE]
        heapq.heapify(heap)
        while heap:
            score, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = score, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (s := rank(a, b)) is not None:
                    heapq.heappush(heap, (s, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            else:
                buckets.setdefault(next((w for w in WIDTHS if len(piece) <= w), 0), []).append(i)
        for width, members in buckets.items():
            if not width:
                for i in members:
                    out[i] = np.array(self.merge_long(pieces[i]), "<u4").tobytes()
                continue
            step = max(1, CELLS // width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part], width), strict=True):
                    out[i] = ids.astype("<u4").tobytes()
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self.pattern.findall(t) for t in texts]
        seen = set().union(*split) if split else set()
        new = sorted(seen - self.cache.keys())
        self.cache.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        out = [b"".join(map(self.cache.__getitem__, pieces)) for pieces in split]
        if len(self.cache) > CACHE:  # frequent pieces came first
            self.cache = dict(islice(self.cache.items(), CACHE // 2))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple, Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """The worker's codec for a rank file; built once."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(parse_ranks(data), pattern)
    return _CODECS[key]


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text; a null or empty text has no ids. Repeated rows are each encoded."""
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>"

    def run(codec: Codec, batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec.encode_texts(texts)]
        return [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]

    return _mapped(docs, id_col, text_col, rank_file, pattern, schema, run)


def decode(encoded: DataFrame, rank_file: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids): the inverse of encode; null ids give null."""
    data = encoded.sparkSession.sparkContext.broadcast(_read(rank_file))
    schema = f"`{id_col}` {dict(encoded.dtypes)[id_col]}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data.value, "x")
        for batch in batches:
            texts = [None if ids is None else own.decode(np.array(ids, "<u4").tobytes()).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text by one encode and decode, without moving the ids.

    A null text counts as empty: no tokens and the digests of no bytes.
    """
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(codec: Codec, batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        ids = codec.encode_texts(texts)
        return [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string())]

    return _mapped(docs, id_col, text_col, rank_file, pattern, schema, run)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _mapped(docs: DataFrame, id_col: str, text_col: str, rank_file: str, pattern: str, schema: str, one) -> DataFrame:
    data = docs.sparkSession.sparkContext.broadcast(_read(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data.value, pattern)
        names = [field.split()[0].strip("`") for field in schema.split(", ")]
        for batch, texts in text_slices(batches, 1):
            yield pa.RecordBatch.from_arrays(one(own, batch, texts), names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
