"""Sum-of-squares packing of whole documents into fixed-length training sequences.

Pieces of a group are taken by falling length. Each goes to the open bin whose choice leaves the least sum, over
residual gaps, of the squared number of open bins with that gap; a bin is opened only where no open one fits. Groups
are packed in parallel; a second round packs the pieces of bins that stayed open, of many groups together, so that
what groups lose at their ends is won back.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written

#: Pieces of a group, about; also the least number of groups.
GROUP_PIECES, LEAST_GROUPS = 16_384, 16
#: Groups whose open bins are packed together in the second round.
MERGED_GROUPS = 64
#: Chunks between white space whose ids a worker remembers.
CACHE = 600_000
#: Letters that are composed and have one small form, then ASCII marks that no pattern of a tokenizer here joins to letters.
PARTS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
END = (0).to_bytes(4, "little")
#: Kinds of bytes: white space, A-Z, a-z, closing marks, and those beyond ASCII.
SPACE, UPPER, LOWER, MARK, WIDE = range(1, 6)
KINDS = np.zeros(256, np.uint8)
KINDS[list(b"\t\n\x0b\x0c\r ")], KINDS[65:91], KINDS[97:123], KINDS[list(b".,;:!?")], KINDS[128:] = SPACE, UPPER, LOWER, MARK, WIDE


class ChunkTokenizer:
    """Ids of whole texts. White space separates tokens and yields none, so the ids of a text are those of its chunks."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = self.words = Tokenizer.from_buffer(data)
        kinds = [n["type"] for n in (json.loads(data)["normalizer"] or {}).get("normalizers", [])]
        if kinds == ["NFC", "Replace", "Lowercase"]:  # which change nothing in words of small composed letters
            self.words = Tokenizer.from_buffer(data)
            self.words.normalizer = None
            self.words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        specials = sorted((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized))
        self.mark, self.mark_id = specials[0] if specials else ("", -1)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}

    def encode_new(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Chunks of Latin letters and closing marks by these two parts, which many share; the rest whole.

        The tokenizer's pattern parts a run of letters from what follows it, and a run of marks is one token for it.
        """
        words, split, rest = set(), {}, []
        for c in chunks:
            if c.isalpha() and c.islower():
                words.add(c)
            elif m := PARTS.fullmatch(c.decode()):
                split[c] = m[1].lower().encode(), m[2].encode()
            else:
                rest.append(c)
        words.update(a for a, _ in split.values())
        ids = self.encode_words(list(words)) | self.encode_chunks([*({b for _, b in split.values()} - {b""}), *rest])
        ids[b""] = b""
        return ids | {c: ids[a] + ids[b] for c, (a, b) in split.items()}

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Runs of small Latin letters in one string, as each ends at a space for the tokenizer's pattern."""
        ids = np.array(self.words.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.int64).astype("<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):  # some word is several for the tokenizer
            return self.encode_chunks(words)
        data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return {w: data[a:b] for w, a, b in zip(words, cuts, cuts[1:], strict=False)}

    def encode_chunks(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Chunks go through the tokenizer in long strings, kept apart by a special token; those that might hold one go alone."""
        out, run, size = {}, [], 0
        lead = self.mark[:2].encode() if self.mark else b""

        def flush() -> None:
            if run:
                ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(x.decode() for x in run)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
                start = 0
                for chunk, end in zip(run, ends.tolist(), strict=True):
                    out[chunk] = ids[start:end].tobytes()
                    start = end + 1
                run.clear()

        for chunk in chunks:
            if not self.mark or lead in chunk:
                out[chunk] = np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()
                continue
            run.append(chunk)
            size += len(chunk)
            if size > 100_000:
                flush()
                size = 0
        flush()
        return out

    def plain(self, texts: list[str]) -> list[bytes]:
        """The texts' bytes with fewer distinct chunks and the same ids: A-Z lowered, a mark between letter and white space set apart.

        The tokenizer composes letters with accents before it lowers them, so a letter before a byte beyond ASCII stays. So
        do slices in which a special token might stand, as case matters there.
        """
        data = [t.encode() for t in texts]
        buffer = b"\n".join([*data, b""])
        if not self.mark or self.mark[:2].encode() in buffer:
            return data
        code = np.frombuffer(buffer, np.uint8)
        kind = KINDS[code]
        after = np.append(kind[1:], 0)
        code = code + np.where((kind == UPPER) & (after != WIDE), np.uint8(32), np.uint8(0))
        apart = np.flatnonzero((kind[1:-1] == MARK) & ((kind[:-2] == LOWER) | (kind[:-2] == UPPER)) & (kind[2:] == SPACE)) + 1
        out = np.insert(code, apart, 32).tobytes()
        ends = np.cumsum([len(x) + 1 for x in data])
        ends += np.searchsorted(apart, ends)
        return [out[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split() for t in self.plain(texts)]  # at ASCII white space; other white space stays for the tokenizer
        seen = set().union(*split)
        new = [c for c in seen if c not in self.cache]
        full = len(self.cache) + len(new) > CACHE
        self.cache.update(self.encode_new(new))
        out = [b"".join(map(self.cache.__getitem__, chunks)) for chunks in split]
        if full:  # frequent chunks came first
            self.cache = dict(islice(self.cache.items(), CACHE // 2))
        return out


_TOKENIZERS: dict[int, ChunkTokenizer] = {}


def _tokenizer(data: bytes) -> ChunkTokenizer:
    key = zlib.crc32(data)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = ChunkTokenizer(data)
    return _TOKENIZERS[key]


def token_pieces(docs: DataFrame, tokenizer_file: str, length: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every whole text: its ids and a final 0, cut only where longer than `length`.

    A null or empty text is one piece of the final 0. Repeated rows yield their pieces each.
    """
    with open(tokenizer_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    step = 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(data.value)
        for batch, texts in text_slices(batches, 1):
            ids = [x + END for x in own.encode(texts)]
            cut = [(i, k, x[k * step : (k + 1) * step]) for i, x in enumerate(ids) for k in range((len(x) + step - 1) // step)]
            rows = pa.array([i for i, _, _ in cut], pa.int64())
            columns = [batch.column(0).take(rows), pa.array([k for _, k, _ in cut], pa.int32()), pa.array([k * length for _, k, _ in cut], pa.int64()), pa.array([len(x) // 4 for _, _, x in cut], pa.int64()), pa.array([zlib.crc32(x) for _, _, x in cut], pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for _, _, x in cut], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each size, taken in the given order, and the gap of each bin."""
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i, size in enumerate(sizes.tolist()):
        fits = np.flatnonzero(count[size:capacity])
        if len(fits):
            # the change of the sum of squares by moving a bin from gap fits + size to gap fits; a full bin isn't open
            change = 2 * np.where(fits > 0, count[fits] + 1, 0) - 2 * count[fits + size] + (fits == 0)
            gap = int(fits[change.argmin()]) + size
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - gap
        gaps[b] = gap - size
        if gap > size:
            count[gap - size] += 1
            open_bins[gap - size].append(b)
    return bins, offsets, np.array(gaps, np.int64)


def _packed(pieces: DataFrame, group: str, capacity: int, high: int) -> DataFrame:
    """Each group's pieces with sequence_id, offset and the gap that their sequence keeps."""
    names = [n for n in pieces.columns if n not in (group, "sequence_id", "offset", "gap")]
    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", sequence_id bigint, offset bigint, gap bigint"
    id_col = names[0]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", id_col, "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, gaps = sum_of_squares(pdf["length"].to_numpy(), capacity)
        first = high + (int(pdf[group].iloc[0]) << 32)
        return pdf[names].assign(sequence_id=first + bins, offset=offsets, gap=gaps[bins])

    return pieces.groupBy(group).applyInPandas(pack, schema)


def pack(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """pieces with sequence_id and offset: gapless from 0 in each sequence, none above the capacity.

    Rows are dealt to groups of about GROUP_PIECES by a hash of id and piece, so no source or copy group shares one. No
    rows yield no sequences. Columns named sequence_id, offset or gap are replaced.
    """
    pieces = written(pieces)
    groups = max(LEAST_GROUPS, -(-pieces.count() // GROUP_PIECES))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "piece", "start", "ids_crc32"), F.lit(groups)))
    once = written(_packed(dealt, "_group", capacity, 0))
    again = once.where("gap > 0").withColumn("_group", F.expr(f"pmod(sequence_id >> 32, {-(-groups // MERGED_GROUPS)})"))
    return once.where("gap = 0").unionByName(_packed(again, "_group", capacity, 1 << 60)).drop("gap")
