"""Improbable-feature digests of documents.

Every byte window of a text is ranked by how rare its entropy is in the corpus. A window that is the leftmost rarest of
many neighbourhoods is a feature; features fill a chain of Bloom filters, and two digests are compared by their bit
overlap, normalised by what chance gives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_partitions, text_slices

#: Bytes of a window; windows of a neighbourhood; neighbourhoods that a feature must lead.
WINDOW, SPAN, LEAST_LED = 32, 32, 8
#: Bits of a filter, features it takes, bits a feature sets.
BITS, FEATURES, HASHES = 2048, 160, 5
#: Classes of entropy.
CLASSES = 512
#: Windows under this entropy in bits are ranked behind all others.
LEAST_ENTROPY = 1.5

_C = np.arange(WINDOW + 1)
_F = np.rint(np.where(_C > 0, _C * np.log2(np.maximum(_C, 1)), 0) * 4096).astype(np.int64)
_G = np.diff(_F).astype(np.int32)  # what one more equal byte adds


def _layout(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts, short ones padded to a window; each text's start and number of windows."""
    padded = [x if len(x) >= WINDOW or not x else x.ljust(WINDOW, b"\0") for x in data]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    return np.frombuffer(b"".join(padded), np.uint8), np.cumsum(sizes) - sizes, np.where(sizes > 0, sizes - WINDOW + 1, 0)


def _entropy_classes(buffer: np.ndarray) -> np.ndarray:
    """The entropy class of the window at each place: 0 the highest entropy, CLASSES - 1 a run of one byte."""
    n = len(buffer)
    if n < WINDOW:
        return np.empty(0, np.int64)
    entered, left = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    block = 1 << 16
    for start in range(0, n, block):  # a block stays in the processor's cache
        end = min(n, start + block)
        for d in range(1, min(WINDOW, n)):
            a, b = max(start, d), end
            if a < b:
                same = buffer[a:b] == buffer[a - d : b - d]
                entered[a:b] += same
                left[a - d : b - d] += same
    total = np.cumsum(_G[entered], dtype=np.int64)
    total[WINDOW:] -= np.cumsum(_G[left], dtype=np.int64)[:-WINDOW]
    return total[WINDOW - 1 :] * (CLASSES - 1) // _F[WINDOW]


def _places(starts: np.ndarray, windows: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows in the buffer, and in a layout that has `gap` cells between texts."""
    first = np.cumsum(windows) - windows
    within = np.arange(windows.sum()) - np.repeat(first, windows)
    return within + np.repeat(starts, windows), within + np.repeat(first + gap * np.arange(1, len(windows) + 1), windows)


def class_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many windows of all texts have each entropy class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for _, texts in text_slices(batches, 0):
            buffer, starts, windows = _layout([t.encode() for t in texts])
            at, _ = _places(starts, windows, 0)
            total += np.bincount(_entropy_classes(buffer)[at], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(total)], ["class", "n"])

    rows = docs.select(text_col).mapInArrow(run, "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CLASSES, np.int64)
    for r in rows:
        out[r["class"]] = r["n"]
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy class: 0 the rarest. Windows of low entropy come behind all others."""
    entropy = np.log2(WINDOW) - np.arange(CLASSES) * _F[WINDOW] / (CLASSES - 1) / 4096 / WINDOW
    order = np.lexsort((np.arange(CLASSES), counts, entropy < LEAST_ENTROPY))
    out = np.empty(CLASSES, np.int64)
    out[order] = np.arange(CLASSES)
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def digest(texts: list[str], ranks: np.ndarray) -> list[np.ndarray]:
    """The filters of each text, uint8 of shape (filters, BITS // 8); none for an empty text, else one at least."""
    buffer, starts, windows = _layout([t.encode() for t in texts])
    if not windows.sum():
        return [np.empty((0, BITS // 8), np.uint8)] * len(texts)
    at, cell = _places(starts, windows, SPAN - 1)
    keys = np.full(windows.sum() + (SPAN - 1) * (len(windows) + 1), np.iinfo(np.int64).max)
    keys[cell] = ranks[_entropy_classes(buffer)[at]] << 40 | np.arange(len(at))
    width = 1
    while width < SPAN:  # the least key of each neighbourhood, by doubling
        step = min(width, SPAN - width)
        keys = np.minimum(keys[:-step], keys[step:])
        width += step
    leads = keys & ((1 << 40) - 1)
    led = np.bincount(leads[keys != np.iinfo(np.int64).max], minlength=len(at))
    chosen = np.flatnonzero(led >= LEAST_LED)
    doc = np.searchsorted(np.cumsum(windows), chosen, side="right")
    words = np.ascontiguousarray(buffer[at[chosen][:, None] + np.arange(WINDOW)]).view(np.uint64)
    h = np.full(len(chosen), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h = _mix(h ^ words[:, k]) + np.uint64(k + 1)
    _, first = np.unique(_mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    first.sort()  # a feature that comes again sets nothing new
    h, doc = h[first], doc[first]
    per_doc = np.bincount(doc, minlength=len(texts))
    order = np.arange(len(doc)) - (np.cumsum(per_doc) - per_doc)[doc]
    filters = -(-per_doc // FEATURES)
    base = np.cumsum(filters) - filters
    bits = np.zeros(int(filters.sum()) * BITS, np.uint8)
    for k in range(HASHES):
        bits[(base[doc] + order // FEATURES) * BITS + ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits).reshape(-1, BITS // 8)
    return [packed[b : b + f] for b, f in zip(base.tolist(), filters.tolist(), strict=True)]


_POP = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against its best match in the other, weighed by set bits. Two empty digests are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = _POP[a].sum(axis=1), _POP[b].sum(axis=1)
    best = np.zeros(len(a))
    for i, own in enumerate(a):
        both = _POP[own & b].sum(axis=1)
        chance, most = na[i] * nb / BITS, np.minimum(na[i], nb)
        best[i] = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max()
    return float((best * na).sum() / na.sum())


def as_text(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text; a null or empty text has the fingerprint ''. Repeated rows stay."""
    ranks = rarity(class_counts(docs, text_col)) if ranks is None else ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(as_text, digest(texts, ranks)), pa.string())], [id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the following text's start, or all of that."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_likeness(docs: DataFrame, ranks: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they and the next document's are.

    The next document has the next smaller id; after the last comes the first. Rows of one id follow each other by text;
    null ids come last. Documents are dealt to ranges of ids whose bounds are ids of the table, so that the row after a
    range's last is known beforehand and is sent to that range as well.
    """
    ranks = rarity(class_counts(docs, text_col)) if ranks is None else ranks
    n = 2 * input_partitions(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.agg(F.max("doc_id").alias("top"), F.expr(f"percentile_approx(doc_id, {'array(' + ','.join(str(k / n) for k in range(1, n)) + ')'}, {max(10_000, 10 * n)})").alias("cuts")).first()
    bounds = np.array(sorted({x for x in [found["top"], *(found["cuts"] or [])] if x is not None}), np.int64)  # each range ends with its bound
    last = max(1, len(bounds))
    sent = docs.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series) -> pd.Series:
        """A row's range, counted from the largest ids; for a range's first row also the range before, negative."""
        empty = ids.isna().to_numpy()
        known = ids.fillna(0).to_numpy().astype(np.int64)
        k = np.searchsorted(sent.value, known)
        own = np.where(empty, last - 1, last - 1 - k)
        tops = ~empty & (sent.value[np.minimum(k, last - 1)] == known) if len(sent.value) else empty
        return pd.Series([[int(r), -int((r - 1) % last) - 1] if t else [int(r)] for r, t in zip(own, tops, strict=True)])

    dealt = rows.withColumn("r", F.explode(ranges("doc_id"))).select(F.when(F.col("r") < 0, -F.col("r") - 1).otherwise(F.col("r")).alias("range"), (F.col("r") < 0).alias("halo"), "doc_id", "text")
    if not len(bounds):  # only null ids: one run, whose first row follows its last
        dealt = rows.select(F.lit(0).alias("range"), F.explode(F.array(F.lit(False), F.lit(True))).alias("halo"), "doc_id", "text")
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "halo", F.desc_nulls_last("doc_id"), "text")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (range, halo, id, text), waiting for the row after the last
        size, ended = 0, None

        def flush() -> pa.RecordBatch:
            texts = [x[3] for x in held]
            own = digest(texts, ranks)
            mixed = [edited(t, f) for t, f in zip(texts, texts[1:], strict=False)]
            other = digest(mixed, ranks)
            m = len(mixed)
            columns = [[x[2] for x in held[:m]], [len(t) for t in texts[:m]], [hashlib.sha256(t.encode()).hexdigest() for t in mixed], [as_text(x) for x in own[:m]], [as_text(x) for x in other], [likeness(a, b) for a, b in zip(own, other, strict=False)], [likeness(a, b) for a, b in zip(own, own[1:], strict=False)]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

        for batch, texts in text_slices(batches, 3):
            for r, halo, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, strict=True):
                if r == ended:
                    continue  # more rows of the next range's first id
                held.append((r, halo, key, text))
                size += len(text)
                if halo or size > 500_000 and len(held) > 1:
                    yield flush()
                    ended = r if halo else None
                    held, size = ([], 0) if halo else ([held[-1]], len(text))

    return dealt.mapInArrow(run, schema)
