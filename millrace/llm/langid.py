"""Language identification by bit-sliced n-gram filters.

A Bloom filter whose cells are language bitmasks answers, for an n-gram, which languages contain it: the conjunction of
the masks in its cells. A text's n-grams are counted for each language, the counts are corrected for the false positives
that the fill of that language's slice makes, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

UNDETERMINED = "und"
#: Characters of n-grams; a word's start and end count as one each. Three code points fit 63 bits.
SIZES = (2, 3)
#: A language contains an n-gram if it comes LEAST_COUNT times, and as often, in proportion, as RATIO of the most in any language.
LEAST_COUNT, RATIO = 3, 0.2
#: Cells set for each n-gram; cells for each n-gram at least.
HASHES, CELLS_PER_GRAM = 3, 16


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of lower-cased words (runs of letters) and the text of each."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(f"{t}\n" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in lowered), np.int64, len(texts)))
    seen = np.flatnonzero(np.bincount(codes, minlength=1))
    letter = np.zeros(int(seen.max(initial=0)) + 1, bool)
    letter[[c for c in seen.tolist() if chr(c).isalpha()]] = True
    is_letter = letter[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one boundary after each word
    codes, doc, is_letter = np.where(is_letter, codes, 0)[keep].astype(np.int64), doc[keep], is_letter[keep]
    codes, doc = np.append(0, codes), np.append(doc[:1], doc)  # and one before the first
    is_letter = np.append(False, is_letter)
    found, where = [], []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        key = np.zeros(m, np.int64)
        for k in range(n):
            key = key << 21 | codes[k : k + m]
        inside = np.ones(m, bool)
        for k in range(1, n - 1):
            inside &= is_letter[k : k + m]
        if n == 2:
            inside &= is_letter[:m] | is_letter[1:]
        found.append(key[inside] << 2 | n)
        where.append(doc[n - 1 :][inside])
    return (np.concatenate(found), np.concatenate(where)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Model:
    """languages, the most frequent first; table: the cells' masks, 64 languages a column; false: each slice's false-positive rate."""

    languages: list[str]
    bits: int
    table: np.ndarray
    false: np.ndarray

    def decide(self, texts: list[str]) -> tuple[list[str], list[float]]:
        found, doc = grams(texts)
        total = np.bincount(doc, minlength=len(texts))
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        cells = _cells(found, self.bits)
        hits = np.zeros((len(self.languages), len(texts)))
        for w in range(self.table.shape[1]):
            column = self.table[:, w]
            mask = column[cells[0]]
            for c in cells[1:]:
                mask &= column[c]
            for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                hits[k] = np.bincount(doc[(mask >> np.uint64(k - 64 * w) & np.uint64(1)).astype(bool)], minlength=len(texts))
        share = np.clip((hits - total * self.false[:, None]) / (1 - self.false[:, None]) / np.maximum(total, 1), 0, 1)
        best = share.argmax(axis=0)  # ties: the more frequent language
        names = [self.languages[b] if n else UNDETERMINED for b, n in zip(best.tolist(), total.tolist(), strict=True)]
        return names, np.where(total > 0, share[best, np.arange(len(texts))], 0.0).tolist()


def _merged(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, index = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, np.bincount(index, weights=np.concatenate(counts)).astype(np.int64)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model from all rows with a language; rows without one, and empty texts, teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch, texts in text_slices(batches, 1, 500_000):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                by.setdefault(lang, []).append(text)
            for lang, own in by.items():
                keys, n = np.unique(grams(own)[0], return_counts=True)
                mine = held.setdefault(lang, [[], []])
                mine[0].append(keys)
                mine[1].append(n)
                if sum(map(len, mine[0])) > 500_000 and len(mine[0]) > 1:
                    keys, n = _merged(*mine)
                    mine[0][:], mine[1][:] = [keys], [n]
        for lang, mine in held.items():
            keys, n = _merged(*mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = known.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).cache()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").collect()
    languages = [r["lang"] for r in totals]
    if not languages:
        counts.unpersist()
        return Model([], 1, np.zeros((2, 1), np.uint64), np.zeros(0))
    index = docs.sparkSession.createDataFrame([(r["lang"], i, r["total"]) for i, r in enumerate(totals)], "lang string, k int, total bigint")
    share = counts.join(F.broadcast(index), "lang").withColumn("share", F.col("n") / F.col("total"))
    most = share.groupBy("gram").agg(F.max("share").alias("most"))
    member = share.join(most, "gram").where((F.col("n") >= LEAST_COUNT) & (F.col("share") >= RATIO * F.col("most")))
    masks = member.groupBy("gram", (F.col("k") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, k % 64)")).alias("mask"))
    bits = max(10, int(CELLS_PER_GRAM * masks.select("gram").distinct().count()).bit_length())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in _cells(batch.column(0).to_numpy(), bits):
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1), batch.column(2)], ["cell", "w", "mask"])

    rows = masks.mapInArrow(place, "cell bigint, w int, mask bigint").groupBy("cell", "w").agg(F.bit_or("mask").alias("mask")).toArrow()
    counts.unpersist()
    table = np.zeros((1 << bits, -(-len(languages) // 64)), np.uint64)
    table[rows["cell"].to_numpy(), rows["w"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    fill = np.array([(table[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(languages))])
    return Model(languages, bits, table, fill**HASHES)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, *extra, lang_pred, score) of every whole text: the share of its n-grams that the language contains.

    A null text, or one without a letter, is `und` with 0. Of equal counts the language with more training text wins.
    Repeated rows each get theirs.
    """
    names = [id_col, *extra]
    kinds = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, len(names), 500_000):
            lang, score = sent.value.decide(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return docs.select(*names, F.col(text_col)).mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", lang_pred string, score double")
