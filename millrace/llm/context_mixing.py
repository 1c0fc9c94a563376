"""Language-model scores by logistic context mixing.

A text is the stream of its lower-cased tokens, a space after each, and an end. Each byte is a few bits: its path in a
prefix code over the training bytes. Several predictors, each a table of bit counts under a hashed context of the stream
(the last bytes, the word so far, the word so far and the word before), predict each bit; their log odds are added up with
weights that a gate selects, an adaptive map refines the sum, and the costs of all bits make the text's probability.

Bit counts cover all training texts. The mixing weights and the map, a few thousand numbers, are fitted on all different
training texts: a hash deals these to shards of about LEARN_DOCS, each shard is learned online in the order of the hash, each
occurrence left out of its own counts, and the shards' weights are averaged by their bytes, their maps added up. All sums
over partitions are of whole numbers, so scores don't depend on how rows are dealt.

The loops over every bit (_count, _learned, Model.cost) run in the executors' JVMs, from Mixing.java; the functions here say the
same in numpy, and tests hold the two against each other.
"""

from __future__ import annotations

import heapq
import math
import struct
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import java
from .common import text_slices, written

#: Predictors by what they see: so many last bytes; "word": the word so far; "words": that and the word before.
PREDICTORS = (2, 3, 4, 6, "word", "words")
#: Widths of their tables in bits, at least and at most; between, they grow with the training bytes.
LEAST_BITS, MOST_BITS = 14, (18, 20, 21, 21, 21, 21)
#: The predictors whose line counts select the weights, and levels of each.
GATES, LEVELS = (3, 5), 6
#: What is added to each count of a bit; the bound of the logistic domain, and buckets of the map over it.
PRIOR, BOUND, BUCKETS = 0.4, 8.0, 64
#: Odds of slots are whole numbers of this part, so that tables of two bytes a slot hold them.
ODDS_PART = 4096
#: Training texts of a shard that is learned online, about; tasks for them at most; bytes of a step; its rate; a shard's bytes before its map is filled.
LEARN_DOCS, LEARN_PARTS, STEP, RATE, SETTLED = 1_600, 128, 4_000, 0.02, 500_000
#: Shards' weights are added up as whole numbers of this part.
FINE = 1 << 24
#: Bytes that are priced together, small enough for the caches; bytes of a block of texts whose tokens are looked up together, about.
SLICE, BLOCK_BYTES = 48_000, 24_000_000
#: Bytes whose features are gathered together for several steps; lines that are gathered before they are counted.
LEARN_SLICE, GATHER = 48_000, 1 << 20
#: Training texts of a partition that is counted at least, such partitions at most, and ranges that their tables are added up in.
COUNT_DOCS, COUNT_PARTS, RANGES = 12_000, 4_096, 512
#: Slots of a line; lines begin at any slot and may overlap, as most use few of theirs.
LINE = 16
#: Ends before each text, that contexts look back on instead of another text.
PAD = 8
SPACE, END = 32, 10
_C, _M, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def paths(counts: list[int]) -> list[list[tuple[int, int]]]:
    """Each byte's way to it in a Huffman tree over counts (one more each): the nodes and the bits taken there."""
    heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    inner = []
    while len(heap) > 1:
        (m, a), (n, b) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (m + n, len(counts) + len(inner)))
        inner.append((a, b))
    out, todo = [[] for _ in counts], [(heap[0][1], [])]
    while todo:
        at, way = todo.pop()
        if at < len(counts):
            out[at] = way
        else:
            own = at - len(counts)
            todo += [(to, [*way, (own, bit)]) for bit, to in enumerate(inner[own])]
    return out


class Code:
    """The prefix code as arrays. Up to four bits of a byte in a row are a line: their slots in a table lie together."""

    def __init__(self, counts: np.ndarray):
        ways = paths(counts.tolist())
        lines = [[way[i : i + 4] for i in range(0, len(way), 4)] for way in ways]
        self.bits, self.lines = np.array([len(w) for w in ways]), np.array([len(x) for x in lines])
        self.first_bit, self.first_line = np.cumsum(self.bits) - self.bits, np.cumsum(self.lines) - self.lines
        self.node = np.array([n for w in ways for n, _ in w], np.int64)
        self.bit = np.array([b for w in ways for _, b in w], np.int64)
        self.anchor = (np.array([x[0][0] for own in lines for x in own], np.uint64) + np.uint64(1)) * _C
        self.size = np.array([len(x) for own in lines for x in own])
        within = []
        for own in lines:
            for line in own:
                place = 1
                for _, b in line:
                    within.append(place)
                    place = 2 * place + b
        self.within = np.array(within, np.int64)
        self.sign = np.where(self.bit == 1, -1, 1).astype(np.float32)
        self.line_bit = np.cumsum(self.size) - self.size  # bits of a byte's lines follow each other
        self.twice, self.cell = self.within * 2 + self.bit, self.node * BUCKETS


def widths(n_bytes: int) -> list[int]:
    """Bits of the tables for so many training bytes."""
    return [min(most, max(LEAST_BITS, int(n_bytes).bit_length() - 4)) for most in MOST_BITS]


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def streams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some texts, ends before each; the places that count; how many of them are each text's."""
    parts = [b"\n" * PAD + b" ".join([*words, b"\n"]) for words in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    keep = np.ones(len(data), bool)
    keep[((np.cumsum(sizes) - sizes)[:, None] + np.arange(PAD)).ravel()] = False
    return data, np.flatnonzero(keep), sizes - PAD


_POWERS: list[np.ndarray] = [np.empty(0, np.uint64)] * 2


def contexts(data: np.ndarray) -> Iterator[np.ndarray]:
    """For each predictor, a hash of what it sees at each place."""
    n, wide = len(data), data.astype(np.uint64)
    last = np.zeros(n, np.uint64)
    for k in range(1, 7):
        last[k:] |= wide[:-k] << np.uint64(8 * (k - 1))
    if len(_POWERS[0]) <= n:
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(2 * n, p))) for p in (_P, _INVERSE)]
    start = np.zeros(n, np.int64)
    begin = np.flatnonzero((data[:-1] == SPACE) | (data[:-1] == END)) + 1
    start[begin] = begin
    start = np.maximum.accumulate(start)
    total = np.append(np.uint64(0), np.cumsum((wide + np.uint64(1)) * _POWERS[1][:n]))
    word = (total[:-1] - total[start]) * _POWERS[0][:n]
    before = word[np.maximum(start - 1, 0)]  # the place before a word has seen all of the one before
    for k, sees in enumerate(PREDICTORS):
        if sees == "word":
            h = word
        elif sees == "words":
            h = word + before * _C
        else:
            h = last & np.uint64((1 << 8 * sees) - 1)
        yield (h + np.uint64(k + 1)) * _P


@dataclass
class Bits:
    """The lines of some places of streams. entry: each one's entry in the code; base: its slots, by predictor; first: each byte's first line."""

    code: Code
    entry: np.ndarray
    base: list[np.ndarray]
    first: np.ndarray

    @classmethod
    def read(cls, code: Code, width: list[int], data: np.ndarray, hashes: list[np.ndarray], keep: np.ndarray) -> Bits:
        own = data[keep]
        lines = code.lines[own]
        start = np.cumsum(lines) - lines
        of_byte = np.repeat(np.arange(len(own)), lines)
        entry = (code.first_line[own] - start)[of_byte]
        entry += np.arange(len(entry))
        anchor, place, shifted = code.anchor[entry], keep[of_byte], np.empty(len(entry), np.uint64)
        base, first = [], 0
        for h, b in zip(hashes, width, strict=True):
            x = h[place]
            x += anchor
            x ^= np.right_shift(x, np.uint64(31), out=shifted)
            x *= _M
            x >>= np.uint64(64 - b)
            x += np.uint64(first)
            base.append(x.view(np.int64))
            first += (1 << b) + LINE
        return cls(code, entry, base, start)

    def spread(self, order: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of lines in an order: each bit's line, its entry in the code, and each line's first bit."""
        entry = self.entry[order]
        size = self.code.size[entry]
        start = np.cumsum(size) - size
        line = np.repeat(np.arange(len(entry)), size)
        of = (self.code.line_bit[entry] - start)[line]
        of += np.arange(len(of))
        return line, of, start

    @property
    def of(self) -> np.ndarray:
        return self.spread()[1]

    def slots(self, k: int) -> np.ndarray:
        line, of, _ = self.spread()
        return self.base[k][line] + self.code.within[of]

    def gates(self, width: list[int], level: list[np.ndarray]) -> np.ndarray:
        """Each line's gate; the slot 1 of a line is its first bit's."""
        a, b = (t[self.base[k] + (1 - _first(width, k))] for k, t in zip(GATES, level, strict=True))
        return (a * np.int8(LEVELS) + b).astype(np.uint16)


def _bits(code: Code, width: list[int], texts: list[list[bytes]]) -> Iterator[Bits]:
    """The lines of some texts, about SLICE bytes at a time, whatever a text's length."""
    data, keep, _ = streams(texts)
    yield from _read(code, width, data, keep)


def _read(code: Code, width: list[int], data: np.ndarray, keep: np.ndarray) -> Iterator[Bits]:
    hashes = list(contexts(data))
    for part in np.array_split(keep, -(-len(keep) // SLICE)):
        yield Bits.read(code, width, data, hashes, part)


@dataclass
class Model:
    """code, width: of the tables; odds: each slot's; level: of counts, for the tables of GATES. weights: by gate and predictor. refined: by node and bucket."""

    code: Code
    width: list[int]
    odds: np.ndarray
    level: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.full((LEVELS**2, len(PREDICTORS)), 0.3, np.float32))
    refined: np.ndarray | None = None

    def by_byte(self, bits: Bits) -> np.ndarray:
        """The cost of each byte. Lines go by their gates, so that the bits of a gate lie together.

        A bit's cost mustn't depend on where it lies, so nothing here is a product of matrices.
        """
        gate = bits.gates(self.width, self.level)
        order = np.argsort(gate, kind="stable")
        line, of, start = bits.spread(order)
        within, x = self.code.within[of], np.empty((len(bits.base), len(of)), np.float32)
        for own, base in zip(x, bits.base, strict=True):
            at = base[order][line]
            at += within
            np.take(self.odds, at, out=own, mode="clip")
        z, ends = np.empty(len(of), np.float32), np.append(start, len(of))[np.cumsum(np.bincount(gate, minlength=LEVELS**2))]
        for weights, a, b in zip(self.weights, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if a < b:
                x[:, a:b] *= weights[:, None]
                np.add.reduce(x[:, a:b], axis=0, out=z[a:b])
        np.clip(z, -BOUND, BOUND, out=z)
        if self.refined is not None:
            at = _bucket(z)
            at += self.code.cell[of]
            z += self.refined[at]
            z *= np.float32(0.5)
        z *= self.code.sign[of]
        np.exp(z, out=z)
        z += np.float32(1)
        np.log(z, out=z)
        price = np.empty(len(order))
        price[order] = np.add.reduceat(z, start)  # of four bits at most
        return np.add.reduceat(price, bits.first)

    def cost(self, texts: list[list[bytes]]) -> np.ndarray:
        """The log10 probability of each text, given as its tokens, its end included."""
        out = []
        for part in _parts(texts, SLICE):
            data, keep, sizes = streams(part)
            by_byte = [self.by_byte(bits) for bits in _read(self.code, self.width, data, keep)]
            out.append(np.add.reduceat(np.concatenate(by_byte), np.cumsum(sizes) - sizes) / -math.log(10))
        return np.concatenate(out) if out else np.empty(0)


def _first(width: list[int], k: int) -> int:
    return sum((1 << b) + LINE for b in width[:k])


def _bucket(z: np.ndarray) -> np.ndarray:
    return np.minimum((z + np.float32(BOUND)) * np.float32(BUCKETS / (2 * BOUND)), BUCKETS - 1).astype(np.int64)


def _level(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + np.float32(1)), LEVELS - 1).astype(np.int8)


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    x = np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))
    x *= np.float32(ODDS_PART)
    np.clip(np.rint(x, out=x), -BOUND * ODDS_PART, BOUND * ODDS_PART - 1, out=x)
    x /= np.float32(ODDS_PART)
    return x


def _parts(texts: Iterable[list[bytes]], size: int) -> Iterator[list[list[bytes]]]:
    """Texts of about so many bytes together; a longer text alone."""
    held, n = [], 0
    for words in texts:
        own = sum(map(len, words)) + len(words)
        if held and n + own > size:
            yield held
            held, n = [], 0
        held.append(words)
        n += own
    if held:
        yield held


def _left_out(width: list[int], counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each slot's odds for an occurrence of a 0 and of a 1, and levels for the tables of GATES, without that occurrence."""
    odds, one = np.empty_like(counts), np.float32(1)
    for k in range(len(width)):
        own = slice(2 * _first(width, k), 2 * _first(width, k + 1))
        zeros, ones = counts[own][::2], counts[own][1::2]
        odds[own][::2] = _odds(np.maximum(zeros - one, 0), ones)
        odds[own][1::2] = _odds(zeros, np.maximum(ones - one, 0))
    tables = [counts[2 * _first(width, k) : 2 * _first(width, k + 1)] for k in GATES]
    return odds, [_level(np.maximum(t[::2] + t[1::2] - one, 0)) for t in tables]


def _learn(code: Code, width: list[int], counts: np.ndarray, texts: Iterator[list[list[bytes]]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights, and the map's counts by node, bucket and bit, from training texts in their order; an occurrence doesn't count for itself."""
    return _learned(code, width, *_left_out(width, counts), texts)


def _steps(code: Code, width: list[int], texts: Iterable[list[list[bytes]]]) -> Iterator[tuple[Bits, list[int]]]:
    """The lines of several steps at once, and each step's lines. A part is a step; one over SLICE bytes is several."""
    held, sizes = [], []

    def flush() -> Iterator[tuple[Bits, list[int]]]:
        if len(sizes) == 1:
            for bits in _bits(code, width, held):
                yield bits, [len(bits.entry)]
        elif sizes:
            data, keep, _ = streams(held)
            bits = Bits.read(code, width, data, list(contexts(data)), keep)
            starts = bits.first[np.cumsum(sizes) - sizes]
            yield bits, np.diff(starts, append=len(bits.entry)).tolist()

    for part in texts:
        n = sum(sum(map(len, words)) + len(words) + 1 for words in part)
        if sizes and (sum(sizes) + n > LEARN_SLICE or len(sizes) == 1_000):
            yield from flush()
            held, sizes = [], []
        held += part
        sizes.append(n)
    yield from flush()


def _learned(code: Code, width: list[int], odds: np.ndarray, level: list[np.ndarray], texts: Iterator[list[list[bytes]]]) -> tuple[np.ndarray, np.ndarray]:
    """What _learn returns. odds, level: as _left_out gives them."""
    weights = Model(code, width, np.empty(0), []).weights
    seen, found, gates = 0, np.zeros(256 * BUCKETS * 2), LEVELS**2
    for bits, steps in _steps(code, width, texts):
        # lines go by step and gate: what shares weights lies together
        gate = bits.gates(width, level)
        gate += np.repeat(np.arange(len(steps), dtype=np.uint16) * np.uint16(gates), steps)
        order = np.argsort(gate, kind="stable")
        line, of, start = bits.spread(order)
        ends = np.append(start, len(of))[np.cumsum(np.bincount(gate, minlength=len(steps) * gates))].tolist()
        twice, x = code.twice[of], np.empty((len(width), len(of)), np.float32)
        for own, base in zip(x, bits.base, strict=True):
            at = (base[order] * 2)[line]
            at += twice
            np.take(odds, at, out=own, mode="clip")
        bit, z = code.bit[of], np.empty(len(of), np.float32)
        want, begin, filled = bit.astype(np.float32), 0, len(of)
        n_bytes = np.diff(np.searchsorted(bits.first, np.cumsum([0, *steps]))).tolist()
        for s, n in enumerate(n_bytes):
            own, a = [], begin
            for g, b in enumerate(ends[s * gates : (s + 1) * gates]):
                if a < b:
                    own.append((g, x[:, a:b], a, b))
                    np.dot(weights[g], x[:, a:b], out=z[a:b])
                a = b
            now = z[begin:a]
            np.clip(now, -BOUND, BOUND, out=now)
            error = np.negative(now)
            np.exp(error, out=error)
            error += np.float32(1)
            np.divide(np.float32(-1), error, out=error)
            error += want[begin:a]
            for g, values, p, q in own:
                weights[g] += np.dot(values, error[p - begin : q - begin]) * np.float32(RATE / math.sqrt(q - p))
            if seen > SETTLED:
                filled = min(filled, begin)
            seen, begin = seen + n, a
        if filled < len(of):
            at = _bucket(z[filled:])
            at += code.cell[of[filled:]]
            at *= 2
            at += bit[filled:]
            found += np.bincount(at, minlength=len(found))
    return weights, found


def _count(code: Code, width: list[int], total: np.ndarray, texts: Iterable[list[bytes]]) -> None:
    """Adds to total, which has each slot's zeros and ones, the bits of texts.

    Lines are gathered and sorted: equal ones are added once, with their number, and slots are met in their order.
    """
    shift = np.uint64(len(code.size).bit_length())
    kind = np.uint32 if max(width) + 1 + int(shift) <= 32 else np.uint64
    held = np.empty((len(width), GATHER), kind)
    n = 0
    # each line's first to fourth bit: its place, and whether there is one
    bit = code.line_bit + np.arange(4)[:, None]
    some = (code.size > np.arange(4)[:, None]).astype(total.dtype)
    place = np.where(some > 0, code.twice[np.minimum(bit, len(code.twice) - 1)], 0)

    def flush() -> None:
        for k, own in enumerate(held[:, :n]):
            own.sort()
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            key, times = own[first], np.diff(first, append=n).astype(total.dtype)
            entry = (key & kind((1 << int(shift)) - 1)).astype(np.int64)
            base = ((key >> kind(shift)).astype(np.int64) + _first(width, k)) * 2
            for at, there in zip(place, some, strict=True):
                own = at[entry]
                own += base
                np.add.at(total, own, times * there[entry])

    for part in _parts(texts, SLICE):
        for bits in _bits(code, width, part):
            for start in range(0, len(bits.entry), GATHER):
                entry = bits.entry[start : start + GATHER]
                if n + len(entry) > GATHER:
                    flush()
                    n = 0
                for k, base in enumerate(bits.base):
                    key = base[start : start + GATHER] - _first(width, k)
                    key <<= np.int64(shift)
                    key |= entry
                    held[k, n : n + len(entry)] = key
                n += len(entry)
    flush()


def _java(spark: SparkSession, code: Code, width: list[int]):
    """The kernels of Mixing.java for a code and tables."""
    sees = [{"word": -1, "words": -2}.get(x, x) for x in PREDICTORS]
    head = [LEVELS, BUCKETS, LINE, *GATES, len(PREDICTORS), *(x for pair in zip(sees, width, strict=True) for x in pair), *code.bits]
    head += [x for pair in zip(code.node, code.bit, strict=True) for x in pair]
    return java.load(spark, "Mixing", struct.pack(f"<{len(head)}i", *head), BOUND)


def _sent(spark: SparkSession, kernels, odds: np.ndarray, level: list[np.ndarray], weights: np.ndarray | None = None, refined: np.ndarray | None = None):
    """A broadcast of tables; the odds go to the driver's JVM by a file."""
    with tempfile.NamedTemporaryFile(prefix="millrace-") as file:
        (odds * np.float32(ODDS_PART)).astype("<i2").tofile(file)
        file.flush()
        shorts = kernels.shorts(file.name)
    floats = (None if x is None else x.astype("<f4").tobytes() for x in (weights, refined))
    tables = kernels.tables(shorts, *(x.tobytes() for x in level), *floats)
    return spark.sparkContext._jsc.broadcast(tables)


def _costs(spark: SparkSession, model: Model, text: Column) -> Column:
    """Model.cost of each text."""
    kernels = _java(spark, model.code, model.width)
    sent = _sent(spark, kernels, model.odds, model.level, model.weights, model.refined)
    jvm = spark.sparkContext._jvm
    spark._jsparkSession.udf().register("millrace_mixing_cost", kernels.cost(sent), jvm.org.apache.spark.sql.types.DataTypes.DoubleType)
    return F.call_function("millrace_mixing_cost", text.cast("binary"))


def fit(texts: DataFrame, histogram: np.ndarray, n_texts: int) -> Model:
    """A model of whole texts (text string). histogram: how often each byte is in their streams."""
    code, width = Code(histogram), widths(int(histogram.sum()))
    slots = _first(width, len(width))
    cuts = np.linspace(0, 2 * slots, RANGES + 1).astype(np.int64)

    kernels = _java(texts.sparkSession, code, width)

    def add(rows: pa.Table) -> pa.Table:
        total = 0
        for x in rows["counts"]:
            total = total + np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64)
        total = total.astype("<f4")
        return pa.table({"range": pa.array([rows["range"][0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    spread = texts.coalesce(max(1, min(COUNT_PARTS, -(-n_texts // COUNT_DOCS))))
    counted = java.map_partitions(spread.select(F.col("text").cast("binary")), kernels.count(cuts.tobytes()), "range int, counts binary")
    summed = written(counted.groupBy("range").applyInArrow(add, "range int, counts binary"))
    counts = np.zeros(2 * slots, np.float32)
    for row in summed.toLocalIterator():
        counts[cuts[row["range"]] : cuts[row["range"] + 1]] = np.frombuffer(row["counts"], "<f4")

    shards = max(1, n_texts // LEARN_DOCS)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's copies of a text are left out before they meet others."""
        known = set()
        for batch in batches:
            new = []
            for x in zip(batch.column(0).to_pylist(), pc.binary_length(batch.column(1)).to_pylist(), strict=True):
                new.append(x not in known)
                known.add(x)
            yield batch.filter(pa.array(new, pa.bool_()))

    rows = texts.select(F.xxhash64("text").alias("key"), "text").mapInArrow(once, "key bigint, text string")
    sharded = rows.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key", F.col("text").cast("binary").alias("text")).repartition(min(shards, LEARN_PARTS), "shard").sortWithinPartitions("shard", "key", "text")
    model = Model(code, width, np.empty(0), [])
    odds, level = _left_out(width, counts)
    sent = _sent(texts.sparkSession, kernels, odds, level)
    learn = kernels.learn(sent, STEP, SLICE, SETTLED, RATE, float(FINE), float(model.weights[0, 0]))
    del odds, level

    weights, found, n = 0, 0, 0
    # written first: read row by row from the driver, the tasks would run one after another
    for row in written(java.map_partitions(sharded, learn, "weights binary, map binary, n bigint")).toLocalIterator():
        weights, found, n = weights + np.frombuffer(row["weights"], np.int64), found + np.frombuffer(row["map"]), n + row["n"]
    sent.destroy()
    tables = [counts[2 * _first(width, k) : 2 * _first(width, k + 1)] for k in GATES]
    model.odds, model.level = _odds(counts[::2], counts[1::2]), [_level(t[::2] + t[1::2]) for t in tables]
    if n:
        model.weights = (weights / (n * FINE)).reshape(model.weights.shape).astype(np.float32)
        n0, n1 = found.reshape(-1, 2).T
        centre = (np.arange(BUCKETS) + 0.5) * (2 * BOUND / BUCKETS) - BOUND
        prior = 8 / (1 + np.exp(-np.tile(centre, 256)))  # eight occurrences that say what the mixer says
        model.refined = np.log((n1 + prior) / (n0 + 8 - prior)).astype(np.float32)
    return model


def _sorted(tokens: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    array = pa.array(tokens, pa.binary())
    return array, pc.sort_indices(array).to_numpy()


def score(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all whole texts under a model of those whose `held_out` column is false.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte). A null or empty text has the end
    as its one token. Repeated rows are scored, and learned from, each. Without training texts every bit costs 1. Ids may be
    null, repeated, or of any type.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sums = docs.agg(F.sum(F.octet_length(text)).alias("bytes"), F.count_if(~F.col(held_out)).alias("train")).first()
    n_train, blocks = sums["train"], max(1, -(-(sums["bytes"] or 0) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text), F.lit(blocks)).cast("int").alias("block")
    dealt = docs.select(block, F.col(id_col).alias("doc_id"), F.col(held_out).alias("held_out"), text.alias("text"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; a block's tokens are numbered in their order. n: in training texts."""
        block, known, trained = None, set(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            known.difference_update(trained)
            array, order = _sorted([*trained, *known])
            n = np.append(np.fromiter(trained.values(), np.int64, len(trained)), np.zeros(len(known), np.int64))
            for start in range(0, len(order), 50_000):
                part = order[start : start + 50_000]
                ranks = np.arange(start, start + len(part), dtype=np.int32)
                columns = [np.full(len(part), block, np.int32), ranks, array.take(pa.array(part)), n[part]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "k", "token", "n"])

        for batch, texts in text_slices(batches, 2):
            for b, out, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                if b != block:
                    yield from flush()
                    block, known, trained = b, set(), Counter()
                (known if out else trained).update(words_of(t))
        yield from flush()

    ordered = dealt.select("block", "held_out", "text").repartition(blocks, "block").sortWithinPartitions("block")
    tokens = written(ordered.mapInArrow(distinct, "block int, k int, token binary, n bigint"))
    vocabulary = written(tokens.groupBy("token").agg(F.sum("n").alias("c")))

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each byte is in the tokens of the training texts."""
        total = np.zeros(256, np.int64)
        for batch in batches:
            sizes = pc.binary_length(batch.column(0)).to_numpy()
            data = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8)
            weight = np.repeat(batch.column(1).to_numpy(), sizes)
            total += np.bincount(data, weight.astype(float), 256).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], ["byte", "n"])

    known = vocabulary.where("c > 0")
    sums = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct_tokens = sums["n"] + n_train, sums["v"] + (n_train > 0)
    histogram = np.zeros(256, np.int64)
    for r in known.select("token", "c").mapInArrow(bytes_of, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        histogram[r["byte"]] = r["n"]
    histogram[[SPACE, END]] += [sums["n"], n_train]
    model = fit(dealt.where("NOT held_out").select("text"), histogram, n_train)
    priced = dealt.withColumn("score", _costs(docs.sparkSession, model, F.col("text")))
    valued = tokens.select("block", "k", "token").join(vocabulary, "token").select("block", "k", "c")
    unit = math.log10(total + distinct_tokens + 1)
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"

    def finish(rows: pa.Table, values: pa.Table) -> pa.Table:
        counts = np.empty(values.num_rows, np.int64)
        counts[values["k"].to_numpy()] = values["c"].to_numpy()
        # a slice's tokens are held at a time; of the block only the distinct ones
        number: dict[bytes, int] = {}
        for t in rows["text"]:
            number.update(dict.fromkeys(words_of(t.as_py())))
        _, order = _sorted(list(number))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number = dict(zip(number, rank.tolist(), strict=True))
        parts = [[np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        for part in _parts((words_of(t.as_py()) for t in rows["text"]), SLICE):
            size = np.array([len(words) for words in part], np.int64)
            seen = counts[np.fromiter((number[w] for words in part for w in words), np.int64, size.sum())]
            text = np.repeat(np.arange(len(part)), size)
            own = np.bincount(text, np.log10(seen + 1.0), len(part)), np.bincount(text[seen > 0], minlength=len(part))
            n_bytes = np.array([sum(map(len, words)) for words in part], np.int64) + size + 1
            for held, new in zip(parts, (size, *own, n_bytes), strict=True):
                held.append(new)
        sizes, base, n_known, n_bytes = (np.concatenate(held) for held in parts)
        base = base + math.log10(n_train + 1) - (sizes + 1) * unit
        n_known, scores = n_known + (n_train > 0), rows["score"].to_numpy()
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "held_out": rows["held_out"],
                "n_tokens": sizes + 1,
                "n_known": n_known,
                "train_tokens": np.full(len(sizes), total, np.int64),
                "base_score": base,
                "score": scores,
                "bits_per_byte": -scores * math.log2(10) / n_bytes,
            }
        )

    return priced.groupBy("block").cogroup(valued.groupBy("block")).applyInArrow(finish, schema)
