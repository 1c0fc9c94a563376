"""An exact Jaccard join of documents by word n-grams, as a blocked sparse matrix product.

Rows of the incidence matrix are the distinct n-gram sets (equal sets are one class, and one row of it is read after the
classes are known), columns the n-grams. Columns that one class alone has can't add to an overlap; among the others, two classes that reach the threshold must share a column of
their size-derived prefixes. Classes that share prefix columns form clusters; within a cluster, rows are blocked by size
and hash, block pairs whose sizes can't reach the threshold are never formed, and the product of two blocks accumulates
all overlap counts. N-grams are 64-bit hashes, classes too (of the whole set).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, spread_join, temporary, text_slices, written

#: Widths in bits of the map of columns that several classes share, at least and at most; between, it grows with the n-grams. A map of classes is as wide.
LEAST_BITS, MOST_BITS = 22, 29
#: N-grams that are sorted together by a task; classes from which a column counts as hot and comes last in the order.
SORTED, HOT = 3_000_000, 16
#: N-grams of a block, about; those that a row counts as besides its own; columns of a dense product.
BLOCK_GRAMS, ROW_GRAMS, COLUMNS = 200_000, 200, 8_192
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _K)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWER_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


class Shingler:
    """Sorted distinct hashes of the word n-grams of texts; A-Z are lowered and words end at ASCII white space.

    A word's hash is a polynomial of its bytes modulo 2**64, taken from running sums over all texts at once.
    """

    def __init__(self, words: int):
        self.words, self.back, self.on = words, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        data = [t.encode() for t in texts]
        buffer = np.frombuffer(b"\n".join([*data, b""]).lower(), np.uint8)
        first = np.cumsum([0] + [len(x) + 1 for x in data])
        if len(self.back) < len(buffer):
            self.back = np.cumprod(np.append(np.uint64(1), np.full(2 * len(buffer), _POWER_INVERSE)))
            self.on = np.cumprod(np.append(np.uint64(1), np.full(2 * len(buffer), np.uint64(0x5851F42D4C957F2D))))
        inside = ~_SPACE[buffer]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.append(0, edge) if len(inside) and inside[0] else edge
        start, end = edge[::2], edge[1::2]
        total = np.append(np.uint64(0), np.cumsum(_BYTES[buffer] * self.back[: len(buffer)]))
        ids = _mix((total[end] - total[start]) * self.on[start] + (end - start).astype(np.uint64) * _K)
        words = np.diff(np.searchsorted(start, first))
        at = np.cumsum(words) - words
        m = max(0, len(ids) - self.words + 1)
        h = np.full(m, self.words, np.uint64)
        for k in range(self.words):
            h = _mix(h * _K + ids[k : k + m])
        out = []
        for a, n in zip(at.tolist(), words.tolist(), strict=True):
            if n >= self.words:
                own = np.sort(h[a : a + n - self.words + 1])
                keep = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                out.append(own[keep])
            else:  # the whole sequence is one
                own = np.full(min(n, 1), n, np.uint64)
                for w in ids[a : a + n]:
                    own = _mix(own * _K + w)
                out.append(own)
        return out


def _class_of(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _bits_of(n: int, each: int) -> int:
    """The width of a map for n entries with about 2 ** each bits for each."""
    return min(MOST_BITS, max(LEAST_BITS, int(n).bit_length() + each))


def _bit_map(hashes: DataFrame, bits: int) -> np.ndarray:
    """A map, `bits` wide, in which the leading bits of the 64-bit hashes (h bigint) are set."""

    def fill(rows: pa.Table) -> pa.Table:
        own = np.zeros(1 << (bits - 6), np.uint8)
        own[(rows["h"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)) & np.uint64(len(own) - 1)] = 1
        return pa.table({"range": pa.array([rows["range"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    out = np.zeros((64, 1 << (bits - 9)), np.uint8)
    ranged = hashes.select("h", F.shiftrightunsigned("h", 58).cast("int").alias("range"))
    for r in ranged.groupBy("range").applyInArrow(fill, "range int, bits binary").toLocalIterator():
        out[r["range"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes are in a map."""
    place = (hashes >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def _row_hash(classes: np.ndarray, ids: pa.Array) -> np.ndarray:
    return _mix(classes.view(np.uint64) * _K ^ _mix(ids.cast(pa.int64()).fill_null(0).to_numpy().view(np.uint64)))


def _first_rows(classes: DataFrame, n: int) -> np.ndarray:
    """A map of one row of each class, by class and id. Another row that is found in it costs a stage a row, never a link."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_row_hash(batch.column(0).to_numpy(), batch.column(1)).view(np.int64))], ["h"])

    return _bit_map(classes.select("class", "least_id").mapInArrow(hashed, "h bigint"), _bits_of(n, 3))


def _one_each(first: np.ndarray, ids: pa.Array, sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(class, set) of the rows that stand for their class."""
    classes = np.array([_class_of(s) for s in sets], np.int64)
    keep = _set(first, _row_hash(classes, ids))
    return ((c, s) for c, s, own in zip(classes.tolist(), sets, keep.tolist(), strict=True) if own and len(s))


def _mapped(docs: DataFrame, words: int, id_col: str, text_col: str, schema: str, one: Callable) -> DataFrame:
    """one(ids, sets) gives the columns of a slice's rows."""
    names = [f.split()[0].strip("`") for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(words)
        for batch, texts in text_slices(batches, 1):
            yield pa.RecordBatch.from_arrays(one(batch.column(0), own.sets(texts)), names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _members(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, class) of every row; an empty set has no class."""

    def one(ids: pa.Array, sets: list[np.ndarray]) -> list[pa.Array]:
        return [ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64())]

    return _mapped(docs, words, id_col, text_col, "doc_id bigint, n_shingles bigint, class bigint", one)


def _packed(columns: np.ndarray) -> bytes:
    """Sorted distinct numbers as 16-bit steps; the largest step adds its size and holds no number."""
    steps = np.diff(columns.astype(np.int64), prepend=-1)
    far = steps // 0xFFFF
    out = np.full(len(steps) + int(far.sum()), 0xFFFF, np.uint16)
    out[np.cumsum(far) + np.arange(len(steps))] = steps % 0xFFFF
    return out.astype("<u2").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, "<u2")
    return (np.cumsum(steps.astype(np.int64)) - 1)[steps != 0xFFFF]


def _shared_columns(docs: DataFrame, first: Broadcast, n_grams: int, words: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Two bit maps by hash: every column that comes in two classes or more is set in one, those in HOT or so in the other.

    Tasks send the leading bits of each column, sorted and packed by range; what comes twice in one, or meets another, is
    set. A bit that is set without need costs a later stage a row, never a link.
    """
    map_bits = _bits_of(n_grams, 1)
    hot_bits, column_bits = max(LEAST_BITS, map_bits - 3), max(26, int(n_grams).bit_length() + 4)
    range_bits = min(12, max(6, (int(n_grams) // 4_000_000).bit_length()))
    low, ranges = column_bits - range_bits, 1 << range_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = Shingler(words), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            for least in (1, 2, HOT):
                part = found[n >= least]
                cuts = np.searchsorted(part, np.arange(1, ranges, dtype=np.uint64) << np.uint64(low))
                packed = [_packed(x & np.uint64((1 << low) - 1)) for x in np.split(part, cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array([least] * ranges, pa.int32()), pa.array(packed, pa.binary())], ["range", "least", "packed"])

        for batch, texts in text_slices(batches, 1):
            for _, s in _one_each(first.value, batch.column(0), own.sets(texts)):
                held.append(s >> np.uint64(64 - column_bits))
                size += len(s)
            if size > SORTED:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def merge(rows: pa.Table) -> pa.Table:
        """Columns of one range that come twice, and hot ones, as the places of their bits."""
        parts = {1: [], 2: [], HOT: []}
        for least, x in zip(rows["least"].to_pylist(), rows["packed"], strict=True):
            parts[least].append(_unpacked(x.as_py()))
        found = np.sort(np.concatenate(parts[1]))
        again = lambda k: found[k:][found[k:] == found[:-k]]
        out = []
        for bits, columns in ((map_bits, [again(1), *parts[2]]), (hot_bits, [again(HOT - 1), *parts[HOT]])):
            own = np.zeros(1 << (bits - range_bits), np.uint8)
            own[np.concatenate(columns) >> (column_bits - bits)] = 1
            out.append(pa.array([np.packbits(own).tobytes()], pa.binary()))
        return pa.table([pa.array([rows["range"][0].as_py()], pa.int32()), *out], ["range", "shared", "hot"])

    rows = docs.select(id_col, text_col).mapInArrow(run, "range int, least int, packed binary").groupBy("range").applyInArrow(merge, "range int, shared binary, hot binary")
    shared, hot = (np.zeros((ranges, 1 << (bits - range_bits - 3)), np.uint8) for bits in (map_bits, hot_bits))
    for r in rows.toLocalIterator():
        shared[r["range"]], hot[r["range"]] = np.frombuffer(r["shared"], np.uint8), np.frombuffer(r["hot"], np.uint8)
    return shared.ravel(), hot.ravel()


def _prefixes(docs: DataFrame, first: Broadcast, maps: tuple[np.ndarray, np.ndarray], words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(column, class): the shared columns in the prefix of each class. In the order of all columns those without a bit come first, hot ones last, then by hash."""
    sent = docs.sparkSession.sparkContext.broadcast(maps)

    def one(ids: pa.Array, sets: list[np.ndarray]) -> list[pa.Array]:
        columns, classes = [], []
        shared, hot = sent.value
        for c, s in _one_each(first.value, ids, sets):
            common = s[_set(shared, s)]
            # any partner shares at least the overlap that the smallest allowed partner needs
            prefix = len(s) - -(-percent * len(s) // 100) + 1
            own = max(0, prefix - (len(s) - len(common)))
            if own:
                order = _mix(common ^ _K) >> np.uint64(1)  # not the order of the bits
                order |= _set(hot, common).astype(np.uint64) << np.uint64(63)
                columns.append(common[np.argpartition(order, own - 1)[:own]] if own < len(common) else common)
                classes.append(np.full(len(columns[-1]), c, np.int64))
        if not columns:
            return [pa.array([], pa.int64()), pa.array([], pa.int64())]
        return [pa.array(np.concatenate(columns).view(np.int64)), pa.array(np.concatenate(classes))]

    return _mapped(docs, words, id_col, text_col, "column bigint, class bigint", one)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (a, b) of the batches."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(x) for x in list(up)], pa.int64())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the component's least node. Large and small stars alternate; up to FEW edges are joined by one task."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= FEW:
        return edges.repartition(1).mapInArrow(_joined, "node bigint, root bigint")
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = written(both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")))
        own = least.select("a", F.least("a", "least").alias("least"))
        large = spread_join(both, own, "a", counts=least.select("a", "n")).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = written(large.where("a <> b"))
        least = written(large.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")))
        small = spread_join(large, least.select("a", "least"), "a", counts=least.select("a", "n"))
        edges = written(small.select("b", "least").union(least.select("a", "least")).toDF("a", "b").where("a <> b").distinct())
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Overlap counts of two blocks, each its rows' n-grams one after another and the rows' sizes."""
    (ga, na), (gb, nb) = a, b
    out = np.zeros((len(na), len(nb)), np.float32)
    both = np.intersect1d(ga, gb)
    ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    ca, cb = np.searchsorted(both, ga), np.searchsorted(both, gb)
    ia = np.flatnonzero(both[np.minimum(ca, len(both) - 1)] == ga) if len(both) else np.empty(0, int)
    ib = np.flatnonzero(both[np.minimum(cb, len(both) - 1)] == gb) if len(both) else np.empty(0, int)
    for start in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - start)
        dense = []
        for rows, cols, at, n in ((ra, ca, ia, len(na)), (rb, cb, ib, len(nb))):
            own = at[(cols[at] >= start) & (cols[at] < start + width)]
            m = np.zeros((n, width), np.float32)
            m[rows[own], cols[own] - start] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _forest(pairs: np.ndarray, classes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of row places that join what isn't joined yet; as classes."""
    root = list(range(len(classes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in pairs.tolist():
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            kept.append((int(classes[x]), int(classes[y])))
    return kept


#: What a block holds.
_PARTS = ("classes", "sizes", "copies", "grams")


def _classes(members: DataFrame) -> DataFrame:
    """(class, n_shingles, least_id, copies) of every class."""
    sums = (F.min("n_shingles").alias("n_shingles"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    return written(members.where("class IS NOT NULL").groupBy("class").agg(*sums))


def _block_pairs(docs: DataFrame, sizes: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs of blocks that can hold links, each block its classes, their sizes, copies and n-grams; a block meets itself once."""
    spark = docs.sparkSession
    total = sizes.agg(F.count("*").alias("classes"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("grams")).first()
    first = spark.sparkContext.broadcast(_first_rows(sizes, total["classes"]))
    maps = _shared_columns(docs, first, total["grams"], words, id_col, text_col)
    prefixes = written(_prefixes(docs, first, maps, words, percent, id_col, text_col).distinct())
    hubs = prefixes.groupBy("column").agg(F.min("class").alias("a"), F.max("class").alias("last")).where("a < last").select("column", "a")
    clusters = written(components(prefixes.join(hubs, "column").select("a", F.col("class").alias("b"))))
    step = -math.log(percent / 100) if percent < 100 else 1.0
    ids = sizes.select("class", F.col("least_id").alias("_least"))
    sizes = sizes.select("class", F.col("n_shingles").alias("n"), "copies")
    # a class of size n links with sizes from n * percent / 100 up: its own band or the next
    banded = written(clusters.join(sizes, clusters.node == sizes["class"]).select("root", "class", "n", "copies", F.floor(F.log(F.col("n").cast("double")) / F.lit(step) - F.lit(1e-9)).cast("int").alias("band")))
    cells = banded.groupBy("root", "band").agg(F.sum(F.col("n") + ROW_GRAMS).alias("grams"))
    blocked = written(banded.join(cells, ["root", "band"]).select("class", "copies", "root", "band", F.pmod(F.xxhash64("class"), F.greatest(F.lit(1), F.ceil(F.col("grams") / BLOCK_GRAMS))).cast("int").alias("block")))

    # the n-grams of clustered classes alone leave the documents: a bit map tells most others apart
    n_blocked = blocked.count()
    known = spark.sparkContext.broadcast(_bit_map(blocked.select(F.col("class").alias("h")), _bits_of(n_blocked, 3)))
    if n_blocked <= FEW:  # only rows that stand for these classes are read into n-grams again
        ids = written(blocked.join(ids, "class").select("_least").distinct())
        docs = docs.join(F.broadcast(ids), F.col(id_col).cast("bigint").eqNullSafe(F.col("_least")), "left_semi")

    def one(ids: pa.Array, sets: list[np.ndarray]) -> list[pa.Array]:
        keep = dict(_one_each(first.value, ids, sets))
        found = _set(known.value, np.array(list(keep), np.int64).view(np.uint64)).tolist()
        keep = {c: s.tobytes() for (c, s), own in zip(keep.items(), found, strict=True) if own}
        return [pa.array(keep.keys(), pa.int64()), pa.array(keep.values(), pa.binary())]

    rows = _mapped(docs, words, id_col, text_col, "class bigint, grams binary", one).join(blocked, "class")
    schema = "root bigint, band int, block int, classes binary, sizes binary, copies binary, grams binary"

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        held, copies = {}, dict(zip(table["class"].to_pylist(), table["copies"].to_pylist(), strict=True))
        for c, g in zip(table["class"].to_pylist(), table["grams"], strict=True):
            if c not in held:  # copies have the same n-grams
                held[c] = g.as_buffer().to_pybytes()
        held = dict(sorted(held.items()))
        return pa.table({"root": [key[0].as_py()], "band": pa.array([key[1].as_py()], pa.int32()), "block": pa.array([key[2].as_py()], pa.int32()), "classes": [np.array(list(held), np.int64).tobytes()], "sizes": [np.array([len(g) // 8 for g in held.values()], np.int64).tobytes()], "copies": [np.array([copies[c] for c in held], np.int64).tobytes()], "grams": [b"".join(held.values())]})

    # copies meet beforehand: one row of a class and its salt is left before a block gathers
    rows = rows.groupBy("class", "copies", "root", "band", "block").agg(F.first("grams").alias("grams"))
    blocks = written(rows.groupBy("root", "band", "block").applyInArrow(pack, schema))
    near = blocks.select("root", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("meet"), F.col("band").alias("band_b"), F.col("block").alias("block_b"), *(F.col(c).alias(f"{c}_b") for c in _PARTS))
    pairs = blocks.withColumn("meet", F.col("band")).join(near, ["root", "meet"]).where("band_b > band OR block_b >= block")

    return pairs.select(*_PARTS, *(f"{c}_b" for c in _PARTS))


def _linked(batch: pa.RecordBatch, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each pair of blocks: the classes and copies of both, which classes link, and all overlaps."""
    read = lambda row, name, kind: np.frombuffer(row[name].as_buffer(), kind)
    for i in range(batch.num_rows):
        row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
        (ca, na, ma, ga), (cb, nb, mb, gb) = ((read(row, "classes" + e, np.int64), read(row, "sizes" + e, np.int64), read(row, "copies" + e, np.int64), read(row, "grams" + e, np.uint64)) for e in ("", "_b"))
        overlap = product((ga, na), (gb, nb)).astype(np.int64)
        yield ca, ma, cb, mb, (100 * overlap >= percent * (na[:, None] + nb[None, :] - overlap)) & (ca[:, None] != cb[None, :]), overlap


def links(docs: DataFrame, sizes: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, n): links between classes that span every component, n null; and, b null, how many rows of other classes link with a's, in parts.

    The spanning links are not all of a component's; all_links has them.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, classes, sums = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for ca, ma, cb, mb, linked, _ in _linked(batch, percent):
                x, y = np.nonzero(linked)
                kept += _forest(np.stack([x, len(ca) + y], axis=1), np.concatenate([ca, cb]))
                both = [(ca, linked @ mb)] if np.array_equal(ca, cb) else [(ca, linked @ mb), (cb, ma @ linked)]
                for c, n in both:
                    classes.append(c[n > 0])
                    sums.append(n[n > 0])
            a, n = np.concatenate(classes), np.concatenate(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in kept] + a.tolist(), pa.int64()), pa.array([b for _, b in kept] + [None] * len(a), pa.int64()), pa.array([None] * len(kept) + n.tolist(), pa.int64())],
                ["a", "b", "n"],
            )

    return _block_pairs(docs, sizes, words, percent, id_col, text_col).mapInArrow(multiply, "a bigint, b bigint, n bigint")


def all_links(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n_a, n_b, overlap): every pair of linked classes once, each class by the least id of its rows, with their sizes and overlap.

    A class is all rows with the same n-grams; links between rows of one class aren't listed.
    """
    members = written(_members(docs, words, id_col, text_col))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ca, _, cb, _, linked, overlap in _linked(batch, percent):
                x, y = np.nonzero(np.triu(linked) if np.array_equal(ca, cb) else linked)
                yield pa.RecordBatch.from_arrays([pa.array(ca[x]), pa.array(cb[y]), pa.array(overlap[x, y])], ["class_a", "class_b", "overlap"])

    classes = _classes(members)
    found = _block_pairs(docs, classes, words, percent, id_col, text_col).mapInArrow(listed, "class_a bigint, class_b bigint, overlap bigint")
    own = classes.select("class", F.col("least_id").alias("id"), F.col("n_shingles").alias("n"))
    for e in ("a", "b"):
        found = found.join(own.toDF(f"class_{e}", e, f"n_{e}"), f"class_{e}")
    return found.select("a", "b", "n_a", "n_b", "overlap")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row: the least id that links reach, its own included, and how many other rows link with it.

    Rows link when the overlap of their n-gram sets is at least percent / 100 of the union. Fewer words than an n-gram are
    one n-gram; a text without words, or null, has none and links with nothing. Rows of equal id and different text are
    documents of their own; a null id is never a component's id unless it is alone.
    """
    with temporary(docs.sparkSession):
        members, rooted = _rooted(docs, words, percent, id_col, text_col)
    joined = spread_join(members, rooted.drop("copies"), "class", "left", counts=rooted.select("class", F.col("copies").alias("n")))
    return joined.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _rooted(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Members, and (class, copies, component_id, n_links) of every class, as written tables that stay."""
    members = written(_members(docs, words, id_col, text_col), stays=True)
    sizes = _classes(members)
    found = written(links(docs, sizes, words, percent, id_col, text_col))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    others = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    classes = sizes.join(others, "class", "left")
    rooted = classes.join(roots, classes["class"] == roots.node, "left").select("class", "copies", "least_id", F.coalesce("root", "class").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    rooted = written(rooted)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return members, written(spread_join(rooted, least, "root").select("class", "copies", "component_id", "n_links"), stays=True)
