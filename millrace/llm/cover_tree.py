"""Exact top-k search by inner product with cover trees over queries and data.

Vectors are dealt to cells around pivots, the top level of the tree, and cells to blocks; each block is a cover tree whose
level i covers within BASE ** i. A block of queries, a tree too, first searches its own cell, then, with the kth scores found
there, the cells that it can't rule out. Each node of the query tree carries the data nodes left to it: a pair is pruned if
its bound, from the centres' product and the covering radii, is under the worst kth score of the query node.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import input_partitions, written

#: Vectors that pivots are chosen from and that bound each query's kth score from below; pivots at most.
SAMPLE, PIVOTS = 1024, 64
#: What a level's radius shrinks by to the next; vectors of a leaf; of a block at least and at most; scored at once.
BASE, LEAF, LEAST_BLOCK, MOST_BLOCK, BATCH = 1.3, 8, 64, 4096, 512
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as 64-bit integers; what is beyond them is their end."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, NONE + 1, LAST).astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers as the smallest integers that hold them; as they are beyond 32 bits."""
    most = np.abs(x).max(initial=0)
    return next((x.astype(kind) for kind in (np.int8, np.int16, np.int32) if most <= np.iinfo(kind).max), x)


class Tree:
    """A cover tree over rows of whole numbers, held as doubles.

    A node's centre is a member of it. Its children's centres lie more than their level's radius from each other, and each
    member within that radius of its child's centre; levels that would give one child are passed over. A leaf has LEAF
    members at most, or equal ones. order: members by leaves; of a node: span of its members in that order, radius that
    covers them, children (a range of nodes), and the distance to its parent's centre. places: of members in the input.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = (vectors**2).sum(axis=1)
        order, centre, radius, span, children, parent = [], [], [], [], [], []
        levels: list[int] = []

        def node(c: int, away: float) -> int:
            centre.append(c)
            parent.append(away)
            for held in (radius, span, children, levels):
                held.append(0)
            return len(centre) - 1

        todo = [(node(0, 0.0), np.arange(len(ids)), 0)]
        while todo:
            at, members, depth = todo.pop()
            c = centre[at]
            away = np.sqrt(((vectors[members] - vectors[c]) ** 2).sum(axis=1))
            radius[at], levels[at] = float(away.max()), depth
            span[at], children[at] = [len(order), len(order) + len(members)], [0, 0]
            if len(members) <= LEAF or radius[at] == 0:
                order += members.tolist()
                continue
            # the highest level that doesn't leave all in one child
            reach = BASE ** (math.ceil(math.log(radius[at], BASE)) - 1)
            groups, rest, far, near, pivot = [], members, away, away, c
            while True:
                inside = near <= reach
                inside[rest == pivot] = True
                groups.append((pivot, rest[inside]))
                rest, far = rest[~inside], far[~inside]
                if not len(rest):
                    break
                pivot = int(rest[far.argmax()])
                near = np.sqrt(np.maximum(norms[rest] - 2 * (vectors[rest] @ vectors[pivot]) + norms[pivot], 0))
                far = np.minimum(far, near)
            children[at] = [len(centre), len(centre) + len(groups)]
            new = [(node(p, float(np.sqrt(((vectors[p] - vectors[c]) ** 2).sum()))), own, depth + 1) for p, own in groups]
            todo += new[::-1]  # so that a node's members follow one another
        places = np.array(order, np.int64)
        rank = np.empty(len(places), np.int64)
        rank[places] = np.arange(len(places))
        self.places, self.ids, self.vectors, self.centre = places, ids[places], vectors[places], rank[centre]
        self.radii, self.parents = np.array(radius, float), np.array(parent, float)
        self.span, self.children = np.array(span, np.int64).reshape(-1, 2), np.array(children, np.int64).reshape(-1, 2)
        self.depth = max(levels) + 1
        self._derive()

    def _derive(self) -> None:
        self.centres = self.vectors[self.centre]
        self.lengths = np.sqrt((self.centres**2).sum(axis=1))

    def __getstate__(self) -> dict:
        """What is sent: whole numbers in the fewest bytes that hold them, and nothing that follows from the rest."""
        state = {k: v for k, v in self.__dict__.items() if k not in ("centres", "lengths")}
        return {k: _narrow(v) if k in ("vectors", "places", "centre", "span", "children") else v for k, v in state.items()}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.vectors = self.vectors.astype(np.float64)
        for k in ("places", "centre", "span", "children"):
            setattr(self, k, getattr(self, k).astype(np.int64))
        self._derive()


def ranges(bounds: np.ndarray) -> np.ndarray:
    """The numbers of some ranges (from, to), one range after another."""
    sizes = bounds[:, 1] - bounds[:, 0]
    return np.repeat(bounds[:, 0] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def search(queries: Tree, data: Tree, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, pairs scored), k a query, best first; NONE where there are fewer. floor: a kth score that each query has elsewhere, or NONE.

    Rows with the query's id aren't candidates. Ties go to the smaller id.
    """
    scores = np.full((len(queries.ids), k), NONE)
    ids = np.full((len(queries.ids), k), LAST)
    worst = np.where(floor == NONE, -np.inf, floor.astype(np.float64))
    scored = 0

    def slack(q: int, nodes: np.ndarray) -> np.ndarray:
        return 1e-6 + 1e-9 * (queries.lengths[q] + queries.radii[q]) * (data.lengths[nodes] + data.radii[nodes])

    def bound(q: int, nodes: np.ndarray) -> np.ndarray:
        spread = queries.lengths[q] * data.radii[nodes] + data.lengths[nodes] * queries.radii[q] + queries.radii[q] * data.radii[nodes]
        return data.centres[nodes] @ queries.centres[q] + spread + slack(q, nodes)

    def score(q: int, nodes: np.ndarray, best: np.ndarray) -> None:
        """All members of query leaf q against those of data leaves, by falling bound."""
        nonlocal scored
        q0, q1 = queries.span[q]
        order = np.argsort(-best)
        nodes, best = nodes[order], best[order]
        while len(nodes):
            left = best >= worst[q0:q1].min()
            nodes, best = nodes[left], best[left]
            size = np.cumsum(data.span[nodes, 1] - data.span[nodes, 0])
            n = max(1, int(np.searchsorted(size, BATCH, "right")))
            rows = ranges(data.span[nodes[:n]])
            nodes, best = nodes[n:], best[n:]
            new = products(queries.vectors[q0:q1], data.vectors[rows])
            scored += new.size
            own = queries.ids[q0:q1, None] == data.ids[None, rows]
            all_scores = np.concatenate([scores[q0:q1], np.where(own, NONE, new)], axis=1)
            all_ids = np.concatenate([ids[q0:q1], np.where(own, LAST, data.ids[None, rows])], axis=1)
            first = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]  # ~x falls as x rises
            scores[q0:q1], ids[q0:q1] = np.take_along_axis(all_scores, first, axis=1), np.take_along_axis(all_ids, first, axis=1)
            kth = scores[q0:q1, k - 1]
            worst[q0:q1] = np.maximum(worst[q0:q1], np.where(kth == NONE, -np.inf, kth.astype(np.float64)))

    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        q, nodes = todo.pop()
        q0, q1 = queries.span[q]
        into = queries.children[q, 1] > queries.children[q, 0]
        while len(nodes):
            best = bound(q, nodes)
            left = best >= worst[q0:q1].min()
            nodes, best = nodes[left], best[left]
            inner = (data.children[nodes, 1] > data.children[nodes, 0]) & ((data.radii[nodes] >= queries.radii[q]) | (not into))
            if not inner.any():
                break
            children = ranges(data.children[nodes[inner]])
            # what the parent's centre and the distance to it allow, before any product
            above = np.repeat(nodes[inner], data.children[nodes[inner], 1] - data.children[nodes[inner], 0])
            reach = data.parents[children] + data.radii[children]
            most = (data.centres[nodes[inner]] @ queries.centres[q]).repeat(data.children[nodes[inner], 1] - data.children[nodes[inner], 0])
            most = most + queries.lengths[q] * reach + queries.radii[q] * (data.lengths[above] + reach) + slack(q, above)
            nodes = np.concatenate([nodes[~inner], children[most >= worst[q0:q1].min()]])
        if len(nodes) and into:
            todo += [(c, nodes) for c in range(*queries.children[q])]
        elif len(nodes):
            score(q, nodes, best)
    return scores, ids, scored


def _pivots(sample: np.ndarray) -> np.ndarray:
    """Members of the sample, each the farthest from those before."""
    if not len(sample):
        return sample
    chosen, away = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < PIVOTS and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer products with other rows; ties to the smaller id.

    A component x counts as floor(scale * x), as a whole number of any size; scores beyond 64 bits are their end. Vectors
    that are null or hold a null or non-finite component, null ids and empty vectors take no part; vectors of other lengths
    aren't a query's candidates, nor are rows of its id. Repeated rows are candidates each; as queries they are answered once.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    sound = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda v: F.lit(scale) * v.cast("double"))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.size(x).alias("dim"))
    sample = {}
    # the keys first: each task sends the driver as many rows as it asks for
    keys = rows.select(F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).collect()
    chosen = rows.where(F.xxhash64("id") <= keys[-1]["h"]) if keys else rows.limit(0)
    for r in chosen.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v", "dim").collect():
        sample.setdefault(r["dim"], []).append((r["id"], r["v"]))
    sample = {d: (np.array([i for i, _ in own], np.int64), np.floor(np.array([v for _, v in own], float))) for d, own in sample.items()}
    sent = spark.sparkContext.broadcast({d: (i, v, _pivots(v)) for d, (i, v) in sample.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            cells, away = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            flat = np.floor(batch.column(1).flatten().to_numpy())
            start = np.cumsum(dims, dtype=np.int64) - dims
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                v = flat[start[at][:, None] + np.arange(dim)]
                pivots = sent.value[dim][2] if dim in sent.value else np.zeros((1, dim))
                d = (v**2).sum(axis=1)[:, None] - 2 * v @ pivots.T + (pivots**2).sum(axis=1)[None, :]
                cells[at] = d.argmin(axis=1)
                away[at] = np.sqrt(((v - pivots[cells[at]]) ** 2).sum(axis=1))
            whole = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(dims)).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), whole, *batch.columns[2:], pa.array(cells.astype(np.int32)), pa.array(away)], [*batch.schema.names, "cell", "away"])

    placed = written(rows.mapInArrow(assign, "id bigint, v array<double>, q boolean, dim int, cell int, away double"))
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.count_if("q").alias("nq")).collect()
    total = sum(r["n"] for r in cells)
    size = min(MOST_BLOCK, max(LEAST_BLOCK, total // input_partitions(vectors)))
    layout = [(r["dim"], r["cell"], -(-r["n"] // size), -(-max(1, r["nq"]) // size)) for r in cells]
    table = F.broadcast(spark.createDataFrame(layout, "dim int, cell int, blocks int, query_blocks int"))  # PIVOTS rows a length
    reach = spark.sparkContext.broadcast({(r["dim"], r["cell"]): (r["radius"], -(-r["n"] // size)) for r in cells})
    dealt = placed.join(table, ["dim", "cell"])

    def read(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = rows["id"].to_numpy()
        v = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.lexsort((*v.T[::-1], ids))
        return ids[order], v[order]

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        tree = pickle.dumps(Tree(*read(rows)))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([key[1].as_py()], pa.int32()), "block": pa.array([key[2].as_py()], pa.int32()), "data": pa.array([tree], pa.binary())})

    def aim(nearest: bool):
        """Turns a block of queries into its tree and floors, once, with the data blocks of its own cell, or of the others that it can't rule out."""

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            dim, own = key[0].as_py(), key[1].as_py()
            rows = rows.sort_by([("id", "ascending"), ("version", "ascending")])
            ids, version = rows["id"].to_numpy(), rows["version"].to_numpy()
            v = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            new = np.append(True, (ids[1:] != ids[:-1]) | (version[1:] != version[:-1]))
            tree = Tree(ids[new], v[new])
            floor = rows["floor"].to_numpy()[new][tree.places]
            known, v, pivots = sent.value.get(dim, (np.empty(0, np.int64), np.empty((0, dim)), np.zeros((1, dim))))
            if len(known) >= k:
                found = products(tree.vectors, v)
                found[tree.ids[:, None] == known[None, :]] = NONE
                floor = np.maximum(floor, np.sort(found, axis=1)[:, -k])
            to = []
            for (d, cell), (radius, blocks) in reach.value.items():
                if d == dim and (cell == own) == nearest:
                    length = np.sqrt((pivots[cell] ** 2).sum())
                    most = tree.centres[0] @ pivots[cell] + tree.lengths[0] * radius + length * tree.radii[0] + radius * tree.radii[0]
                    if nearest or most + 1e-6 + 1e-9 * (tree.lengths[0] + tree.radii[0]) * (length + radius) >= floor.min():
                        to += [(cell, b) for b in range(blocks)]
            queries = pickle.dumps((tree, version[new][tree.places], floor))
            targets = pa.array([[{"cell": c, "block": b} for c, b in to]], pa.list_(pa.struct([("cell", pa.int32()), ("block", pa.int32())])))
            return pa.table([pa.array([dim], pa.int32()), targets, pa.array([queries], pa.binary())], ["dim", "targets", "queries"])

        return run

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        """All blocks of queries that meet a data block."""
        columns = [[np.empty(0, np.int64)] for _ in range(4)]
        tree = pickle.loads(data["data"][0].as_py()) if queries.num_rows else None
        for q in queries["queries"]:
            own, version, floor = pickle.loads(q.as_py())
            scores, ids, _ = search(own, tree, k, floor)
            keep = (scores != NONE) & (scores >= floor[:, None])
            which = np.repeat(np.arange(len(own.ids)), keep.sum(axis=1))
            for held, new in zip(columns, (own.ids[which], version[which], ids[keep], scores[keep]), strict=True):
                held.append(new)
        return pa.table([pa.array(np.concatenate(c)) for c in columns], ["query_id", "version", "vec_id", "score"])

    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    cut = dealt.withColumn("block", block("blocks")).select("dim", "cell", "block", "id", "v")
    data = written(cut.groupBy("dim", "cell", "block").applyInArrow(pack, "dim int, cell int, block int, data binary"))
    queries = dealt.where("q").select("dim", "cell", block("query_blocks").alias("part"), "id", "v", F.xxhash64("v").alias("version"))
    order = Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id")

    def found(queries: DataFrame, nearest: bool) -> DataFrame:
        sought = queries.groupBy("dim", "cell", "part").applyInArrow(aim(nearest), "dim int, targets array<struct<cell: int, block: int>>, queries binary")
        sought = sought.select("dim", F.explode("targets").alias("to"), "queries").select("dim", "to.cell", "to.block", "queries")
        place = ("dim", "cell", "block")
        return sought.groupBy(*place).cogroup(data.groupBy(*place)).applyInArrow(run, "query_id bigint, version bigint, vec_id bigint, score bigint")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = written(best(found(queries.withColumn("floor", F.lit(NONE)), True)).drop("rank"))
    kth = near.groupBy(F.col("query_id").alias("id"), "version").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
    floored = queries.join(kth.drop("n"), ["id", "version"], "left").withColumn("floor", F.coalesce("kth", F.lit(NONE))).drop("kth")
    return best(near.unionByName(found(floored, False))).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for op2_cover_tree_top_k over embeddings.
ORACLE_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
