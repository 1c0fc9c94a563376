import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import cover_tree as ct


@pytest.mark.parametrize("spread", [0.02, 1.0, 0.0])
def test_tree_covers(spread):
    r = np.random.RandomState(0)
    v = np.floor(999 * (r.normal(size=(9, 5))[r.randint(0, 9, 600)] + spread * r.normal(size=(600, 5))))
    tree = ct.Tree(np.arange(600), v)
    assert sorted(tree.ids.tolist()) == list(range(600)) and (v[tree.ids] == tree.vectors).all() and tree.depth > 1
    for (a, b), c, r, (x, y) in zip(tree.span, tree.centres, tree.radii, tree.children, strict=True):
        assert np.sqrt(((tree.vectors[a:b] - c) ** 2).sum(axis=1)).max() <= r + 1e-9
        if x < y:
            assert tree.span[x, 0] == a and tree.span[y - 1, 1] == b and (tree.span[x : y - 1, 1] == tree.span[x + 1 : y, 0]).all()
            away = np.sqrt(((tree.centres[x:y, None] - tree.centres[None, x:y]) ** 2).sum(axis=2))
            reach = ct.BASE ** (np.ceil(np.log(r) / np.log(ct.BASE)) - 1)
            assert (away[~np.eye(y - x, dtype=bool)] > reach - 1e-6).all() and (tree.radii[x:y] <= reach + 1e-6).all()
            assert np.allclose(tree.parents[x:y], np.sqrt(((tree.centres[x:y] - c) ** 2).sum(axis=1)))
        else:
            assert b - a <= ct.LEAF or r == 0


@pytest.mark.parametrize("spread,most", [(0.02, 0.2), (1.0, 1.0)])
def test_search_prunes(spread, most):
    """On clustered rows most pairs are never scored; results are exact there and on scattered rows."""
    r = np.random.RandomState(1)
    centres = r.normal(size=(40, 16))
    v = np.floor(256 * (centres[r.randint(0, 40, 4000)] + spread * r.normal(size=(4000, 16))))
    queries, data = ct.Tree(np.arange(0, 4000, 20), v[::20]), ct.Tree(np.arange(4000), v)
    scores, ids, scored = ct.search(queries, data, 5, np.full(200, ct.NONE))
    assert data.depth > 2 and scored <= most * 200 * 4000
    every = (queries.vectors @ v.T).astype(np.int64)
    every[np.arange(200), queries.ids] = ct.NONE
    want = np.lexsort((np.broadcast_to(np.arange(4000), every.shape), ~every), axis=1)[:, :5]
    assert (ids == want).all() and (scores == np.take_along_axis(every, want, axis=1)).all()


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(ct, "SAMPLE", 40)
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(7)]
    rows = [(i, [x + r.gauss(0, spread) for x in centres[i % 7]]) for i in range(700)]
    rows += [(1000 + i, list(rows[0][1])) for i in range(300)] + [(3000, [1e16, 1.0, 0.0, 0.0, 0.0, 0.0]), (3001, [-3e30, 1.0, 2.0, 0.0, 0.0, 5e25])] + [(2000, [1.0, 2.0]), (2050, [0.5, 1.0]), (2100, None), (2101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2150, [float("nan")] * 6), (2200, [math.inf] * 6), (None, [1.0] * 6), (2250, []), rows[50], rows[51]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS q", "'a' AS id")
    got = sorted(tuple(x) for x in ct.top_k(frame, F.col("vec_id") % 50 == 0, 5).collect())
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want, end = [], 2**63 - 1
    for q, own in {i: v for i, v in sound}.items():
        if q % 50 == 0:
            score = lambda v, own=own: max(-end, min(end, sum(a * b for a, b in zip(own, v, strict=True))))
            best = sorted((-score(v), i) for i, v in sound if i != q and len(v) == len(own))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert ct.top_k(frame.where("false"), F.lit(True), 5).collect() == []


def test_repeated_rows_are_candidates_each(spark):
    rows = [(i, [float(10 - i), 1.0]) for i in range(10)]
    thrice = spark.createDataFrame(rows * 3, "vec_id long, embedding array<float>")
    got = sorted(tuple(x) for x in ct.top_k(thrice, F.col("vec_id") % 5 == 0, 5).collect())
    assert [r[2] for r in got if r[0] == 0] == [1, 1, 1, 2, 2] and len(got) == 10


def test_sql_agrees(spark, tmp_path):
    import duckdb

    r = random.Random(5)
    path = str(tmp_path / "embeddings.parquet")
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(301, None), (350, [None] * 8), (302, [1.0, 2.0]), (400, [math.nan] * 8), (None, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    got = ct.top_k(frame, F.col("vec_id") % 50 == 0, 5).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ct.ORACLE_SQL).fetchall())


def test_a_sent_tree_is_small_and_the_same():
    import pickle

    r = np.random.RandomState(3)
    for scale in (100, 1e6, 1e16):
        vectors = np.floor(r.randn(500, 64) * scale)
        tree = ct.Tree(np.arange(500), vectors)
        sent = pickle.dumps(tree)
        again = pickle.loads(sent)
        for name, value in tree.__dict__.items():
            assert np.array_equal(getattr(again, name), value) and np.asarray(getattr(again, name)).dtype == np.asarray(value).dtype
        assert scale > 100 or len(sent) < vectors.nbytes / 2
