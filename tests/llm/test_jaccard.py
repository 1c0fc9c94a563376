import random
from pathlib import Path

import numpy as np
import pytest

from millrace.llm import jaccard
from millrace.llm.common import shared_dir


def brute(rows, n, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for own in groups.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in own]
    return sorted(map(str, out))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_against_brute_force(spark, monkeypatch, n, percent):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 300)  # several blocks in a cluster
    monkeypatch.setattr(jaccard, "ROW_GRAMS", 1)
    r = random.Random(n)
    vocabulary = ["w%d" % i for i in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(3, 90))] for _ in range(12)]
    passage = [r.choice(vocabulary) for _ in range(20)]
    rows = []
    for i in range(220):
        words = list(r.choice(bases))
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        if i % 5 == 0:
            words = passage + words[: r.randint(0, 12)]
        rows.append((1000 - i, r.choice([" ", "\n", " \t"]).join(words)))
    rows += [(5000 + i, " ".join(bases[0])) for i in range(30)] + [(1, None), (2, ""), (3, " \n"), (4, "one"), (6, "ONE"), (7, "two words"), (7, "other text of the same id here"), (None, "one"), (None, "nobody else has this one text"), (8, "long " * 3000), (9, "long " * 3001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS class", "1 AS root")
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.near_duplicates(docs, n, percent).collect())
    assert got == brute(rows, n, percent)


def test_no_rows(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_product():
    r = np.random.RandomState(0)
    rows = [np.unique(r.randint(0, 50, 20)).astype(np.uint64) for _ in range(9)]
    block = lambda x: (np.concatenate(x), np.array([len(y) for y in x]))
    got = jaccard.product(block(rows[:4]), block(rows[4:]))
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in rows[4:]] for a in rows[:4]]


def test_packed_columns():
    r = np.random.RandomState(1)
    for n, top in ((0, 9), (1, 1), (500, 1 << 24), (5000, 6000)):
        x = np.unique(r.randint(0, top, n)).astype(np.int64)
        assert jaccard._unpacked(jaccard._packed(x)).tolist() == x.tolist()


def test_sets_of_one_text_do_not_depend_on_others():
    texts = ["", "a b c d e a b c d e", "A\tB\nc", " \x0b ", "é é é é é", "x" * 3000 + " y z w"]
    own = jaccard.Shingler(4)
    for t, s in zip(texts, own.sets(texts), strict=True):
        assert s.tolist() == jaccard.Shingler(4).sets([t])[0].tolist()
    assert [len(s) for s in own.sets(texts)] == [0, 5, 1, 0, 1, 1]


def test_links_of_every_row(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 150)  # several blocks in a cluster
    monkeypatch.setattr(jaccard, "ROW_GRAMS", 1)
    r = random.Random(8)
    bases = [[f"b{b}w{i}" for i in range(r.randint(20, 60))] for b in range(4)]
    rows = []
    for i in range(80):
        words = list(bases[i % 4])
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "x%d" % r.randrange(5)
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(bases[0])) for i in range(5)] + [(300, None), (301, "alone here")]
    sets = [frozenset(zip(w, w[1:], strict=False)) if len(w := (t or "").split()) > 1 else frozenset() for _, t in rows]
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= 70 * len(a | b)
    want = {rows[i][0]: sum(i != j and linked(sets[i], sets[j]) for j in range(len(rows))) for i in range(len(rows))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.n_links for x in jaccard.near_duplicates(docs, 2, 70).collect()} == want
    least = {}
    for (k, _), s in zip(rows, sets, strict=True):
        least.setdefault(s, k)
    pairs = {(min(least[a], least[b]), max(least[a], least[b]), len(a & b)) for a in least for b in least if a != b and linked(a, b)}
    got = [(min(x.a, x.b), max(x.a, x.b), x.overlap) for x in jaccard.all_links(docs, 2, 70).collect()]
    assert sorted(got) == sorted(pairs) and len(pairs) > 100


def test_copies_share_no_columns(spark):
    """Rows of one class count once in the map of shared columns, and ids that are null or repeated lose no class."""
    texts = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(30)]
    rows = [(100 * copy + k, t) for copy in range(8) for k, t in enumerate(texts)]
    near = texts[0] + " one more word"
    rows += [(5, near), (None, near), (None, "a text with no id of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = jaccard._classes(jaccard._members(docs, 4, "doc_id", "text"))
    assert sizes.count() == 32
    first = spark.sparkContext.broadcast(jaccard._first_rows(sizes, 32))
    shared, hot = jaccard._shared_columns(docs, first, 30 * 37 + 80, 4, "doc_id", "text")
    assert int(np.unpackbits(shared).sum()) < 60 and int(np.unpackbits(hot).sum()) == 0  # 37 columns of the first text and its near copy
    got = {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs, 4, 85).collect()}
    want = {(100 * copy + k, k) for copy in range(8) for k in range(1, 30)} | {(100 * copy, 0) for copy in range(8)} | {(5, 0), (None, 0), (None, None)}
    assert got == want


def test_hot_columns_come_last(spark):
    """Classes that share frequent columns alone don't become one cluster by them while they have others in common with a copy."""
    common = [f"c{i}" for i in range(8)]
    rows = []
    for k in range(40):
        own = [f"t{k}w{i}" for i in range(60)]
        rows += [(2 * k, " ".join(common + own)), (2 * k + 1, " ".join([*common, *own, "end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members = jaccard._members(docs, 4, "doc_id", "text")
    pairs = jaccard._block_pairs(docs, jaccard._classes(members), 4, 85, "doc_id", "text")
    assert max(len(r.classes) // 8 for r in pairs.collect()) == 2
    got = {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs, 4, 85).collect()}
    assert got == {(i, i - i % 2) for i in range(80)}


def test_components_by_one_task_and_by_stars(spark, monkeypatch):
    r = random.Random(3)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(260)] + [(5, 5), (400, 401), (401, 400)]
    df = spark.createDataFrame(edges, "a long, b long")
    few = sorted(map(tuple, jaccard.components(df).collect()))
    monkeypatch.setattr(jaccard, "FEW", 0)
    assert few == sorted(map(tuple, jaccard.components(df).collect())) and (401, 400) in few
    assert jaccard.components(df.where("false")).count() == 0


def test_classes_beyond_a_broadcast(spark, monkeypatch):
    """With nothing few enough the same rows come out."""
    r = random.Random(4)
    base = [r.choice("abcdefghij") for _ in range(40)]
    rows = [(i, " ".join([*base[:20], str(i % 7), *base[20:]])) for i in range(30)] + [(None, " ".join(base)), (50, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(str, jaccard.near_duplicates(docs).collect()))
    monkeypatch.setattr(jaccard, "FEW", 0)
    assert few == sorted(map(str, jaccard.near_duplicates(docs).collect()))


def test_temporaries_go(spark):
    """Of what a run writes only the tables that its result reads stay."""
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    docs = spark.createDataFrame([(i, "some words that come in all of them %d" % (i % 3)) for i in range(20)], "doc_id long, text string")
    found = jaccard.near_duplicates(docs, 2, 60)
    assert found.count() == 20 and len(set(shared.iterdir()) - before) <= 3
