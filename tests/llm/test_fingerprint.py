import hashlib
import random

import numpy as np

from millrace.llm import fingerprint as fp


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlé") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_entropy_classes_match_brute_force():
    data = np.frombuffer((words(60, 1) + "aaaa" * 20).encode(), np.uint8)
    got = fp._entropy_classes(data)
    for i in range(len(data) - fp.WINDOW + 1):
        counts = np.unique(data[i : i + fp.WINDOW], return_counts=True)[1]
        assert got[i] == sum(fp._F[c] for c in counts) * (fp.CLASSES - 1) // fp._F[fp.WINDOW]


def test_digest_does_not_depend_on_its_neighbours():
    texts = [words(200, 2), "", "short", words(900, 3), words(200, 2), "x" * 500]
    ranks = fp.rarity(np.arange(fp.CLASSES))
    together = fp.digest(texts, ranks)
    for text, own in zip(texts, together, strict=True):
        assert np.array_equal(fp.digest([text], ranks)[0], own)
        assert bool(text) == bool(len(own))
    assert fp.likeness(together[0], together[4]) == 1.0
    assert fp.likeness(together[1], together[1]) == 1.0 and fp.likeness(together[1], together[0]) == 0.0
    assert fp.likeness(together[0], together[3]) < 0.1
    half = fp.edited(texts[3], words(900, 9))
    assert 0.3 < fp.likeness(together[3], fp.digest([half], ranks)[0]) < 0.8


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS range", "'a' AS fingerprint")
    ranks = fp.rarity(fp.class_counts(docs))
    got = [r.asDict() for r in fp.edit_likeness(docs, ranks).collect()]
    order = sorted(((k, t or "") for k, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for i, (key, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        mixed = fp.edited(text, nxt)
        a, b, c = fp.digest([text, mixed, nxt], ranks)
        want.append({"doc_id": key, "n_chars": len(text), "edited_sha256": hashlib.sha256(mixed.encode()).hexdigest(), "fingerprint": fp.as_text(a), "edited_fingerprint": fp.as_text(b), "near_edited": fp.likeness(a, b), "near_next": fp.likeness(a, c)})
    show = lambda rows: sorted(str(sorted(r.items())) for r in rows)
    assert show(got) == show(want)


def test_next_documents(spark):
    check(spark, [(3 * i % 101, words(i % 40 * 5, i)) for i in range(100)] + [(None, "no id"), (None, None), (7000, None), (7000, "twice"), (7000, "twice"), (5, "again " * 30)])
    check(spark, [(4, "alone " * 20)])
    check(spark, [(None, "a b"), (None, "c d")])
    assert fp.edit_likeness(spark.createDataFrame([], "doc_id long, text string")).collect() == []
