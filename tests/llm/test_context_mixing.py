import math
import random
from collections import Counter

import numpy as np

from millrace.llm import context_mixing as cm


def text(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice(["the", "ing", "on", "st", "ea"]) for _ in range(r.randint(2, 6))) for _ in range(n)]
    return " ".join(words) + "."


def seen(words, sees, i):
    """What a predictor sees at byte i of a text's stream, word for word."""
    stream = b"".join(w + b" " for w in words) + b"\n"
    assert i < len(stream)
    done = stream[:i].split(b" ")
    if sees == "word":
        return done[-1]
    return (done[-2] if len(done) > 1 else b"", done[-1]) if sees == "words" else stream[:i].rjust(sees, b"\n")[len(stream[:i].rjust(sees, b"\n")) - sees :]


def test_contexts_match_brute_force():
    texts = [t.encode().split() for t in ("the thing on the thing", "", "on", "the thing sting " * 3, "a b")]
    data, keep, sizes = cm.streams(texts)
    assert sizes.tolist() == [sum(map(len, t)) + len(t) + 1 for t in texts]
    places = [(t, i) for t, n in zip(texts, sizes.tolist(), strict=True) for i in range(n)]
    for sees, h in zip(cm.PREDICTORS, cm.contexts(data), strict=True):
        found = {}
        for (t, i), x in zip(places, h[keep].tolist(), strict=True):
            assert found.setdefault(seen(t, sees, i), x) == x
        assert len(set(found.values())) == len(found)


def test_prefix_code():
    counts = np.random.RandomState(0).randint(0, 1000, 256) ** 2
    ways = cm.paths(counts.tolist())
    assert abs(sum(2.0 ** -len(w) for w in ways) - 1) < 1e-12 and len({tuple(b for _, b in w) for w in ways}) == 256
    assert all(len(ways[a]) >= len(ways[b]) for a in range(256) for b in range(256) if counts[a] < counts[b])


def plain_cost(model, counts, words):
    """The cost of a text bit by bit, from dictionaries of what each predictor has seen."""
    stream, total = b"".join(w + b" " for w in words) + b"\n", 0.0
    for i, byte in enumerate(stream):
        way = cm.paths(counts["bytes"])[byte]
        for j, (node, bit) in enumerate(way):
            line, bits = way[j - j % 4][0], tuple(b for _, b in way[j - j % 4 : j])
            x, level = [], []
            for sees in cm.PREDICTORS:
                n0, n1 = counts["bits"][sees, seen(words, sees, i), line, bits]
                x.append(max(-cm.BOUND, min(cm.BOUND, math.log((n1 + cm.PRIOR) / (n0 + cm.PRIOR)))))
                level.append(min(int(math.log2(sum(counts["bits"][sees, seen(words, sees, i), line, ()]) + 1)), cm.LEVELS - 1))
            gate = level[cm.GATES[0]] * cm.LEVELS + level[cm.GATES[1]]
            z = max(-cm.BOUND, min(cm.BOUND, sum(w * v for w, v in zip(model.weights[gate].tolist(), x, strict=True))))
            at = min(int((z + cm.BOUND) * cm.BUCKETS / (2 * cm.BOUND)), cm.BUCKETS - 1)
            z = (z + model.refined[node * cm.BUCKETS + at]) / 2
            total -= math.log10(1 + math.exp(-z if bit else z))
    return total


def test_model_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cm, "SETTLED", 500)
    monkeypatch.setattr(cm, "LEAST_BITS", 18)
    texts = [text(i, 8) for i in range(40)]
    counts = {"bytes": [0] * 256, "bits": Counter()}
    words = [cm.words_of(t) for t in texts]
    for t in words:
        for b in b"".join(w + b" " for w in t) + b"\n":
            counts["bytes"][b] += 1
    ways, found = cm.paths(counts["bytes"]), {}
    for t in words:
        stream = b"".join(w + b" " for w in t) + b"\n"
        for i, byte in enumerate(stream):
            for j, (_, bit) in enumerate(ways[byte]):
                key = ways[byte][j - j % 4][0], tuple(b for _, b in ways[byte][j - j % 4 : j])
                for sees in cm.PREDICTORS:
                    found.setdefault((sees, seen(t, sees, i), *key), [0, 0])[bit] += 1
    counts["bits"] = type("Seen", (dict,), {"__missing__": lambda self, key: (0, 0)})(found)
    model = cm.fit(spark.createDataFrame([(t,) for t in texts], "text string"), np.array(counts["bytes"]), len(texts))
    some = [words[0][:3], cm.words_of(text(99, 3)), []]
    for got, t in zip(model.cost(some), some, strict=True):
        want = plain_cost(model, counts, t)
        assert abs(got - want) < 0.05 * abs(want)  # a few contexts collide in small tables


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, text(i % 150)) for i in range(200)], "doc_id long, text string").selectExpr("*", "doc_id % 7 = 2 AS held_out")
    found = []
    for n in (4, 9, 211):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted((r.doc_id, r.score) for r in cm.score(docs.repartition(n % 8 + 1), "held_out").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] == found[2]


def test_long_text_costs_as_its_parts(monkeypatch):
    model = cm.Model(cm.Code(np.arange(256)), [14] * 6, np.random.RandomState(1).normal(size=6 * ((1 << 14) + cm.LINE)).astype(np.float32), [np.zeros((1 << 14) + cm.LINE, np.int8)] * 2)
    long = cm.words_of(text(5, 3_000))
    whole = model.cost([long])
    monkeypatch.setattr(cm, "SLICE", 1_000)
    assert np.allclose(model.cost([long]), whole)


def test_scores(spark):
    rows = [(i, text(i)) for i in range(120)] + [(500, None), (501, ""), (502, " \n "), (503, "THE É the"), (503, "THE É the"), (None, "no id"), (504, "x" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "coalesce(doc_id % 7 = 2, false) AS held_out", "1 AS block", "'a' AS score")
    got = cm.score(docs, "held_out").collect()
    assert len(got) == len(rows)
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda k: k is not None and k % 7 == 2
    count = Counter(w for k, t in rows if not held(k) for w in words(t))
    total, distinct = sum(count.values()), len(count)
    base = {}
    for k, t in rows:
        own = words(t)
        base[k] = (len(own), sum(count[w] > 0 for w in own), sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own))
    for r in got:
        n, known, want = base[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - want) < 1e-6 and r.score < 0
    fresh = [r for r in got if r.held_out and r.doc_id < 120]
    plain = Counter(b"".join(w + b" " for k, t in rows[:120] if not held(k) for w in words(t)[:-1]))
    entropy = -sum(n / plain.total() * math.log2(n / plain.total()) for n in plain.values())
    assert np.mean([r.bits_per_byte for r in fresh]) < 0.8 * entropy
    assert len({r.score for r in got if r.doc_id == 503}) == 1
    nothing = cm.score(docs.where("held_out"), "held_out").collect()
    assert {r.train_tokens for r in nothing} == {0} and cm.score(docs.where("false"), "held_out").collect() == []




def test_all_training_texts_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(cm, "LEARN_DOCS", 4)  # ten shards
    texts = [text(i) for i in range(40)]
    histogram = np.bincount(np.concatenate([d[k] for d, k, _ in [cm.streams([cm.words_of(t)]) for t in texts]]), minlength=256)
    docs = spark.createDataFrame([(t,) for t in texts + texts[:7]], "text string")
    learned = []
    for n in (2, 5):
        model = cm.fit(docs.repartition(n), histogram, 47)
        learned.append((model.weights.tolist(), model.refined.tolist()))
    assert learned[0] == learned[1]
    # each shard by itself, every different text in the order of its hash
    counts = np.zeros(2 * cm._first(model.width, len(model.width)), np.float32)
    for t in texts + texts[:7]:
        for b in cm._bits(model.code, model.width, [cm.words_of(t)]):
            for k in range(len(cm.PREDICTORS)):
                np.add.at(counts, b.slots(k) * 2 + model.code.bit[b.of], 1)
    shards = {}
    for r in sorted(docs.distinct().selectExpr("xxhash64(text) AS key", "text").collect()):
        shards.setdefault(r.key % 11, []).append(r.text)
    assert sum(map(len, shards.values())) == 40 and len(shards) > 5
    want, n = 0, 0
    for own in shards.values():
        share = sum(map(len, own)) // 1000 + 1
        want = want + share * cm._learn(model.code, model.width, counts, cm._parts([cm.words_of(t) for t in own], cm.STEP))[0].astype(float)
        n += share
    assert np.abs(model.weights - want / n).max() < 1e-5 and np.abs(model.weights - 0.3).max() > 0.01


def test_shards_are_learned_at_once(spark, monkeypatch):
    """All tasks of the shards run in one job, which writes; read from the driver one by one they would wait for each other."""
    docs = spark.createDataFrame([(i, "some text of number %d" % i) for i in range(40)], "doc_id long, text string").selectExpr("*", "doc_id % 7 = 2 AS held_out")
    tasks, written = {}, cm.written

    def noted(df):
        out = written(df)
        tasks[tuple(df.columns)] = df.rdd.getNumPartitions()
        return out

    monkeypatch.setattr(cm, "written", noted)
    monkeypatch.setattr(cm, "LEARN_DOCS", 5)
    cm.score(docs, "held_out")
    assert tasks["weights", "map", "n"] > 1


def test_counts_without_the_own_occurrence():
    width = [14] * 6
    counts = np.random.default_rng(1).integers(0, 9, 2 * cm._first(width, 6)).astype(np.float32)
    odds, level = cm._left_out(width, counts)
    zeros, ones = counts[::2], counts[1::2]
    assert np.array_equal(odds[::2], cm._odds(np.maximum(zeros - np.float32(1), 0), ones))
    assert np.array_equal(odds[1::2], cm._odds(zeros, np.maximum(ones - np.float32(1), 0)))
    for k, own in zip(cm.GATES, level, strict=True):
        at = slice(cm._first(width, k), cm._first(width, k + 1))
        assert np.array_equal(own, cm._level(np.maximum(zeros[at] + ones[at] - np.float32(1), 0)))


def test_equal_lines_are_counted_together(monkeypatch):
    words = [cm.words_of(text(i, 20)) for i in range(30)] + [[], [b"\xff\x00rare" * 40]]
    code, width = cm.Code(np.bincount(np.concatenate([cm.streams([w])[0] for w in words]), minlength=256)), [14] * 6
    want, lines = np.zeros(2 * cm._first(width, 6), np.uint32), 0
    for b in cm._bits(code, width, words):
        lines += len(b.entry)
        for k in range(len(cm.PREDICTORS)):
            np.add.at(want, b.slots(k) * 2 + code.bit[b.of], 1)
    added, add = [], np.add

    class Add:
        def __getattr__(self, name):
            return getattr(add, name)

        def __call__(self, *args, **kwargs):
            return add(*args, **kwargs)

        def at(self, total, slots, times):
            added.append(len(slots))
            add.at(total, slots, times)

    for gather in (1 << 16, 500, 70):
        monkeypatch.setattr(cm, "GATHER", gather)
        total = np.zeros_like(want)
        with monkeypatch.context() as m:
            m.setattr(np, "add", Add())
            cm._count(code, width, total, words)
        assert np.array_equal(total, want)
        if gather == 1 << 16:
            assert sum(added) < 0.6 * 4 * lines * len(cm.PREDICTORS)


def test_steps_are_read_together(monkeypatch):
    """Several steps' features are looked up at once; what is learned is the same as step by step."""
    monkeypatch.setattr(cm, "SETTLED", 2_000)
    words = [cm.words_of(text(i, 20)) for i in range(60)] + [[], cm.words_of(text(99, 400))]
    width = [14] * 6
    code, counts = cm.Code(np.bincount(np.concatenate([cm.streams([w])[0] for w in words]), minlength=256)), np.zeros(2 * cm._first(width, 6), np.float32)
    cm._count(code, width, counts, words)
    read, made = cm.Bits.read, []
    monkeypatch.setattr(cm.Bits, "read", lambda *args: made.append(len(args[4])) or read(*args))
    parts, found = list(cm._parts(words, 300)), []
    for size in (48_000, 1_000, 1):
        made.clear()
        monkeypatch.setattr(cm, "LEARN_SLICE", size)
        found.append((*cm._learn(code, width, counts, iter(parts)), len(made)))
    assert [x[2] for x in found][::2] == [1, len(parts)] and len(parts) > 20
    for weights, cells, _ in found[1:]:
        assert np.abs(weights - found[0][0]).max() < 1e-5 and abs(cells.sum() - found[0][1].sum()) < 1
    assert found[0][1].sum() > 0


def test_java_does_as_numpy(spark, monkeypatch):
    """Counts, weights, map and costs of Mixing.java against the functions in numpy, a text over several slices included."""
    monkeypatch.setattr(cm, "SETTLED", 3_000)
    monkeypatch.setattr(cm, "SLICE", 1_500)
    monkeypatch.setattr(cm, "LEARN_SLICE", 1_500)
    monkeypatch.setattr(cm, "STEP", 400)
    texts = [text(i, 20) for i in range(60)] + ["", " \t\r\n\x0b\x0c ", "É THE\x1cthe\xa0ÜBER   \U0001f600", text(99, 400), "the the the the"]
    words = [cm.words_of(t) for t in texts]
    histogram = np.bincount(np.concatenate([d[k] for d, k, _ in [cm.streams([w]) for w in words]]), minlength=256)
    model = cm.fit(spark.createDataFrame([(t,) for t in texts + texts[:9]], "text string").coalesce(1), histogram, len(texts) + 9)
    counts = np.zeros(2 * cm._first(model.width, len(model.width)), np.float32)
    cm._count(model.code, model.width, counts, words + words[:9])
    assert np.array_equal(model.odds, cm._odds(counts[::2], counts[1::2]))
    order = [r.text for r in spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("xxhash64(text) AS key", "text").sort("key", "text").collect()]
    weights, found = cm._learn(model.code, model.width, counts, cm._parts([cm.words_of(t) for t in order], cm.STEP))
    assert np.abs(model.weights - weights).max() < 1e-5 and np.abs(weights - 0.3).max() > 0.01
    n0, n1 = found.reshape(-1, 2).T
    centre = (np.arange(cm.BUCKETS) + 0.5) * (2 * cm.BOUND / cm.BUCKETS) - cm.BOUND
    prior = 8 / (1 + np.exp(-np.tile(centre, 256)))
    refined = np.log((n1 + prior) / (n0 + 8 - prior))
    assert found.sum() > 0 and (np.abs(model.refined - refined) > 1e-4).mean() < 0.001  # a sum at a bucket's edge
    some = [*texts, "new words", "x" * 3_000, *texts]
    frame = spark.createDataFrame(list(enumerate(some)), "id int, text string").coalesce(1)
    got = [r.c for r in frame.select("id", cm._costs(spark, model, frame.text).alias("c")).sort("id").collect()]
    want = model.cost([cm.words_of(t) for t in some])
    assert np.allclose(got, want, rtol=1e-5, atol=1e-5) and got[: len(texts)] == got[-len(texts) :]
