import random

import numpy as np

from millrace.llm import quality


def good(seed):
    r = random.Random(seed)
    return "\n".join(" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(12)).capitalize() + "." for _ in range(r.randint(1, 6)))


def bad(seed):
    r = random.Random(seed)
    return [good(seed).upper().replace(" ", "!! "), "spam " * 60, good(seed).replace(" ", "$$ ")][r.randrange(3)]


def test_statistics_of_one_text_do_not_depend_on_others():
    texts = [good(1), "", bad(2), "é ß 1 !", " \n "]
    together = quality.statistics(texts)
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(quality.statistics([t])[0], row)
    assert not together[1].any()


def test_fit_score_and_edge_cases(spark):
    rows = [(i, bad(i) if i % 4 == 0 else good(i)) for i in range(800)]
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (None, "x"), (3, "again twice")], "doc_id long, text string").selectExpr("*", "1 AS score", "'y' AS quality")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs.where("doc_id < 800"), labels)
    assert 0 < len(model.rules) < 200
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert np.mean([got[i].predicted == int(i % 4 != 0) for i in range(400, 800)]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    texts = [t or "" for _, t in rows[:50]]
    assert np.allclose(model.score(quality.statistics(texts)), [got[i].score for i in range(50) if i != 3][:3] + [quality_of(model, texts[3])] + [got[i].score for i in range(4, 50)])
    one = quality.fit(docs, labels.where("quality = 1"))
    assert {r.predicted for r in quality.score(docs, one).collect()} == {1}
    none = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.where("false"), model).collect() == []


def quality_of(model, text):
    return model.score(quality.statistics([text]))[0]
