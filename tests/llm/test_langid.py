import random

import numpy as np

from millrace.llm import langid

SYLLABLES = {"aa": ["the", "ing", "on", "ed"], "bb": ["ción", "os", "que", "ñ"], "cc": ["sch", "ß", "ung", "ö"]}


def text(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def brute_grams(t):
    out, word = [], ""
    for ch in t.lower() + "\n":
        if ch.isalpha():
            word += ch
            continue
        padded = f"\0{word}\0"
        out += [padded[i : i + n] for n in langid.SIZES for i in range(len(padded) - n + 1)] if word else []
        word = ""
    return out


def test_grams_match_brute_force():
    texts = ["The CAT, sat.\n\n9x a", "", "é", "..", "straße İ"]
    keys, doc = langid.grams(texts)
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) << 2 | len(g)
    for i, t in enumerate(texts):
        assert sorted(keys[doc == i].tolist()) == sorted(code(g) for g in brute_grams(t))


def test_held_out_accuracy_and_edge_cases(spark):
    rows = [(i, text(lang, 5 + i % 60, i), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(900 + i, text("aa", 40, i), "bb") for i in range(4)] + [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !", None), (1003, "the", None), (1003, "the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "doc_id < 120 AND doc_id % 3 < 3 AS train")
    model = langid.fit(docs.where("train OR doc_id BETWEEN 900 AND 1000"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[120:180])
    assert all(0 <= r.score <= 1 for r in got.values())
    for key in (1000, 1001, 1002):
        assert (got[key].lang_pred, got[key].score) == ("und", 0.0)
    assert got[1003].lang_pred == "aa" and langid.predict(docs, model).count() == len(rows)
    nothing = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).collect() == []


def test_filters_have_no_false_negatives_and_the_expected_false_positives(spark):
    rows = [(text(lang, 400, i), lang) for i, lang in enumerate(list(SYLLABLES) * 3)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    keys = np.unique(langid.grams([t for t, lang in rows if lang == "bb"])[0])
    mask = np.bitwise_and.reduce([model.table[c, 0] for c in langid._cells(keys, model.bits)])
    k = model.languages.index("bb")
    assert (mask >> np.uint64(k) & np.uint64(1)).mean() > 0.8
    absent = np.arange(1, 20_000, dtype=np.int64) << 50
    mask = np.bitwise_and.reduce([model.table[c, 0] for c in langid._cells(absent, model.bits)])
    assert abs((mask >> np.uint64(k) & np.uint64(1)).mean() - model.false[k]) < 0.01


def test_large_scripts_do_not_fill_the_filter(spark):
    r = random.Random(0)
    text = "".join(chr(0x4E00 + r.randrange(20_000)) for _ in range(80_000))  # about 160,000 n-grams
    model = langid.fit(spark.createDataFrame([("zh", text)] * 3 + [("en", "some plain words here")] * 3, "lang string, text string"))
    assert (model.table != 0).mean() < langid.HASHES / langid.CELLS_PER_GRAM and model.false.max() < 0.01
