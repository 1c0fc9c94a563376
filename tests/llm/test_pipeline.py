from collections import Counter

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import langid, quality
from millrace.llm.common import remainder
from tests.llm.test_jaccard import brute as near_brute
from tests.llm.test_line_templates import brute as line_brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents with copies, repeated rows, nulls, an empty text and extra columns of clashing names."""
    where = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*cp.COLUMNS)
    own = docs.collect()
    good = max(own, key=lambda r: len(r.text or "") if r.lang == "en" else 0).text
    words = good.split(" ")
    words[len(words) // 2] = "altered"
    added = [(9001, good, "en", "s", 1), (9002, " ".join(words), "en", "s", 1), (9003, None, None, None, None), (9004, "", "en", "s", 0), (9005, "one", "en", "s", 3), (9005, "one", "en", "s", 3), (None, good + " and some more", "en", "s", 1)]
    whole = docs.union(spark.createDataFrame(added, docs.schema))
    whole.selectExpr("*", "1 AS piece", "'x' AS class", "0.5D AS score", "true AS predicted", "'y' AS root").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{where}/labels.parquet")
    return str(where)


def rows(df):
    return Counter(map(tuple, df.select("doc_id", "text", "lang", "source").collect()))


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    stages = dict(cp.STAGES)
    assert names == ["quality", "language", "line_dedup", "near_duplicates", "packing"]

    labels = spark.read.parquet(f"{folder}/labels.parquet").where(remainder("doc_id", 5) != 0)
    model = quality.fit(docs.select("doc_id", "text"), labels)
    good = {(r.doc_id, r.text) for r in quality.score(docs.select(*cp.COLUMNS), model, cp.COLUMNS).where("score >= 0.3").collect()}
    kept = cp.written(stages["quality"](spark, docs, folder))
    assert kept.columns == list(cp.COLUMNS) and rows(kept) == Counter({k: n for k, n in rows(docs).items() if k[:2] in good}) and 0 < kept.count() < docs.count()

    learned = langid.fit(kept.where(remainder("doc_id", 4) != 2))
    known = {(r.doc_id, r.text) for r in langid.predict(kept, learned, extra=("text",)).collect() if r.lang_pred != langid.UNDETERMINED and r.score >= cp.LEAST_LANGUAGE}
    spoken = cp.written(stages["language"](spark, kept, folder))
    assert rows(spoken) == Counter({k: n for k, n in rows(kept).items() if k[:2] in known})

    before = [(r.doc_id, r.text) for r in spoken.collect()]
    want = Counter((k, t) for (k, old), t in zip(before, line_brute(before), strict=True) if t == old or (t or "").strip())
    lines = cp.written(stages["line_dedup"](spark, spoken, folder))
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == want and all(r.n_chars == len(r.text or "") for r in lines.collect())

    # after the line stage copies are seldom whole: the near-duplicate stage is held against documents before it
    pairs = [(r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").collect()]
    least = {r[0] for r in map(eval, near_brute(pairs, 5, 80)) if r[0] == r[2]}
    single = stages["near_duplicates"](spark, docs.where("doc_id IS NOT NULL"), folder)
    assert {r.doc_id for r in single.collect()} == least and len(least) < len(pairs)
    assert {9005, 9003, 9004} <= least and not {9001, 9002} & least
    alone = docs.where("doc_id IS NULL").withColumn("text", cp.F.lit("nobody else has this text at all"))
    assert stages["near_duplicates"](spark, alone, folder).count() == 1


def test_run(spark, folder):
    """All stages in turn; every piece of what the last but one kept is packed once."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, folder))
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, found, bins = cp.run(spark, folder).collect(), Counter(), {}
    for r in got:
        found[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert found == want
    for held in bins.values():
        held.sort()
        assert np.cumsum([0] + [n for _, n in held])[:-1].tolist() == [at for at, _ in held] and sum(n for _, n in held) <= cp.SEQUENCE


def test_no_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in cp.STAGES[1:]:
        assert stage(spark, docs, folder).count() == 0


def test_near_duplicates_move_no_text(spark, folder, monkeypatch):
    """The texts meet the ids that go in a broadcast; where these are many, the same rows stay."""
    docs = cp.written(spark.read.parquet(f"{folder}/documents.parquet").select(*cp.COLUMNS))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        single = cp.near_duplicate_stage(spark, docs, folder)
        plan = single._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        monkeypatch.setattr(cp, "FEW", -1)
        assert rows(single) == rows(cp.near_duplicate_stage(spark, docs, folder)) and 0 < single.count() < docs.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
