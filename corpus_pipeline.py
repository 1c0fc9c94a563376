"""A corpus pipeline of the training-data operators: each stage works on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, langid, line_templates, packing, quality
from millrace.llm.common import FEW, read_table, remainder, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents under this share of n-grams that their language contains have no language that was learned.
LEAST_LANGUAGE = 0.4
SEQUENCE = 2048


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars after the text as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts good stay."""
    labels = read_table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    model = quality.fit(docs.select("doc_id", "text"), labels)
    return quality.score(docs.select(*COLUMNS), model, COLUMNS).where("predicted = 1").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without letters, or in none, go. lang stays as it was."""
    model = langid.fit(docs.where(remainder("doc_id", 4) != 2))
    found = langid.predict(docs, model, extra=("lang", "source", "n_chars", "text"))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template an earlier document has go; a document that loses all its lines goes with them."""
    found = line_templates.drop_repeated(docs.select(*COLUMNS))
    return _columns(found.where("n_dropped = 0 OR n_dropped < n_lines"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays.

    Documents without an id stay where one of them is in no group with an id; rows that share the smallest id all stay.
    """
    groups = jaccard.near_duplicates(docs, words=5, percent=80)
    marks = written(groups.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("_stays")))
    gone = marks.where("NOT _stays").select("_id")
    # texts move only where more ids go than can be broadcast
    gone = F.broadcast(gone) if gone.count() <= FEW else gone
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE)
    return packing.pack(pieces, SEQUENCE)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The classifier, the language model and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
