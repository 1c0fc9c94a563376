"""Queries and SQL of the training-data operators: thin wrappers that run each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, context_mixing, cover_tree, fingerprint, jaccard, langid, line_templates, packing, quality, warc
from .common import read_table, remainder

Query = Callable[[SparkSession, str], DataFrame]


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_repeated(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(read_table(spark, sf_dir, "documents"))


def op2_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(read_table(spark, sf_dir, "pages")))


def op4_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = langid.fit(docs.where("NOT held_out"))
    return langid.predict(docs, model, extra=("held_out",))


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 5) == 0)
    labels = read_table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    model = quality.fit(docs.select("doc_id", "text"), labels)
    return quality.score(docs, model, ("doc_id", "held_out"))


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 7) == 2)
    return context_mixing.score(docs, "held_out")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)
    return packing.pack(pieces, 2048)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_improbable_features, op2_cover_tree_top_k, op3_warc_derivatives, op4_language_masks, op5_rule_ensemble, op6_context_mixing, op7_ngram_jaccard, op8_sum_of_squares_packing, op9_line_templates, op10_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op2_cover_tree_top_k": cover_tree.ORACLE_SQL, "op9_line_templates": line_templates.ORACLE_SQL}
