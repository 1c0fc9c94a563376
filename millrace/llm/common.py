"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one pass of a numpy kernel looks at; bounds a worker's memory.
SLICE_CHARS = 1_000_000

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        atexit.register(shutil.rmtree, where.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: The folders that written() made in the innermost temporary(), if there is one.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is written inside is deleted at the end, unless it stays; no frame that is read later may depend on the rest."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, made):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, stays: bool = False) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends there and any executor can read it."""
    path = f"{shared_dir(df.sparkSession)}/millrace-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None and not stays:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(key: Column | str, of: int) -> Column:
    """crc32 of a key's decimal text, modulo `of`; a null key counts as remainder 0."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(of), F.lit(0)).cast("int")


def text_slices(batches: Iterable[pa.RecordBatch], text: int, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with their texts (null: empty); each holds about `chars` characters, a longer text alone."""
    for batch in batches:
        column = batch.column(text)
        start, held, texts = 0, 0, []
        for i in range(batch.num_rows):
            value = column[i].as_py() or ""
            if texts and held + len(value) > chars:
                yield batch.slice(start, i - start), texts
                start, held, texts = i, 0, []
            texts.append(value)
            held += len(value)
        if texts:
            yield batch.slice(start), texts


def input_partitions(df: DataFrame) -> int:
    """A partition count for a shuffle that keeps what the session asks for."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows of one key that a spread join leaves together are at most this part of all rows; rows of a table of numbers and digests that is broadcast, at most.
SPREAD, FEW = 512, 500_000


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None, narrow: bool = False) -> DataFrame:
    """left joined with right by key, of which right has each value once; rows of hot keys are dealt to several tasks.

    A key with more than 1 / SPREAD of the rows gets a number of parts, and its right row is copied to each. There are at most
    SPREAD such keys, so their list is broadcast. counts: (key, n) of the left rows, if known; n is summed up. narrow: right
    is written and holds numbers and digests alone, so it is broadcast as a whole if it has FEW rows at most.
    """
    if narrow and right.count() <= FEW:
        return left.join(F.broadcast(right), key, how)
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts.groupBy(key).agg(F.sum("n").alias("n"))
    counts = written(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(64, total // SPREAD)
    hot = F.broadcast(counts.where(F.col("n") > most).select(F.col(key), F.ceil(F.col("n") / most).cast("int").alias("_parts")))
    part = F.coalesce(F.pmod(F.xxhash64(*(c for c in left.columns if c != key)), F.col("_parts")), F.lit(0)).cast("int")
    dealt = left.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    copied = right.join(hot, key, "left").withColumn("_part", parts).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")
