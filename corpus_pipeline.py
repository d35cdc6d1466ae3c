"""A corpus pipeline: toxic documents go, then copies, then near copies; the rest is packed for training.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but
the last return the columns of ``docs``.  A null or empty text is a document like any other; rows
that repeat are copies.  Dedup stages first write their rows with a number to the shared folder and drop
rows of that table by it, so rows with one id or without an id are told apart, and a cluster that
loses or gains executors between two scans (which may split the files otherwise) drops the same rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import catalog
from memspark.llm.common import free_name, shared_folder, table
from memspark.llm.exact_dedup import exact_duplicates
from memspark.llm.near_dedup import near_duplicates
from memspark.llm.packing import packed_documents
from memspark.llm.toxicity import keep_clean, learn
from memspark.session import broadcast_if

#: Rows to drop are sent to every task up to this number (16 MB); more are met in a shuffle.
_BROADCAST_ROWS = 1_000_000


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for every row, stored so that no later scan derives it again, and the name of that column."""
    folder, row = shared_folder(spark, "numbered"), free_name(docs, "row_of_stage")
    docs.withColumn(row, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder), row


def _without(numbered: DataFrame, row: str, verdicts: DataFrame) -> DataFrame:
    """The rows of ``_numbered`` whose verdict is ``kept``, without their numbers."""
    dropped = verdicts.filter(~F.col("kept")).select(F.col("row").alias(row))
    return numbered.join(broadcast_if(dropped, _BROADCAST_ROWS), row, "left_anti").drop(row)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model of the labelled documents."""
    return keep_clean(docs, learn(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    numbered, row = _numbered(spark, docs)
    return _without(numbered, row, exact_duplicates(numbered, row=row))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts, the document with the smallest id."""
    numbered, row = _numbered(spark, docs)
    return _without(numbered, row, near_duplicates(numbered, different=True, row=row))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packed_documents(docs, catalog.vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Neither the toxicity model nor weighted sampling can be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
