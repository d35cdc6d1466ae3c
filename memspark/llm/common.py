"""Helpers shared by the training-data operators."""

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.session import checkpointed, shared_dir

__all__ = ["checkpointed", "shared_dir", "shared_folder", "table", "text_or_empty", "slices", "like", "free_name"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a piece holds about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        at, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(text).cast(pa.binary())).to_pylist()):
            size += n or 0
            if size >= limit:
                yield batch.slice(at, i + 1 - at)
                at, size = i + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)


def like(df: DataFrame, *more: str) -> str:
    """The schema of ``df`` as DDL text, and further fields."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark does not tell upper from lower case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
