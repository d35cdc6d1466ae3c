"""Incremental extraction: every new episode is embedded and logged once."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from memspark.plans.consolidate import extract
from memspark.sources import batches


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """New files of a folder or glob; unlike a time cursor this also sees rows that arrive late."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def start(
    episodes: DataFrame, root: str, checkpoint: str, embed: Callable[[Column], Column], interval: str | None = None
) -> StreamingQuery:
    """Start the query.  Without ``interval`` it takes what is there and stops.

    Both output tables of a micro-batch commit together under its batch id, so a batch that is
    run again after a failure replaces itself and a finished one is skipped.
    """

    def step(df: DataFrame, batch_id: int) -> None:
        batches.append(df.sparkSession, root, batch_id, extract(df, embed, F.current_timestamp()))

    writer = episodes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()
