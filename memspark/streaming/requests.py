"""Write requests as a stream: late rows go to a table, answers come from keyed state.

Two streams, each with its own checkpoint.  The first compares every row with the stream's high-water mark, the
largest event time of earlier batches, and writes it to one of two tables, so no row is lost to a watermark.
The second reads the rows in time and keeps one state row per key.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from memspark import vocab as v
from memspark.streaming.windows import _micros

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _marks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("high_water timestamp, batch long").parquet(f"{path}/marks")


def divide(path: str, ts: str, delay: str) -> Callable[[DataFrame, int], None]:
    """A step for ``foreachBatch``: rows more than ``delay`` behind the high-water mark go to ``late``, the others to ``in_time``.

    Tables and marks are written below ``path`` in a folder per batch; a batch that runs again replaces its own folders,
    and a mark counts for later batches only.  Rows without a time are in time.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        # The first batch finds a folder without a mark; later ones read one row per batch.
        batch.limit(0).select(F.col(ts).cast("timestamp").alias("high_water")).write.mode("ignore").parquet(f"{path}/marks/batch=-1")
        before = _marks(spark, path).where(F.col("batch") < number).agg(F.max("high_water")).first()[0]
        late = F.coalesce(F.col(ts) < F.lit(before) - F.expr(f"INTERVAL {delay}"), F.lit(False)) if before else F.lit(False)
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/in_time/batch={number}")
        batch.where(late).withColumn("high_water", F.lit(before).cast("timestamp")).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.agg(F.max(F.col(ts).cast("timestamp")).alias("high_water")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        batch.unpersist()

    return step


def start_dividing(requests: DataFrame, path: str, checkpoint: str, delay: str, ts: str = "at") -> StreamingQuery:
    """Divide what is there; ``delay`` is how far behind the newest row of earlier batches a row may be."""
    return requests.writeStream.foreachBatch(divide(path, ts, delay)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_time(spark: SparkSession, path: str, schema: T.StructType, files: int = 1000) -> DataFrame:
    """Stream of the rows that came in time, batch by batch."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.readStream.schema(full).option("maxFilesPerTrigger", files).parquet(f"{path}/in_time")


def late(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Table of the late rows, with the high-water mark that each one missed."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("high_water", T.TimestampType()), T.StructField("batch", T.LongType())])).parquet(f"{path}/late")


class _Conflicts(StatefulProcessor):
    """Outcome of each request against the last fresh request of its key, kept for the retention time."""

    def __init__(self, ttl_hours: int):
        self.ttl_us = ttl_hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "body_hash string, at_us long")

    def _end(self, held: tuple) -> int:
        return -(-(held[1] + self.ttl_us) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = held = self.held.get()  # none for a key without state; each call is a message to the state server
        pieces = list(rows)
        batch = pieces[0] if len(pieces) == 1 else pd.concat(pieces, ignore_index=True)
        if len(batch) > 1:  # most keys have one request
            batch = batch.sort_values([c for c in ("batch", "at", "seq") if c in batch.columns], ignore_index=True)
        outcomes = []
        for at, body in zip(_micros(batch["at"]), batch["body_hash"].tolist(), strict=True):
            if held is None or at >= held[1] + self.ttl_us:
                held = (body, at)
                outcomes.append("fresh")
            else:
                outcomes.append("replay" if held[0] == body else "conflict")
        if held is not known:
            if known is not None:
                self.handle.deleteTimer(self._end(known))
            self.held.update(held)
            self.handle.registerTimer(max(self._end(held), timerValues.getCurrentWatermarkInMs() + 1))
        batch["outcome"] = outcomes
        yield batch

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        if held is not None and self._end(held) <= timerValues.getCurrentWatermarkInMs():
            self.held.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def classified(requests: DataFrame, delay: str, ttl_hours: int = v.IDEMPOTENCY_TTL_HOURS, keys: tuple[str, ...] = ("tenant_id", "key", "verb")) -> DataFrame:
    """Adds ``outcome`` (fresh, replay, conflict) to a stream ``(tenant_id, key, verb, body_hash, at, seq)``.

    A request from the end of the retention time of a key's fresh one on is fresh again.  State lives in RocksDB; a timer
    clears that of a key when the watermark has passed its retention time, so it is bounded by the keys of that time.
    With the ``delay`` that divided the rows the watermark drops none: it is never ahead of the mark they were compared with.
    Requests of one key and micro-batch are ordered by (batch, at, seq) in memory; a micro-batch is bounded by the files it reads.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    out = T.StructType([*requests.schema.fields, T.StructField("outcome", T.StringType())])
    keyed = requests.withWatermark("at", delay).groupBy(*keys)
    return keyed.transformWithStateInPandas(_Conflicts(ttl_hours), outputStructType=out, outputMode="Append", timeMode="EventTime")
