"""Embedding with a model that takes batches of texts, once for every new episode."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

Model = Callable[[list[str]], np.ndarray]
KEY = ["tenant_id", "episode_id"]


def hash_model() -> Model:
    """Reproducible stand-in for a model: the same vectors as ``functions.vectors.hash_vector``."""
    import hashlib

    def embed(texts: list[str]) -> np.ndarray:
        raw = np.array([list(hashlib.sha256(t.encode()).digest()) for t in texts], np.float64).reshape(len(texts), 32)
        raw = (raw - 127.5) / 127.5
        return np.round(raw / np.sqrt((raw * raw).sum(1, keepdims=True)), 8)

    return embed


def embedded(rows: DataFrame, load: Callable[[], Model], dim: int, text: str = "body", vector: str = "embedding", batch_rows: int = 256) -> DataFrame:
    """``rows`` with the vector of every text in column ``vector`` (array of double).

    ``load`` is called once in each task and gives a function from at most ``batch_rows`` texts to one row of ``dim`` finite
    numbers for each; anything else fails the task.  A null text has a null vector and is not shown to the model.
    A column ``vector`` of ``rows`` is replaced.  Batches stream through the task, one at a time.
    """
    kept = rows.drop(vector)
    schema = T.StructType([*kept.schema.fields, T.StructField(vector, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                texts = batch.column(text).to_pylist()
                known = [t for t in texts if t is not None]
                if known and model is None:
                    model = load()
                got = np.asarray(model(known), np.float64) if known else np.empty((0, dim))
                if got.shape != (len(known), dim) or not np.isfinite(got).all():
                    raise ValueError(f"the model gave shape {got.shape} for {len(known)} texts of dimension {dim}, or numbers that are not finite")
                found = iter(got.tolist())
                yield batch.append_column(vector, pa.array([None if t is None else next(found) for t in texts], pa.list_(pa.float64())))

    return kept.mapInArrow(run, schema)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All vectors written so far, with the batch that wrote them."""
    fields = [*(f for f in schema.fields if f.name != "embedding"), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("batch", T.LongType())]
    return spark.read.schema(T.StructType(fields)).parquet(f"{path}/vectors")


def start(episodes: DataFrame, path: str, checkpoint: str, load: Callable[[], Model], dim: int, text: str = "body", batch_rows: int = 256) -> StreamingQuery:
    """Embed what is there of a stream ``(tenant_id, episode_id, text…)`` and stop.

    A micro-batch writes a folder of its own, so one that runs again after a failure replaces itself.  Episodes that an
    earlier batch has written are left out before the model sees them, also when they are delivered again; of
    an episode that a batch holds twice one row is kept.
    """
    schema = episodes.schema

    def step(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        done = stored(spark, path, schema).where(F.col("batch") < number).select(*KEY) if number else None
        fresh = df.dropDuplicates(KEY)
        if done is not None:
            fresh = fresh.join(done, KEY, "left_anti")
        embedded(fresh, load, dim, text, "embedding", batch_rows).write.mode("overwrite").parquet(f"{path}/vectors/batch={number}")

    return episodes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
