"""Batch embedding and its stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.functions.vectors import hash_vector
from memspark.streaming import embed

ROWS = [("t", f"e{i}", f"text {i}") for i in range(10)] + [("t", "null", None), ("t", "empty", ""), ("u", "e1", "other"), ("t", "long", "x" * 100_000)]
SCHEMA = "tenant_id string, episode_id string, body string"


@pytest.mark.parametrize("batch_rows", [1, 3, 256])
def test_same_vectors_in_batches(spark, batch_rows):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("embedding", F.lit("old"))
    got = embed.embedded(rows, embed.hash_model, 32, batch_rows=batch_rows).withColumn("want", hash_vector(F.col("body"))).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.embedding is None) == (r.body is None) and (r.body is None or np.abs(np.array(r.embedding) - np.array(r.want)).max() < 2e-8)


@pytest.mark.parametrize("bad", [lambda t: np.zeros((len(t), 31)), lambda t: np.zeros((len(t) + 1, 32)), lambda t: np.full((len(t), 32), np.nan)])
def test_wrong_answers_fail(spark, bad):
    with pytest.raises(Exception, match="the model gave"):
        embed.embedded(spark.createDataFrame(ROWS, SCHEMA), lambda: bad, 32).collect()


def test_batches_are_bounded_and_empty_tables_need_no_model(spark):
    def load():
        def model(texts):
            assert len(texts) <= 4
            return np.zeros((len(texts), 2))

        return model

    def none():
        raise RuntimeError("not needed")

    assert embed.embedded(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), load, 2, batch_rows=4).count() == len(ROWS)
    assert embed.embedded(spark.createDataFrame(ROWS, SCHEMA).where("body is null"), none, 2).count() == 1


def test_a_second_run_embeds_new_episodes_only(spark, tmp_path):
    path = str(tmp_path)
    arrive = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    marked = lambda value: lambda: lambda texts: np.full((len(texts), 2), float(value))

    def run(value):
        episodes = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(f"{path}/in")
        embed.start(episodes, f"{path}/out", f"{path}/c", marked(value), 2).awaitTermination()
        return {(r.tenant_id, r.episode_id): r.embedding[0] for r in embed.stored(spark, f"{path}/out", episodes.schema).collect()}

    arrive([("t", "a", "x"), ("t", "b", "y"), ("t", "b", "y")])
    assert run(1) == {("t", "a"): 1.0, ("t", "b"): 1.0}
    arrive([("t", "b", "again"), ("t", "c", "z"), ("u", "a", "x")])  # b is delivered again
    assert run(2) == {("t", "a"): 1.0, ("t", "b"): 1.0, ("t", "c"): 2.0, ("u", "a"): 2.0}
    assert run(3) == {("t", "a"): 1.0, ("t", "b"): 1.0, ("t", "c"): 2.0, ("u", "a"): 2.0}
