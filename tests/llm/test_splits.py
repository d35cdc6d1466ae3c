"""Results when files are split otherwise from one scan to the next, as on a cluster that loses executors."""

import random
from contextlib import contextmanager

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from memspark.llm import near_dedup, token_shards

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ONE_SPLIT = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "1"}
MANY_SPLITS = {"spark.sql.files.minPartitionNum": "64", "spark.sql.files.openCostInBytes": "64m"}


@contextmanager
def split(spark, how):
    before = {k: spark.conf.get(k, None) for k in how}
    for k, v in how.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def texts():
    """Twelve groups of three near copies with two exact copies of each."""
    rng = random.Random(8)
    out = []
    for _ in range(12):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(100)]
        out += [" ".join(words), " ".join([*words[:-1], "last"]), " ".join([*words[:-1], "end"])]
    return out


@pytest.fixture
def stored(spark, tmp_path):
    def store(rows):
        for at in range(0, len(rows), 9):  # a file for every nine rows
            spark.createDataFrame(rows[at : at + 9], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
        with split(spark, MANY_SPLITS):
            many = spark.read.parquet(f"{tmp_path}/docs").rdd.getNumPartitions()
        with split(spark, ONE_SPLIT):
            assert spark.read.parquet(f"{tmp_path}/docs").rdd.getNumPartitions() < many
        return docs

    return store


@pytest.mark.parametrize("stage", ["exact_dedup", "near_dedup"])
def test_stages_drop_the_same_rows(spark, stored, texts, stage):
    rows = [(i, t) for i, t in enumerate(texts * 2)] if stage == "exact_dedup" else list(enumerate(texts))
    docs = stored(rows)
    with split(spark, MANY_SPLITS):
        kept = getattr(corpus_pipeline, stage)(spark, docs, "")
    with split(spark, ONE_SPLIT):
        got = sorted(r.doc_id for r in kept.collect())
    assert kept.columns == ["doc_id", "text"]
    assert got == (list(range(len(texts), 2 * len(texts))) if stage == "exact_dedup" else list(range(0, len(texts), 3)))


@pytest.mark.parametrize("stage", [None, "exact_dedup", "near_dedup"])
def test_row_numbers_are_stored(spark, stored, texts, stage):
    docs = stored(list(enumerate(texts)))
    result = getattr(corpus_pipeline, stage)(spark, docs, "") if stage else near_dedup.near_duplicates(docs)
    assert "monotonically_increasing_id" not in result._jdf.queryExecution().executedPlan().toString()


def test_shards_of_moving_splits(spark, stored, texts, tmp_path, monkeypatch):
    docs = stored(list(enumerate(texts)))
    real = token_shards.checkpointed

    def moved(df):
        with split(spark, MANY_SPLITS):
            return real(df)

    monkeypatch.setattr(token_shards, "checkpointed", moved)
    library = Tokenizer.from_file(VOCABULARY)
    with split(spark, ONE_SPLIT):
        shards = token_shards.write_shards(docs.select("text"), VOCABULARY, f"file://{tmp_path}/shards", length=64)
    rows = sorted(token_shards.read_shards(spark, shards).collect(), key=lambda r: r.sequence_id)
    stream = np.concatenate([np.frombuffer(r.ids, shards.kind) for r in rows]).tolist()
    ends = [i for i, x in enumerate(stream) if x == 50256]
    got = [tuple(stream[a:b]) for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)]
    assert sorted(got) == sorted(tuple(library.encode(t, add_special_tokens=False).ids) for t in texts)
    assert shards.tokens == len(stream)
