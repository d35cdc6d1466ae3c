"""The stored text index against the search over texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from memspark.operators import bm25, text_index

WORDS = [f"w{i}" for i in range(60)]


def corpus(seed, n):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [(f"t{rng.randint(0, 1)}", f"d{i:04d}", " ".join(rng.choices(WORDS, weights, k=rng.choice([3, 8, 30, 120])))) for i in range(n)]
    return rows + [("t0", "null", None), ("t0", "empty", ""), ("t1", "marks", "... !!")] + [("t1", f"same{i}", "w1 w2 w3") for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(3, 900), "tenant_id string, fact_id string, content string")


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(6)
    rows = [(f"q{i}", f"t{i % 2}", " ".join(rng.choices(WORDS, k=rng.randint(1, 4)))) for i in range(30)]
    return spark.createDataFrame(rows + [("qn", "t0", None), ("qu", "t0", "unknown"), ("qs", "t1", "w1 w2 w3")], "query_id string, tenant_id string, text string")


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return text_index.build(docs, f"{tmp_path_factory.mktemp('index')}/i", by=("tenant_id",), span=8, buckets=8)


@pytest.mark.parametrize("k", [3, 50])
def test_search_is_exact(index, docs, asked, k):
    found = text_index.search(index, asked, k)
    want = bm25.search_documents(docs, asked, k, by=("tenant_id",))
    assert sorted(map(tuple, found.hits.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_are_skipped_and_counted(index, asked):
    work = {r.query_id: r for r in text_index.search(index, asked, 3).work.collect()}
    assert all(0 < r.read <= r.blocks for r in work.values()) and "qn" not in work and "qu" not in work
    assert sum(r.read for r in work.values()) < 0.7 * sum(r.blocks for r in work.values())


def test_coarse_heads_bound_their_ranges(index):
    fine = index.fine.withColumn("group", F.floor(F.col("range") / text_index.SUPER)).groupBy("_scope", "term", "group").agg(F.max("top").alias("high"), F.sum("n").alias("all"))
    assert index.coarse.join(fine, ["_scope", "term", "group"]).where("top <> high or n <> all").isEmpty()
    assert index.blocks.where(F.size("postings") > 8).isEmpty()


def test_several_groups_without_tenants(spark, monkeypatch, tmp_path, docs, asked):
    monkeypatch.setattr(text_index, "SUPER", 3)
    flat = docs.drop("tenant_id")
    index = text_index.build(flat, f"{tmp_path}/i", span=16, buckets=4)
    found = text_index.search(index, asked.drop("tenant_id"), 5)
    want = bm25.search_documents(flat, asked.drop("tenant_id"), 5)
    assert sorted(map(tuple, found.hits.collect())) == sorted(map(tuple, want.collect()))


def test_beyond_the_broadcast_limits(monkeypatch, index, docs, asked):
    monkeypatch.setattr(bm25, "VOCABULARY_LIMIT", 1)
    monkeypatch.setattr(text_index, "READ_LIMIT", 1)
    found = text_index.search(index, asked, 4)
    want = bm25.search_documents(docs, asked, 4, by=("tenant_id",))
    assert sorted(map(tuple, found.hits.collect())) == sorted(map(tuple, want.collect()))


def test_a_search_reads_no_text(spark, index, asked):
    plan = text_index.search(index, asked, 3).hits._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "regexp" not in plan.lower()


def test_empty_tables(spark, tmp_path, docs, asked, index):
    empty = text_index.build(docs.limit(0), f"{tmp_path}/i", by=("tenant_id",), buckets=4)
    assert text_index.search(empty, asked, 3).hits.count() == 0
    assert text_index.search(index, asked.limit(0), 3).hits.count() == 0


def test_an_index_cannot_serve_the_filter_before(spark, index, docs, asked):
    from memspark.plans.recall import recall

    with pytest.raises(ValueError):
        recall(docs, asked, F.current_timestamp(), index=index, filter_stage="pre_retrieval")


def test_the_build_numbers_documents_before_it_counts_words(monkeypatch, tmp_path, docs):
    """Counting within arrays walked a text several times per word; now words are counted by grouping, behind one shuffle of texts."""
    seen, place = [], text_index.positions
    monkeypatch.setattr(text_index, "positions", lambda rows, *rest: seen.append(rows) or place(rows, *rest))
    index = text_index.build(docs, f"{tmp_path}/i", by=("tenant_id",), span=8, buckets=4)
    assert "lambdafunction" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    want = bm25.postings(docs, by=("tenant_id",)).where("term <> ''").select("fact_id", "term", F.col("tf").cast("int"), "doc_len")
    got = index.blocks.select("term", F.inline("postings")).select(F.col("id").alias("fact_id"), "term", "tf", "doc_len")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_index_holds_each_posting_once_and_no_words_of_texts(tmp_path, spark, docs):
    """The build stored the words of every text and each head twice, and shuffled texts, postings and heads for each table."""
    text_index.build(docs, f"{tmp_path}/i", by=("tenant_id",), span=8, buckets=4)
    assert {p.name for p in (tmp_path / "i").iterdir()} == {"documents", "stats", "parts"}
    assert spark.read.parquet(f"{tmp_path}/i/documents").columns == ["_scope", "id", "doc_len", "range"]


def test_pieces_keep_the_numbering(monkeypatch, tmp_path, docs, asked):
    """Ranges of many pieces, and a range longer than a piece: places run over all documents of a tenant."""
    monkeypatch.setattr(text_index, "PIECE", 150)
    monkeypatch.setattr(text_index, "SUPER", 5)
    index = text_index.build(docs, f"{tmp_path}/i", by=("tenant_id",), span=8, buckets=4)
    postings = bm25.postings(docs, by=("tenant_id",))
    lengths = postings.where("term = ''").select("tenant_id", "fact_id", "doc_len").collect()
    place = {}
    for tenant in ("t0", "t1"):
        own = sorted((r.doc_len, r.fact_id) for r in lengths if r.tenant_id == tenant)
        place |= {(tenant, fact): i // 8 for i, (_, fact) in enumerate(own)}
    want = sorted((r.tenant_id, r.term, place[r.tenant_id, r.fact_id], r.fact_id, int(r.tf)) for r in postings.where("term <> ''").collect())
    flat = index.blocks.select(F.substring("_scope", 3, 9).alias("t"), "term", "range", F.inline("postings"))
    assert sorted((r.t, r.term, r.range, r.id, r.tf) for r in flat.collect()) == want
    assert index.blocks.groupBy("_scope", "term", "range").count().where("count > 1").isEmpty()
    fine = index.fine.groupBy("_scope", "term", F.floor(F.col("range") / 5).alias("group")).agg(F.max("top").alias("high"), F.sum("n").alias("all"), F.count("*").alias("held"))
    assert index.coarse.count() == fine.count() < index.parts.count()
    assert index.coarse.join(fine, ["_scope", "term", "group"]).where("top <> high or n <> all or blocks <> held").isEmpty()
    found = text_index.search(index, asked, 4)
    assert sorted(map(tuple, found.hits.collect())) == sorted(map(tuple, bm25.search_documents(docs, asked, 4, by=("tenant_id",)).collect()))


def test_scores_are_summed_where_a_range_meets(index, asked):
    """A score was shuffled for every query, document and task; now blocks travel to their range and only the first k of a task go on."""
    plan = text_index.search(index, asked, 3).hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_scope" in plan and not re.search(r"hashpartitioning\((query_id#\d+, \w+#|bucket)", plan)
