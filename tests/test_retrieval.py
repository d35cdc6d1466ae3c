import math
import random
import sqlite3
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.operators import bm25, fusion, knn, temporal
from memspark.plans.recall import ledger_rows, recall, recall_events, recall_ids


def vec_frame(spark, mat, name):
    return spark.createDataFrame([(f"{name}{i:03d}", [float(x) for x in row]) for i, row in enumerate(mat)], f"{name}_id string, vec array<float>")


def brute(vecs, qs, k):
    out = {}
    for qi, q in enumerate(qs.astype(np.float32).astype(float)):
        d = np.sqrt(((vecs.astype(np.float32).astype(float) - q) ** 2).sum(axis=1)).round(9)
        out[f"q{qi:03d}"] = [f"f{i:03d}" for i in sorted(range(len(vecs)), key=lambda i: (d[i], i))[:k]]
    return out


@pytest.mark.parametrize("block", [1000, 3])
def test_knn_both_ways_and_ties(spark, block):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(60, 8))
    vecs[20:50] = vecs[0]  # half of all rows are copies: ties go by id
    qs = np.concatenate([rng.normal(size=(6, 8)), vecs[:1]])
    f, q = vec_frame(spark, vecs, "f"), vec_frame(spark, qs, "q")
    got = knn.nearest(f.repartition(5), q, 12, dim=8, fact_col="f_id", query_col="q_id", query_block=block, vector_chunk=7)
    have = {}
    for r in got.orderBy("query_id", "rank").collect():
        have.setdefault(r.query_id, []).append(r.fact_id)
        assert r.score == pytest.approx(1 / (1 + r.distance))
    assert have == brute(vecs, qs, 12)


def test_knn_edges(spark):
    f = vec_frame(spark, np.ones((3, 4)), "f")
    q = vec_frame(spark, np.ones((1, 4)), "q")
    args = dict(fact_col="f_id", query_col="q_id")
    assert knn.nearest(f, q, 10, dim=4, **args).count() == 3
    assert knn.nearest(f, q.where("false"), 10, dim=4, **args).count() == 0
    with pytest.raises(ValueError):
        knn.nearest(f, q, 0, dim=4, **args)
    with pytest.raises(Exception, match="dimension"):
        knn.nearest(f, vec_frame(spark, np.ones((1, 5)), "q"), 1, dim=4, **args)


def test_vector_rows_are_checked(spark):
    rows = spark.createDataFrame(
        [([1.0, 2.0], "n", None, None), ([1.0], "n", None, None), ([1.0, 2.0], "n", "e", None), ([1.0, 2.0], None, None, None)],
        "embedding array<float>, node_id string, edge_id string, episode_id string",
    )
    assert knn.checked_vectors(rows, 2, strict=False).count() == 1
    with pytest.raises(Exception, match="one key"):
        knn.checked_vectors(rows, 2).collect()


def test_bm25_equals_sqlite(spark):
    rng = random.Random(3)
    words = "the a of cat dog bird fish tree house café naïve run jump blue red 42".split()
    docs = [(f"d{i:02d}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    queries = [("q1", "the cat"), ("q2", "Café? RED red"), ("q3", "42 of naive birds"), ("q4", "nothing matches xyzzy"), ("q5", "")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, body)")
    con.executemany("INSERT INTO t VALUES (?, ?)", docs)
    d = spark.createDataFrame(docs, "fact_id string, content string")
    q = spark.createDataFrame(queries, "query_id string, text string")
    got = {}
    for r in bm25.search_documents(d, q, 50).collect():
        got.setdefault(r.query_id, {})[r.fact_id] = r.score
    import re

    for qid, text in queries:
        toks = re.findall(r"\w+", text.lower())
        want = {}
        if toks:
            expr = " OR ".join(f'"{t}"' for t in toks)
            want = {i: -s for i, s in con.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (expr,))}
        best = dict(sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))[:50])
        assert got.get(qid, {}) == pytest.approx(best, abs=1e-8)


def test_bm25_without_broadcast_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", "x y z " * (i % 5 + 1) + f"w{i}") for i in range(40)], "fact_id string, content string")
    q = spark.createDataFrame([("q1", "x w3 w7"), ("q2", "z y")], "query_id string, text string")
    a = sorted(map(tuple, bm25.search_documents(docs, q).collect()))
    monkeypatch.setattr(bm25, "VOCABULARY_LIMIT", 1)
    assert sorted(map(tuple, bm25.search_documents(docs, q).collect())) == a


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, fact_id string, score double, source string, rank int")


def test_rrf_example(spark):
    ranks = {"P": (2, 1, 2), "E": (1, 3, 4), "C": (5, 7, 6)}
    rows = [("q", f, 0.0, s, r) for f, rs in ranks.items() for s, r in zip(("semantic", "lexical", "graph"), rs)]
    got = fusion.rrf(hits(spark, rows)).orderBy("rank").collect()
    assert [r.fact_id for r in got] == ["P", "E", "C"]
    for r in got:
        assert r.rrf == pytest.approx(sum(1 / (60 + x) for x in ranks[r.fact_id]))


def test_rrf_ties(spark):
    rows = [("q", "b", 1.0, "lexical", 1), ("q", "a", 1.0, "graph", 1), ("q", "c", 1.0, "semantic", 1), ("q", "d", 1.0, "lexical", 1)]
    got = fusion.rrf(hits(spark, rows)).orderBy("rank").collect()
    assert [(r.fact_id, r.source) for r in got] == [("c", "semantic"), ("b", "lexical"), ("d", "lexical"), ("a", "graph")]
    assert fusion.rrf(hits(spark, rows), top_k=2).count() == 2
    with pytest.raises(ValueError):
        fusion.rrf(hits(spark, rows), k_constant=0)


def test_renumber_closes_gaps(spark):
    rows = [("q", f"f{i}", 0.0, "lexical", i) for i in range(1, 6)]
    kept = spark.createDataFrame([("q", "f2"), ("q", "f5")], "query_id string, fact_id string")
    got = fusion.keep_only(hits(spark, rows), kept).orderBy("rank").collect()
    assert [(r.fact_id, r.rank) for r in got] == [("f2", 1), ("f5", 2)]


T = datetime(2024, 2, 1)


def test_validity_is_half_open(spark):
    data = [("a", T, None), ("b", datetime(2024, 3, 1), None), ("c", datetime(2024, 1, 1), T), ("d", datetime(2024, 1, 1), datetime(2024, 2, 2))]
    df = spark.createDataFrame(data, "fact_id string, valid_from timestamp, valid_to timestamp")
    assert {r.fact_id for r in temporal.valid_at(df, F.lit(T)).collect()} == {"a", "d"}
    missing = spark.createDataFrame([("x", None, None)], df.schema)
    with pytest.raises(Exception, match="valid_from"):
        temporal.valid_at(missing, F.lit(T)).collect()
    grace = df.select("fact_id", temporal.purge_eligible(F.lit(datetime(2024, 5, 1))).alias("p"))
    assert {r.fact_id for r in grace.where("p").collect()} == {"c"}


def test_close_intervals_rejects_unknown_ids(spark):
    facts = spark.createDataFrame([("t", "a", None)], "tenant_id string, fact_id string, valid_to timestamp")
    ends = spark.createDataFrame([("t", "zz", T)], "tenant_id string, fact_id string, valid_to timestamp")
    with pytest.raises(Exception, match="no such fact"):
        temporal.close_intervals(facts, ends).collect()


FACTS = "tenant_id string, fact_id string, kind string, content string, valid_from timestamp, valid_to timestamp, recorded_at timestamp, episode_id string, version bigint, source_uri string"


def small_world(spark):
    data = [
        ("t", "f1", "user_fact", "alice likes green tea", datetime(2024, 1, 1), None, T, "e1", 1, "s"),
        ("t", "f2", "user_fact", "alice likes coffee", datetime(2024, 1, 1), datetime(2024, 1, 5), T, "e2", 1, "s"),
        ("t", "f3", "preference", "bob likes tea tea tea", datetime(2024, 1, 1), None, T, None, 1, "s"),
        ("t", "f4", "narrative", "a long walk", datetime(2024, 1, 1), None, T, "e4", 1, "s"),
    ]
    facts = spark.createDataFrame(data, FACTS)
    q = spark.createDataFrame([("q1", "t", "alice tea", None), ("q2", "t", "", "x"), ("q3", "t", "walk", None)],
                              "query_id string, tenant_id string, text string, intent string")
    return facts, q


def test_recall_drops_after_the_cut(spark):
    facts, q = small_world(spark)
    got = recall(facts, q, F.lit(T), k=2)
    ids = {}
    for r in got.facts.orderBy("query_id", "rank").collect():
        ids.setdefault(r.query_id, []).append(r.fact_id)
    assert ids == {"q1": ["f1"], "q3": ["f4"]}  # f3 has no episode and is not replaced
    acc = {r.query_id: r for r in got.filters.collect()}
    assert (acc["q1"].pre_filter_excluded, acc["q1"].provenance_dropped) == (1, 1)
    assert (acc["q2"].pre_filter_excluded, acc["q2"].provenance_dropped) == (0, 0)


def test_recall_ledger_and_events(spark):
    facts, q = small_world(spark)
    got = recall(facts, q, F.lit(T), k=2)
    req = recall_ids(q, F.lit(T), 2)
    led = {r.recall_id: r for r in ledger_rows(got, req, F.lit(T)).collect()}
    assert len(led) == 3 and sorted(len(r.top_k_fact_ids) for r in led.values()) == [0, 1, 1]
    assert {r.classified_intent for r in led.values()} == {"unspecified", "x"}
    ev = recall_events(got, req, F.lit(T)).collect()
    assert len(ev) == 2 and all(len(e.fact_ids) == 1 and e.path == "recall" for e in ev)


def test_tenants_never_meet(spark):
    """Two tenants share fact ids, words and vectors; each query sees its own facts, ranked by its own statistics."""
    facts, q = small_world(spark)
    twin = facts.withColumn("tenant_id", F.lit("u")).withColumn("content", F.concat(F.lit("tea "), "content"))
    both = facts.unionByName(twin)
    vec = lambda t, shift: [(t, f"f{i}", [float(i + shift), 0.0]) for i in range(1, 5)]
    kind = "tenant_id string, fact_id string, vec array<double>"
    vectors = spark.createDataFrame(vec("t", 0) + vec("u", 10), kind)
    q = q.withColumn("vec", F.array(F.lit(1.0), F.lit(0.0)))
    for stage in ("post_retrieval", "pre_retrieval"):
        for tenant, own, shift in (("t", facts, 0), ("u", twin, 10)):
            asked = q.withColumn("tenant_id", F.lit(tenant)).withColumn("query_id", F.concat(F.lit(tenant), "query_id"))
            everyone = asked.unionByName(q.withColumn("tenant_id", F.lit("t" if tenant == "u" else "u")).withColumn("query_id", F.concat(F.lit("other"), "query_id")))
            alone = recall(own, asked, F.lit(T), spark.createDataFrame(vec(tenant, shift), kind), dim=2, k=3, filter_stage=stage).facts
            mixed = recall(both, everyone, F.lit(T), vectors, dim=2, k=3, filter_stage=stage).facts.where(F.col("query_id").startswith(tenant))
            cols = ("query_id", "tenant_id", "fact_id", "content", "score", "rank")
            want = sorted(map(tuple, alone.select(*cols).collect()))
            assert want and sorted(map(tuple, mixed.select(*cols).collect())) == want


def test_pre_filter_covers_vectors(spark):
    facts, q = small_world(spark)
    vectors = spark.createDataFrame([("t", "f2", [0.0]), ("t", "gone", [0.0])], "tenant_id string, fact_id string, vec array<double>")
    asked = q.where("query_id = 'q3'").withColumn("vec", F.array(F.lit(0.0)))
    got = recall(facts, asked, F.lit(T), vectors, dim=1, k=3, filter_stage="pre_retrieval")
    assert got.filters.first().pre_filter_excluded == 0


def test_recall_k_zero(spark):
    facts, q = small_world(spark)
    got = recall(facts, q, F.lit(T), k=0)
    assert got.facts.count() == 0 and got.preferences is None
    pages = spark.createDataFrame(
        [("t", "p1", "preference", T, 6_000), ("t", "p2", "prohibition", T - timedelta(days=1), 6_000), ("u", "p3", "preference", T, 10), ("t", "p4", "note", T, 1)],
        "tenant_id string, page_uri string, kind string, revised_at timestamp, bytes bigint")
    with_pages = recall(facts, q, F.lit(T), k=0, pages=pages)
    assert [r.page_uri for r in with_pages.preferences.collect()] == ["p1"]
    assert {r.k_zero_short_circuit for r in got.filters.collect()} == {True}
    with pytest.raises(ValueError):
        recall(facts, q, F.lit(T), k=-1)


def test_recall_uses_given_connectedness(spark):
    facts, q = small_world(spark)
    conn = spark.createDataFrame([("t", "f1", 0.25), ("u", "f1", 0.9)], "tenant_id string, fact_id string, connectedness double")
    r = recall(facts, q.where("query_id = 'q1'"), F.lit(T), k=5, connectedness=conn).facts.where("fact_id = 'f1'").first()
    age = 31.0
    assert r.score == pytest.approx(0.2 * 0.7 + 0.3 * (0.05 + 0.95 * math.exp(-age / 30)) + 0.2 * 0.25, abs=1e-8)


def test_replay_on_a_small_corpus(spark):
    from memspark.functions.vectors import hash_vector
    from memspark.plans.evaluate import replay

    names = ["Ann", "Ben", "Cleo", "Dan", "Eli", "Fay"]
    things = ["paints boats", "keeps bees", "plays chess", "bakes bread", "climbs walls", "reads maps"]
    data = [("t", f"f{i}", "user_fact", f"{n} {s} on weekends", datetime(2024, 1, 1), None, T, f"e{i}", 1, "s")
            for i, (n, s) in enumerate(zip(names, things))]
    facts = spark.createDataFrame(data, FACTS)
    vecs = facts.select("tenant_id", "fact_id", hash_vector(F.col("content")).alias("vec"))
    q = spark.createDataFrame([("t", f"q{i}", f"What does {n} do?", [f"f{i}"]) for i, n in enumerate(names)],
                              "tenant_id string, query_id string, text string, relevant_fact_ids array<string>").withColumn("vec", hash_vector(F.col("text")))
    r = replay(facts, vecs, q, F.lit(T), 32, k=3).first()
    assert r.n_queries == 6 and r.n_hits == 6 and r.passed
    stranger = replay(facts, vecs, q.withColumn("tenant_id", F.lit("u")), F.lit(T), 32, k=3).first()
    assert stranger.n_queries == 6 and stranger.n_hits == 0 and not stranger.passed


def test_union_then_group_is_whole(spark):
    """A distinct over two lists that are both partitioned by query must not skip its shuffle wrongly."""
    from memspark.session import union_all

    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    a = spark.range(4000).select((F.col("id") % 40).alias("q"), (F.col("id") % 97).alias("f")).repartition(8, "q")
    b = spark.range(900).select((F.col("id") % 40).alias("q"), (F.col("id") % 31).alias("f")).repartition(8, "q")
    got = union_all(a, b).distinct()
    rows = got.collect()
    assert len(rows) == len(set(rows)) == len(set(a.collect()) | set(b.collect()))
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
