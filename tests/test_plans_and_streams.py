from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memspark.functions.vectors import hash_vector
from memspark.plans import consolidate, synthesis
from memspark.sources import batches, documents, schemas
from memspark.streaming import extract, windows

T = datetime(2024, 2, 1)
EPISODES = schemas.STORES["episodes"]


def cycle(spark, root, **over):
    facts = spark.createDataFrame(
        [("t", f"f{i}", "user_fact", T - timedelta(days=i * 20), None if i else T - timedelta(days=1)) for i in range(4)],
        "tenant_id string, fact_id string, kind string, valid_from timestamp, valid_to timestamp")
    terms = spark.createDataFrame([("t", "f1", 1.0, 1.0, 0, 0.0), ("t", "f3", 0.0, 0.0, 2, 0.0)],
                                  "tenant_id string, fact_id string, connectedness double, utility double, contradiction_count int, gravity double")
    flags = spark.createDataFrame([], "tenant_id string, fact_id string, tier string")
    eps = spark.createDataFrame([("t", "e1", "hello", "u", T, None)], EPISODES)
    args = dict(spark=spark, root=root, run_id="r1", first_batch=0, now=F.lit(T), facts=facts, flags=flags, terms=terms, episodes=eps, embed=hash_vector)
    return consolidate.Cycle(**{**args, **over})


def test_cycle_runs_in_order_and_once(spark, tmp_path):
    c = cycle(spark, str(tmp_path))
    assert [(n, s) for n, s, _ in consolidate.run(c)] == [(p, "succeeded") for p in ("extract", "score", "promote", "demote", "consolidate", "invalidate")]
    flags = {r.fact_id: r.tier for r in batches.read(spark, str(tmp_path), "promotion_flags_new").collect()}
    assert flags == {"f1": "promoted", "f3": "demoted", "f0": "backfilled"}
    after = {r.fact_id: r.valid_to for r in consolidate.facts_after(c).collect()}
    assert after["f3"] == T and after["f1"] is None
    assert batches.read(spark, str(tmp_path), "phase_events").count() == 6
    consolidate.run(cycle(spark, str(tmp_path)))
    assert batches.read(spark, str(tmp_path), "promotion_flags_new").count() == 3


def test_failed_phase_stops_the_cycle(spark, tmp_path):
    bad_terms = spark.createDataFrame([("t", "f1", 7.0, 1.0, 0, 0.0)],
                                      "tenant_id string, fact_id string, connectedness double, utility double, contradiction_count int, gravity double")
    got = consolidate.run(cycle(spark, str(tmp_path), terms=bad_terms))
    assert [s for _, s, _ in got] == ["succeeded", "failed", "skipped", "skipped", "skipped", "skipped"]
    assert "out of range" in got[1][2] or "SparkException" in got[1][2] or "USER_RAISED" in got[1][2]
    assert not batches.is_committed(spark, str(tmp_path), 1)


def test_due_tenants_and_success(spark):
    state = spark.createDataFrame([("a", None, T - timedelta(minutes=20)), ("b", "x", T - timedelta(minutes=20)), ("c", None, T)],
                                  "tenant_id string, lock_token string, last_run_at timestamp").withColumn("lock_heartbeat_at", F.lit(T)).withColumn("lock_acquired_at", F.lit(T)).withColumn("updated_at", F.lit(T))
    due = consolidate.due_tenants(state, F.lit(T))
    assert [r.tenant_id for r in due.collect()] == ["a"]
    done = {r.tenant_id: r for r in consolidate.mark_success(state, due, F.lit(T)).collect()}
    assert done["a"].last_run_at == T and done["a"].lock_heartbeat_at is None and done["b"].lock_token == "x"


def test_uncommitted_batches_are_invisible(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([(1,)], "x int")
    one.write.parquet(f"{root}/things/batch_id=7")  # a job that died before its commit
    assert batches.append(spark, root, 1, {"things": one})
    assert not batches.append(spark, root, 1, {"things": one})
    assert [(r.x, r.batch_id) for r in batches.read(spark, root, "things").collect()] == [(1, 1)]
    with pytest.raises(ValueError):
        batches.read(spark, root, "nothing")
    made = batches.bootstrap(spark, root)
    assert all(made.values()) and not any(batches.bootstrap(spark, root).values())
    assert batches.read(spark, root, "promotion_flags").count() == 0


def test_schema_upgrade(spark):
    old = spark.createDataFrame([("t", "f", "promoted")], "tenant_id string, fact_id string, tier string")
    assert schemas.upgrade(old, "promotion_flags").schema.names == schemas.TABLES["promotion_flags"].names
    with pytest.raises(ValueError, match="newer"):
        schemas.upgrade(old.withColumn("zz", F.lit(1)), "promotion_flags")
    assert "utility_events" not in schemas.tables_at(3) and "utility_events" in schemas.tables_at(4)
    assert schemas.empty(spark, "facts").count() == 0


def test_corpus_reader(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"fact_id":"f1","kind":"user_fact","content":"x","valid_from":"2024-01-01T00:00:00.000Z","episode_id":"e"}\n\n')
    r = documents.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()
    assert len(r) == 1 and r[0].valid_from == datetime(2024, 1, 1) and r[0].source_uri == "corpus://f1"
    (tmp_path / "v.json").write_text('{"dim": 2, "facts": {"f1": [0.5, 1.0]}, "queries": [{"query_id": "q", "query": "x", "relevant_fact_ids": ["f1"], "vector": [1, 2]}]}')
    vecs, qs = documents.read_vector_document(spark, str(tmp_path / "v.json"))
    assert vecs.first().vec == [0.5, 1.0] and qs.first().relevant_fact_ids == ["f1"]


def test_front_matter(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"---\r\nkind: preference\r\ntitle: \"A: b\"\r\n---\r\nBody\nmore")
    (tmp_path / "b.md").write_text("no envelope\n---\nx")
    md = documents.read_markdown(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in md.select(
        "path", documents.flat_front_matter(F.col("text")).alias("m"), documents.body(F.col("text")).alias("b"), documents.front_matter(F.col("text")).alias("y")).collect()}
    assert got["a.md"].m == {"kind": "preference", "title": "A: b"} == got["a.md"].y and got["a.md"].b == "Body\nmore"
    assert got["b.md"].m == {} and got["b.md"].b.startswith("no envelope")
    back = spark.range(1).select(documents.render(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")), F.lit("text")).alias("t"),
                                 documents.render(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), F.lit("text")).alias("e")).first()
    assert back.t == "---\na: 1\nb: 2\n---\ntext" and back.e == "text"


def test_markdown_files_hold_the_text_alone(spark, tmp_path):
    odd = {"a": "x: y", "b": "'quoted'", "c": 'say "hi"', "d": "yes", "e": "007", "f": " padded ", "g": "# no comment", "h": "it's", "i": "", "j": "plain words", "k": "1.5", "l": "[x]"}
    pairs = F.create_map(*[F.lit(x) for kv in odd.items() for x in kv])
    pages = spark.createDataFrame([("one/two ü", "body\nend"), ("empty", ""), ("crlf", "a\r\nb\n")], "page string, text string")
    made = documents.write_markdown(pages.withColumn("text", documents.render(pairs, F.col("text"))), str(tmp_path / "md"))
    assert made.count() == 3 and (tmp_path / "md" / "one%2Ftwo %C3%BC.md").read_bytes().endswith(b"---\nbody\nend")
    for r in documents.read_markdown(spark, str(tmp_path / "md")).select(documents.flat_front_matter(F.col("text")).alias("m"), documents.front_matter(F.col("text")).alias("y"), documents.body(F.col("text")).alias("b")).collect():
        assert r.m == odd and (documents.yaml is None or r.y == odd) and r.b in ("body\nend", "", "a\r\nb\n")
    with pytest.raises(Exception, match="line break"):
        pages.select(documents.render(F.create_map(F.lit("k"), F.lit("a\nb")), F.col("text"))).collect()


def test_front_matter_must_be_a_mapping(spark):
    if documents.yaml is None:
        pytest.skip("no YAML package")
    df = spark.createDataFrame([("---\n- a\n---\nx",)], "t string")
    with pytest.raises(Exception, match="mapping"):
        df.select(documents.front_matter(F.col("t"))).collect()


def test_log_replay(spark):
    log = spark.createDataFrame([(2, "b", 2), (1, "a", None)], "seq int, fact_id string, n int")
    rows = documents.log_rows(log, ("n", "fact_id"), "note", F.lit(T))
    assert sorted(r.payload_json for r in rows.collect()) == ['{"fact_id":"a","n":null}', '{"fact_id":"b","n":2}']
    seq = log.select("seq", F.to_json(F.struct("fact_id", "n")).alias("payload_json"))
    assert [r.payload.fact_id for r in documents.replay(seq, "fact_id string, n int").collect()] == ["a", "b"]


def test_synthesis(spark):
    pages = spark.createDataFrame([("t", "u1", "green tea and cake"), ("t", "u2", "tea"), ("x", "u3", "tea tea tea")], "tenant_id string, page_uri string, content string")
    req = spark.createDataFrame([("q1", "t", "tea", "u1")], "query_id string, tenant_id string, text string, uri string")
    assert [r.page_uri for r in synthesis.by_query(pages, req, 5).orderBy("rank").collect()] == ["u2", "u1"]
    assert synthesis.by_query(pages, req, 0).count() == 0
    assert synthesis.by_uri(pages, req).first().content == "green tea and cake"
    gone = req.withColumn("uri", F.lit("nope"))
    assert synthesis.by_uri(pages, gone, strict=False).count() == 0
    with pytest.raises(Exception, match="no page"):
        synthesis.by_uri(pages, gone).collect()
    a, b = (synthesis.request_ids(req, F.lit(T), 5, i).first().recall_id for i in synthesis.INTENTS)
    assert a != b
    rows = synthesis.event_rows(synthesis.by_uri(pages, req), synthesis.request_ids(req, F.lit(T), 5, "synthesis_uri")).collect()
    assert len(rows) == 1 and len(rows[0].fact_id) == 36


def write(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def test_extraction_stream_sees_late_files_once(spark, tmp_path):
    src, root, cp = (str(tmp_path / n) for n in ("src", "root", "cp"))
    write(spark, src, [("t", "e2", "later", "u", T, None)], EPISODES, "a")

    def go():
        extract.start(extract.read_stream(spark, f"{src}/*", EPISODES), root, cp, hash_vector).awaitTermination()
        return sorted(r.episode_id for r in batches.read(spark, root, "episode_vectors").collect())

    assert go() == ["e2"]
    assert go() == ["e2"]
    write(spark, src, [("t", "e1", "earlier", "u", T - timedelta(days=9), None)], EPISODES, "b")
    assert go() == ["e1", "e2"]


def test_stream_conflicts_and_retention(spark, tmp_path):
    schema = "tenant_id string, key string, verb string, body_hash string, at timestamp, seq int"
    h = timedelta(hours=1)
    src = str(tmp_path / "src")
    rows = [("k", "v", "a", T, 1), ("k", "v", "a", T + h, 2), ("k", "v", "b", T + 2 * h, 3), ("k", "v", "b", T + 24 * h, 4), ("k", "v", "a", T + 25 * h, 5), ("z", "v", "a", T, 6)]
    write(spark, src, [("t", *r) for r in rows], schema, "a")
    s = spark.readStream.schema(schema).parquet(f"{src}/*")
    windows.to_table(windows.classified(s), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.seq: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "fresh", 2: "replay", 3: "conflict", 4: "fresh", 5: "conflict", 6: "fresh"}


def test_late_requests_are_answered(spark, tmp_path):
    """Files out of order: a request older than what came before gets its outcome like any other."""
    schema = "tenant_id string, key string, verb string, body_hash string, at timestamp, seq int"
    src, m = str(tmp_path / "src"), timedelta(minutes=1)
    files = [[("t", "k1", "v", "a", T, 1)], [("t", "k2", "v", "a", T - m, 2), ("u", "k1", "v", "b", T - 90 * m, 3)], [("t", "k3", "v", "a", T + 60 * m, 4)], [("t", "k1", "v", "a", T - 5 * m, 5)]]
    got = {}
    for i, rows in enumerate(files):
        write(spark, src, rows, schema, f"f{i}")
        s = spark.readStream.schema(schema).parquet(f"{src}/*")
        windows.to_table(windows.classified(s), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got = {r.seq: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "fresh", 2: "fresh", 3: "fresh", 4: "fresh", 5: "replay"}


def test_stream_outcomes_with_no_op(spark, tmp_path):
    h = timedelta(hours=1)
    write(spark, str(tmp_path / "r"), [("r1", T), ("r2", T), ("far", T + 50 * h)], "recall_id string, ts timestamp", "a")
    write(spark, str(tmp_path / "o"), [("r1", "citation", T + timedelta(minutes=5)), ("r2", "citation", T + 2 * h), ("x", "citation", T + 60 * h)], "recall_id string, outcome string, ts timestamp", "a")
    r = spark.readStream.schema("recall_id string, ts timestamp").parquet(f"{tmp_path}/r/*")
    o = spark.readStream.schema("recall_id string, outcome string, ts timestamp").parquet(f"{tmp_path}/o/*")
    windows.to_table(windows.join_outcomes(r, o), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {x.recall_id: x.outcome for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["r1"] == "citation" and got["r2"] == "no_op"


def test_a_request_by_revision_gets_that_page_alone(spark):
    pages = spark.createDataFrame([("t", "u", "old", "rev-1"), ("t", "u", "new", "rev-2"), ("s", "u", "other", "rev-1")], "tenant_id string, page_uri string, content string, revision_id string")
    req = spark.createDataFrame([("r1", "t", "u", "rev-1"), ("r2", "t", "u", "rev-2")], "query_id string, tenant_id string, uri string, revision_id string")
    assert sorted((r.query_id, r.content) for r in synthesis.by_uri(pages, req).collect()) == [("r1", "old"), ("r2", "new")]
    assert synthesis.by_uri(pages, req.drop("revision_id")).count() == 4
    gone = spark.createDataFrame([("r3", "t", "u", "rev-9")], "query_id string, tenant_id string, uri string, revision_id string")
    with pytest.raises(Exception, match="no page at u"):
        synthesis.by_uri(pages, gone).collect()
