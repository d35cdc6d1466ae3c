import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memspark.functions.ids import uuid7_from_text
from memspark.operators import contamination, events, idempotency, imports, inbox, lints, metrics, outcomes, preferences, safety, transitions, upsert
from memspark.plans import remember as rm

T = datetime(2024, 2, 1)
PAGES = "tenant_id string, page_uri string, kind string, revised_at timestamp, bytes bigint"


def greedy(pages, cap):
    kept, total = [], 0
    for p in sorted(pages, key=lambda p: (p[3], p[1]), reverse=True):
        if total + p[4] > cap:
            return kept, total, True
        kept.append(p[1])
        total += p[4]
    return kept, total, False


def test_preference_packing_is_greedy(spark):
    rng = random.Random(9)
    data = []
    for t in range(12):
        for i in range(rng.randint(1, 40)):
            data.append((f"t{t}", f"p{i:02d}", "preference", T + timedelta(hours=rng.randint(0, 9)), rng.choice([0, 0, 1, 5, 30, 120])))
    df = spark.createDataFrame(data, PAGES)
    for cap in (1, 40, 300):
        kept = {}
        for r in preferences.pack(df, cap).collect():
            kept.setdefault(r.tenant_id, set()).add(r.page_uri)
        env = {r.tenant_id: (r.n_pages, r.total_bytes, r.truncated) for r in preferences.envelope(df, cap).collect()}
        for t in {d[0] for d in data}:
            want, total, cut = greedy([d for d in data if d[0] == t], cap)
            assert kept.get(t, set()) == set(want)
            assert env[t] == (len(want), total, cut)
    with pytest.raises(ValueError):
        preferences.pack(df, 0)
    with pytest.raises(Exception, match="negative"):
        preferences.pack(spark.createDataFrame([("t", "p", "preference", T, -1)], PAGES), 10).collect()


def test_latest_first_and_divergence(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "k string, seq int, val string")
    assert {r.k: r.val for r in upsert.latest(rows, ("k",)).collect()} == {"a": "z", "b": "q"}
    assert {r.k: r.val for r in upsert.first(rows, ("k",)).collect()} == {"a": "x", "b": "q"}
    old = spark.createDataFrame([("a", "1")], "k string, p string")
    new = spark.createDataFrame([("a", "1"), ("a", "2"), ("c", "7"), ("c", "7"), ("d", "8"), ("d", "9")], "k string, p string")
    add, bad = upsert.split_new(new, old, ("k",), "p")
    assert sorted(map(tuple, add.collect())) == [("c", "7"), ("d", "8")]
    assert sorted(map(tuple, bad.collect())) == [("a", "2"), ("d", "9")]


def test_cursor_is_strict_and_loses_late_rows(spark):
    rows = spark.createDataFrame([(T, "a"), (T, "b"), (T + timedelta(1), "c"), (T - timedelta(1), "late")], "ts timestamp, id string")
    got = upsert.after(rows, "ts", "id", F.lit(T), F.lit("a"))
    assert sorted(r.id for r in got.collect()) == ["b", "c"]


def key(n):
    return uuid7_from_text(F.lit(1).cast("long"), F.lit(n))


def test_idempotency_outcomes(spark):
    k = spark.range(1).select(key("a").alias("a"), key("b").alias("b"), key("c").alias("c")).first()
    req = spark.createDataFrame(
        [(k.a, "h1", T, 1), (k.a, "h1", T, 2), (k.a, "h2", T, 3), (k.b, "h1", T, 4), (k.b, "h9", T, 5), (k.c, "h3", T, 6), ("zz", "h", T, 7), (None, "h", T, 8)],
        "key string, body_hash string, at timestamp, seq int").withColumn("verb", F.lit("remember")).withColumn("tenant_id", F.lit("t"))
    stored = spark.createDataFrame(
        [(k.b, "remember", "h1", T + timedelta(hours=1)), (k.c, "remember", "old", T)], "key string, verb string, body_hash string, expires_at timestamp").withColumn("tenant_id", F.lit("t"))
    want = {1: "fresh", 2: "replay", 3: "conflict", 4: "replay", 5: "conflict", 6: "fresh", 7: "malformed", 8: "missing"}
    got = {r.seq: r.outcome for r in idempotency.classify(req, stored).collect()}
    assert got == want
    # another tenant may use the same keys, with other bodies
    other = req.withColumn("tenant_id", F.lit("u")).withColumn("seq", F.col("seq") + 10).withColumn("body_hash", F.concat(F.lit("x"), "body_hash"))
    both = {r.seq: r.outcome for r in idempotency.classify(req.unionByName(other), stored).collect()}
    assert both == want | {11: "fresh", 12: "replay", 13: "conflict", 14: "fresh", 15: "conflict", 16: "fresh", 17: "malformed", 18: "missing"}


def test_stored_response_round_trip(spark):
    df = spark.range(1).select(idempotency.pack(F.lit("h"), F.struct(F.lit(1).alias("x"))).alias("b"))
    assert df.select(idempotency.unpack(F.col("b"), "struct<x:int>").alias("r")).first().r.response.x == 1
    for blob in ("nope", '{"version":2,"body_hash":"h","response":{"x":1}}', '{"version":1,"response":{"x":1}}'):
        with pytest.raises(Exception, match="corrupt"):
            spark.createDataFrame([(blob,)], "b string").select(idempotency.unpack(F.col("b"), "struct<x:int>")).collect()


BASE = '"event_id":"e","tenant_id":"t","ts_recorded":"2024-01-01T00:00:00Z","ts_valid":"x","model_version":"m","weights_version":"w","contamination_protected":'


@pytest.mark.parametrize("body,reason", [
    ('true,"event_type":"recall_outcome"', None), ('"true","event_type":"recall_outcome"', "not contamination_protected"),
    ('1,"event_type":"recall_outcome"', "not contamination_protected"), ('true,"event_type":"bogus"', "unknown event_type"),
    ('true,"event_type":"remember","fact_ids":["a"],"decision":1,"provenance":{}', None),
    ('true,"event_type":"remember","fact_ids":[1],"decision":1,"provenance":{}', None),
    ('true,"event_type":"remember","fact_ids":"a","decision":1,"provenance":{}', "fact_ids"),
    ('true,"event_type":"recall","recall_id":"r","fact_ids":["a",1],"path":"recall"', "fact_ids"),
    ('true,"event_type":"recall","recall_id":"","fact_ids":["a"],"path":"recall"', "recall_id"),
    ('true,"event_type":"recall","recall_id":"r","fact_ids":["a"],"path":"synthesis"', None),
    ('true,"event_type":"promote","fact_ids":["a"],"decision":"d","score_output":1', None),
    ('true,"event_type":"promote","fact_ids":["a"],"decision":"d","score_output":true', "score_output"),
    ('true,"event_type":"demote","fact_ids":["a"],"decision":"d","score_output":"1"', "score_output"),
    ('true,"event_type":"invalidate","fact_ids":["a"],"decision":"d","superseded_by":null', None),
    ('true,"event_type":"invalidate","fact_ids":["a"],"decision":"d","superseded_by":""', "superseded_by"),
    ('true,"event_type":"invalidate","fact_ids":["a"],"decision":"d"', "missing field of its type"),
    ('true,"event_type":"consolidate_phase","phase_name":"score","consolidate_run_id":"r"', None),
    ('true,"event_type":"consolidate_phase","phase_name":"nap","consolidate_run_id":"r"', "phase_name"),
])
def test_event_rules(spark, body, reason):
    df = spark.createDataFrame([("{" + BASE + body + "}",)], "envelope string")
    assert events.with_reason(df).first().reason == reason


def test_broken_envelopes(spark):
    df = spark.createDataFrame([("not json",), ("[1]",), (None,), ("{}",)], "envelope string")
    assert [r.reason for r in events.with_reason(df).collect()] == ["not a JSON object"] * 3 + ["missing common field"]


def test_event_sink(spark, tmp_path):
    good = "{" + BASE + 'true,"event_type":"recall_outcome"}'
    rows = spark.createDataFrame([(good,), ("{}",)], "envelope string")
    events.write_events(rows, str(tmp_path / "ev"), rejects=str(tmp_path / "bad"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [("{}", "missing common field")]
    with pytest.raises(Exception, match="rejected envelope"):
        events.write_events(rows, str(tmp_path / "strict"))
    got = spark.read.text(str(tmp_path / "ev"))
    assert [(r.value, r.tenant_id, r.yyyy) for r in got.collect()] == [(good, "t", 2024)]


FACTS = "tenant_id string, fact_id string, valid_to timestamp, content string, version int, episode_id string"


def facts(spark):
    return spark.createDataFrame([("t", "a", None, "A", 1, "e"), ("t", "b", T, "B", 2, "e"), ("t", "c", None, "C", 1, None)], FACTS)


def test_transitions(spark):
    dec = spark.createDataFrame([("t", "a", 0.1, "score_below_theta_demote")], "tenant_id string, fact_id string, score_output double, decision string")
    tr = transitions.demote(facts(spark), dec, "run", F.lit(T), F.lit(T))
    assert {r.fact_id: r.valid_to for r in tr.facts.collect()} == {"a": T, "b": T, "c": None}
    assert tr.flags.first().tier == "demoted" and tr.events.first().ts_valid == "2024-02-01T00:00:00Z"
    with pytest.raises(Exception, match="illegal decision"):
        transitions.promote(facts(spark), dec, "run", F.lit(T)).flags.collect()
    with pytest.raises(ValueError):
        transitions.promote(facts(spark), dec, "", F.lit(T))
    with pytest.raises(ValueError, match="superseded_by"):
        transitions.invalidate(facts(spark), dec, "run", F.lit(T), F.lit(T))
    inv = dec.withColumn("decision", F.lit("superseded")).withColumn("superseded_by", F.lit(None).cast("string"))
    assert '"superseded_by":null' in transitions.invalidate(facts(spark), inv, "run", F.lit(T), F.lit(T)).log.first().payload_json


def test_reconcile_is_idempotent(spark):
    flags = spark.createDataFrame([("t", "b", "promoted")], "tenant_id string, fact_id string, tier string")
    first = transitions.reconcile(facts(spark), flags, F.lit(T))
    assert [r.fact_id for r in first.flags.collect()] == ["b"]
    again = transitions.reconcile(facts(spark), flags.unionByName(first.flags.select("tenant_id", "fact_id", "tier")), F.lit(T))
    assert again.flags.count() == 0


def test_forget(spark):
    f = facts(spark)
    target = f.where("fact_id = 'a'")
    proofs, left = transitions.purge(f, target, "ops", "why", F.lit(T))
    assert proofs.count() == 1 and {r.fact_id for r in left.collect()} == {"b", "c"}
    assert {r.fact_id: r.valid_to for r in transitions.revalidate(f, f.where("fact_id = 'b'")).collect()}["b"] is None
    modes = spark.createDataFrame([("soft",), ("deny",), ("purge",)], "m string").select(transitions.forget_mode(F.col("m"))).collect()
    assert [m[0] for m in modes] == ["invalidate", "quarantine", "purge"]
    with pytest.raises(Exception, match="unknown mode"):
        spark.createDataFrame([("x",)], "m string").select(transitions.forget_mode(F.col("m"))).collect()


def requests(spark, rows):
    cols = "seq int, content string, idempotency_key string, source_uri string, intent string, force_skip boolean, source_kind string, source_subtype string"
    df = spark.createDataFrame(rows, cols)
    none = F.lit(None).cast("string")
    return df.withColumns({"tenant_id": F.lit("t"), "principal": F.lit("p"), "agent_id": none, "derived_from": none, "kind": none, "at": F.lit(T)})


def test_remember_branches(spark, tmp_path):
    k = [r[0] for r in spark.range(9).select(uuid7_from_text(F.lit(1).cast("long"), F.col("id").cast("string"))).collect()]
    rows = [
        (1, "Alice moved to Berlin last year", k[0], "u", None, False, "utterance", None), (2, "ok", k[1], "u", None, False, "utterance", None),
        (3, "the password is x", k[2], "u", None, False, "utterance", None), (4, "the password is x", k[3], "u", "remember:fact", True, "utterance", None),
        (5, "Alice moved to Berlin last year", k[0], "u", None, False, "utterance", None), (6, "other body with this key", k[0], "u", None, False, "utterance", None),
        (7, "Alice moved to Berlin last year", "bad", "u", None, False, "utterance", None), (8, "Alice moved to Berlin last year", k[4], "", None, False, "utterance", None),
        (9, "Alice moved to Berlin last year", k[5], "u", None, True, "utterance", None), (10, "send this to my peer now", k[6], "u", "peer_route", False, "utterance", None),
    ]
    none = spark.createDataFrame([], "tenant_id string, key string, verb string, body_hash string, expires_at timestamp")
    judged = rm.judge(requests(spark, rows), none)
    staged = rm.stage(judged, str(tmp_path / "staged"))
    out = rm.remember(None, none, staged)
    got = {r.seq: (r.outcome, r.http_status) for r in out.judged.collect()}
    assert got == {
        1: ("synchronous_durable", 200), 2: ("dropped", 200), 3: ("staged_for_review", 422), 4: ("synchronous_durable", 200), 5: ("replay", 200),
        6: ("idempotency_conflict", 409), 7: ("missing_idempotency_key", 400), 8: ("provenance_required", 400), 9: ("missing_caller_tag", 400),
        10: ("use_peer_message", 400),
    }
    assert out.episodes.count() == 2 and out.audit_log.count() == 1 and out.idempotency_keys.count() == 4 and out.events.count() == 2
    rq = out.review_queue.first()
    assert rq.status == "pending_review" and rq.expires_at == T + timedelta(days=7)
    ids = {r.episode_id for r in out.episodes.collect()}
    assert ids == {e.fact_ids[0] for e in out.events.collect()}
    later = rm.judge(requests(spark, rows[:1]), out.idempotency_keys.select("tenant_id", "key", "verb", "body_hash", "expires_at"))
    assert later.first().outcome == "replay"


def test_rolling_count(spark):
    rng = random.Random(8)
    data = [(i, rng.choice("ab"), T + timedelta(microseconds=rng.randrange(200_000_000))) for i in range(400)]
    df = spark.createDataFrame(data, "i int, k string, ts timestamp")
    got = {r.i: r.n for r in outcomes.rolling_count(df, ("k",), "ts", 7, 20).collect()}
    want = {i: sum(1 for _, k2, t2 in data if k2 == k and t - timedelta(seconds=7) < t2 <= t) for i, k, t in data}
    assert got == want
    assert outcomes.rate_violations(df, 1, 100.0, ("k",)).count() > 0


def test_rolling_count_adds_up_in_order_of_time(spark):
    """A frame that moves was summed anew for every row; ties, ends of buckets and spans, and rows without a time count as in SQL."""
    rng = random.Random(9)
    data = [(i, rng.choice(["a", "b", None]), rng.choice([None, *(T + timedelta(seconds=s, microseconds=m) for s in range(0, 70, 5) for m in (0, 1, 999_999))])) for i in range(600)]
    df = spark.createDataFrame(data, "i int, k string, ts timestamp")
    found = outcomes.rolling_count(df, ("k",), "ts", 10, 20)
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "specifiedwindowframe(rangeframe, -" not in plan
    inside = lambda t, t2: t2 is None if t is None else t2 is not None and t - timedelta(seconds=10) < t2 <= t
    assert {r.i: r.n for r in found.collect()} == {i: sum(1 for _, k2, t2 in data if k2 == k and inside(t, t2)) for i, k, t in data}
    peaks = {r.k: r.peak for r in outcomes.spikes(df, ("k",), "ts", 10, 2).collect()}
    assert peaks == {k: max(sum(1 for _, k2, t2 in data if k2 == k and inside(t, t2)) for _, k1, t in data if k1 == k) for k in ("a", "b", None)}


def test_gate_and_lock(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, T, None, None), (3, T - timedelta(minutes=15), "x", T), (4, T - timedelta(hours=1), "x", T - timedelta(seconds=61))],
                               "i int, last timestamp, token string, beat timestamp")
    got = {r.i: (r.d, r.f) for r in df.select("i", outcomes.due(F.col("last"), F.lit(T)).alias("d"), outcomes.lock_free(F.col("token"), F.col("beat"), F.lit(T)).alias("f")).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, False), 4: (True, True)}


def test_inbox(spark):
    rows = [(i, "t", "r", "query" if i % 10 == 0 else "info", T + timedelta(minutes=i)) for i in range(150)]
    m = spark.createDataFrame(rows, "msg_id int, tenant_id string, recipient string, type string, sent_at timestamp")
    kept = {r.msg_id for r in inbox.capped(m).collect()}
    queries = {i for i in range(150) if i % 10 == 0}
    others = sorted(set(range(150)) - queries)[-(100 - len(queries)):]
    assert kept == queries | set(others)
    assert inbox.live(m, F.lit(T + timedelta(days=7))).count() == 149
    a = spark.createDataFrame([("claim", "my password"), ("info", "my password"), ("odd", "x")], "type string, payload string")
    assert [r.outcome for r in inbox.accept(a).collect()] == ["classifier_escalate", "pending", "invalid_request"]


def test_lints(spark):
    eps = spark.createDataFrame([("t", "e1", ""), ("t", "e2", "s4a:x.md"), ("t", "e3", "s4a:y.md"), ("t", "e4", "http://z"), ("u", "e5", "http://z"), ("t", "e6", "s4a://t/x.md")],
                                "tenant_id string, episode_id string, source_uri string")
    files = spark.createDataFrame([("t", "s4a/x.md")], "tenant_id string, path string")
    ok = spark.createDataFrame([("u",)], "tenant_id string")
    assert [r.subject for r in lints.provenance_required(eps).collect()] == ["e1"]
    assert sorted(r.subject for r in lints.provenance_resolvable(eps, files, ok).collect()) == ["e3", "e4", "e6"]
    assert sorted(r.subject for r in lints.provenance_resolvable(eps, files, ok, strip_minted=True).collect()) == ["e3", "e4"]
    assert lints.exit_code(lints.run({"a": lambda: lints.provenance_required(eps)})) == 1


def test_contamination_with_a_common_phrase(spark):
    common = "once upon a time there was a small house"
    docs = [(i, f"{common} number{i} alpha{i} beta{i} gamma{i} delta{i}") for i in range(30)]
    docs += [(100, f"{common} and then the very secret answer is forty two indeed yes"), (101, "short one"), (102, "SHORT, one!")]
    items = [(1, f"{common} and then the very secret answer is forty two indeed yes"), (2, "short one"), (3, common), (4, "unrelated words that are never used anywhere")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    p = spark.createDataFrame(items, "item_id int, text string")
    got = sorted((r.doc, r.item_id) for r in contamination.by_content(d, p, "doc_id", "text").collect())
    assert got == sorted([(100, 1), (101, 2), (102, 2), (100, 3)] + [(i, 3) for i in range(30)])
    with pytest.raises(RuntimeError):
        contamination.check(d, contamination.by_content(d, p, "doc_id", "text"))


def test_metrics_small(spark):
    ans = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3)], "query_id string, fact_id string, rank int")
    rel = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0), ("p", "z", 1.0)], "query_id string, fact_id string, relevance double")
    r = {x.query_id: x for x in metrics.ranking_quality(ans, rel, 3).collect()}
    assert r["q"].precision == pytest.approx(2 / 3) and r["q"].recall == 1.0 and r["q"].ndcg == pytest.approx((1 + 0.5) / (1 + 0.6309), abs=1e-3)
    assert r["p"].ndcg == 0.0
    f1 = spark.createDataFrame([("drop", "drop"), ("drop", "escalate"), ("escalate", "escalate")], "truth string, predicted string")
    got = {x["class"]: x.f1 for x in metrics.class_f1(f1).collect()}
    assert got["drop"] == pytest.approx(2 / 3) and got["peer_route"] == 0.0
    assert metrics.macro_f1(f1).first().macro_f1 == pytest.approx((4 / 3) / 7)
    with pytest.raises(ValueError):
        metrics.stratified_percentiles(ans, "rank", ((),), {"p50": 0.5})
    one = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, fact_id string")
    two = spark.createDataFrame([("q", "b"), ("q", "c")], "query_id string, fact_id string")
    assert metrics.set_drift(one, two).first().drift == 1.0
    assert metrics.agreement(one, two).first().agreement == pytest.approx(1 / 3)
    assert metrics.drift_alarm(metrics.set_drift(one, two)).first().investigate


def test_outcome_join(spark):
    r = spark.createDataFrame([("r1", T), ("r2", T), ("r3", T)], "recall_id string, ts timestamp")
    o = spark.createDataFrame([("r1", "citation", T + timedelta(minutes=60)), ("r2", "citation", T + timedelta(minutes=61)), ("r3", "correction", T)], "recall_id string, outcome string, ts timestamp")
    got = {x.recall_id: (x.outcome, x.weight) for x in outcomes.join_outcomes(r, o).collect()}
    assert got == {"r1": ("citation", 0.4), "r2": ("no_op", -0.2), "r3": ("correction", 1.0)}


def test_sections_and_kind(spark):
    d = spark.createDataFrame([(1, "intro\n## First Part\ntext\n## Éclair & Co.\nmore"), (2, "no headings"), (3, "## Only\nx")], "doc_id int, text string")
    got = [(r.doc_id, r.position, r.section_id) for r in imports.split_sections(d).orderBy("doc_id", "position").collect()]
    assert got == [(1, 0, "first-part"), (1, 1, "éclair-co"), (2, 0, "root"), (3, 0, "only")]
    body = "## a\n1. x\n2. y\n3. z\n## b\n## c\n"
    split = "## a\n1. x\n## b\n2. y\n## c\n3. z\n"
    k = spark.createDataFrame([(body, "A guide", None), (body, "x", ["playbook"]), (body, "x", None), (split, "guide", None)], "b string, t string, g array<string>")
    assert [r[0] for r in k.select(imports.document_kind(F.col("b"), F.col("t"), F.col("g"))).collect()] == ["procedure", "procedure", "narrative", "narrative"]


def test_scrub(spark):
    d = spark.createDataFrame([("call 123456789 or a.b@c.org",), ("my password",), ("fine",)], "t string")
    got = d.select(safety.scrub(F.col("t")).alias("s"), safety.scrub_action(F.col("t")).alias("a")).collect()
    assert [(r.s, r.a) for r in got] == [("call [long_number] or [email]", "replace"), (None, "drop"), ("fine", "keep")]


def test_minority_guard(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node int, component int")
    f = spark.createDataFrame([(1, T, T), (2, None, T), (5, None, T), (6, None, T)], "fact_id int, valid_to timestamp, recorded_at timestamp")
    got = {r.fact_id: r.protect_minority for r in safety.minority_guard(clusters, f, F.lit(T)).collect()}
    assert got == {1: False, 2: True, 5: False, 6: False}
    late = safety.minority_guard(clusters, f, F.lit(T + timedelta(days=90)))
    assert not any(r.protect_minority for r in late.collect())
