"""Registered queries: transitions, outcomes, alarms, metrics, safety, imports, streams."""

import uuid

from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.catalog.registry import query
from memspark.catalog.retrieval import _TWO, sql_recall
from memspark.catalog.scoring import SQL_SCORE, scored_facts
from memspark.catalog.views import DIM, T_LEDGER, T_NOW, clock, with_views
from memspark.functions import scoring
from memspark.functions.ids import import_id
from memspark.operators import contamination, fusion, imports, inbox, knn, lineage, metrics, outcomes, safety, transitions, upsert
from memspark.operators import utility as ut
from memspark.plans import consolidate
from memspark.plans import recall as rc
from memspark.session import new_folder, shared_dir
from memspark.streaming import embed, requests, windows

_SCORES = with_views("facts", "ledger") + ",\n" + SQL_SCORE


LIFT = 1.25  # no fact of the test tables reaches the promote threshold by itself


def _decided(t, verdict: str, decision: str, lift: float = 1.0):
    score = F.col("score") * lift
    s = scored_facts(t).where(F.col("valid_to").isNull() & (scoring.decision(score) == verdict))
    return s.select("tenant_id", "fact_id", score.alias("score_output"), F.lit(decision).alias("decision"))


@query("C06_promote", _SCORES + """
SELECT tenant_id, fact_id, 'promoted' AS tier, 'run-1' AS flag_set_by, 'score_above_theta_promote' AS reason FROM scored
WHERE score * 1.25 >= 0.7 AND valid_to IS NULL""")
def promote(t):
    tr = transitions.promote(t.facts, _decided(t, "promote", "score_above_theta_promote", LIFT), "run-1", clock(T_NOW))
    return tr.flags.drop("flag_set_at")


@query("C07_demote_facts", _SCORES + f"""
SELECT tenant_id, fact_id, epoch_ms(CASE WHEN valid_to IS NULL AND score < 0.2 THEN TIMESTAMP '{T_NOW}' ELSE valid_to END) AS to_ms FROM scored""")
def demote_facts(t):
    """All facts with the end of validity after the demotions."""
    tr = transitions.demote(t.facts, _decided(t, "demote", "score_below_theta_demote"), "run-1", clock(T_NOW), clock(T_NOW))
    return tr.facts.select("tenant_id", "fact_id", F.unix_millis("valid_to").alias("to_ms"))


@query("C08_invalidate_log", with_views("facts") + """
SELECT tenant_id, 'invalidate' AS kind, '{"decision":"superseded","fact_id":"' || fact_id || '","superseded_by":'
  || coalesce('"' || nxt || '"', 'null') || ',"tenant_id":"' || tenant_id || '","run_id":"run-1"}' AS payload_json
FROM (SELECT tenant_id, fact_id, CASE WHEN doc_id % 3 = 0 THEN 'f-' || lpad(CAST(doc_id + 1 AS VARCHAR), 8, '0') END AS nxt FROM facts)""")
def invalidate_log(t):
    nxt = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("f-"), F.lpad((F.col("doc_id") + 1).cast("string"), 8, "0")))
    rows = t.facts.select("tenant_id", "fact_id", F.lit("superseded").alias("decision"), nxt.alias("superseded_by"))
    return transitions.invalidate(t.facts, rows, "run-1", clock(T_NOW), clock(T_NOW)).log.drop("appended_at")


@query("C14_forget_purge", with_views("facts", "flags") + """
SELECT f.tenant_id, f.fact_id, 'ops' AS requested_by, sha256(content) AS content_hash
FROM facts f SEMI JOIN flags g ON f.fact_id = g.fact_id AND f.tenant_id = g.tenant_id""")
def forget_purge(t):
    return transitions.purge(t.facts, t.flags, "ops", "request", clock(T_NOW))[0].select(
        "tenant_id", "fact_id", "requested_by", "content_hash")


@query("C14_version_check", with_views("facts") + """
SELECT fact_id, CASE WHEN doc_id % 9 = 0 THEN 'not_found' WHEN doc_id % 2 = 0 THEN 'version_conflict' ELSE 'intended_not_applied' END AS outcome FROM facts""")
def version_check(t):
    req = t.facts.select("tenant_id", "fact_id", F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1).alias("expected_version"))
    return transitions.check_versions(req, t.facts.where(F.col("doc_id") % 9 != 0)).select("fact_id", "outcome")


_J14 = """WITH d AS (SELECT doc_id, source AS episode_id, 't-' || lang AS tenant_id FROM documents),
n AS (SELECT tenant_id, episode_id, count(*) AS c FROM d GROUP BY ALL)"""


@query("J14_quarantine", _J14 + """
SELECT d.tenant_id, d.episode_id, 'd-' || CAST(doc_id AS VARCHAR) AS fact_id, c AS cascade_count,
  CASE WHEN c > 12 THEN 'precondition_failed' ELSE 'intended_not_applied' END AS outcome FROM d JOIN n USING (tenant_id, episode_id)""")
def quarantine(t):
    """Facts of all documents of a source, the sources taken as quarantined episodes."""
    d = t.table("documents").select(
        F.concat(F.lit("t-"), "lang").alias("tenant_id"), F.col("source").alias("episode_id"),
        F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("fact_id"))
    return transitions.quarantine(d, d, 12)


@query("C15_revalidate", with_views("facts", "flags") + """
SELECT f.fact_id, epoch_ms(CASE WHEN g.fact_id IS NULL THEN valid_to END) AS to_ms FROM facts f
LEFT JOIN flags g ON f.fact_id = g.fact_id AND f.tenant_id = g.tenant_id""")
def revalidate(t):
    return transitions.revalidate(t.facts, t.flags).select("fact_id", F.unix_millis("valid_to").alias("to_ms"))


@query("C16_live_utility", with_views("ledger") + f""",
ends AS (SELECT 'u-' || CAST(c_custkey AS VARCHAR) AS fact_id, 'tenant-' || CAST(c_custkey % 10 AS VARCHAR) AS tenant_id,
  CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 25 AS INTEGER)) END AS valid_to FROM customer)
SELECT l.tenant_id, l.fact_id, round(sum(CASE event_kind WHEN 'citation' THEN 0.4 WHEN 'tool_success' THEN 0.7
    WHEN 'correction' THEN 1.0 WHEN 'repeat_recall' THEN 0.1 ELSE -0.2 END::DOUBLE
    * exp(-((epoch_us(TIMESTAMP '{T_LEDGER}') - epoch_us(ts)) / 1e6 / 86400.0) / 30.0)), 9) AS utility_raw
FROM ledger l LEFT JOIN ends e ON e.fact_id = l.fact_id AND e.tenant_id = l.tenant_id
WHERE (valid_to IS NULL OR ts < valid_to) AND ts <= TIMESTAMP '{T_LEDGER}' AND ts >= TIMESTAMP '{T_LEDGER}' - to_days(30) GROUP BY ALL""")
def live_utility(t):
    """Utility without the events that came after their fact was closed."""
    from memspark.catalog.views import at_day

    c = F.col("c_custkey")
    ends = t.table("customer").select(
        F.concat(F.lit("tenant-"), (c % 10).cast("string")).alias("tenant_id"), F.concat(F.lit("u-"), c.cast("string")).alias("fact_id"),
        F.when(c % 3 == 0, at_day(c % 25)).alias("valid_to"))
    got = ut.utility_raw(ut.live_events(t.ledger, ends), clock(T_LEDGER))
    return got.select("tenant_id", "fact_id", F.round("utility_raw", 9).alias("utility_raw"))


# --- outcomes, alarms ------------------------------------------------------------------------
_J12 = with_views("ledger") + """,
rec AS (SELECT event_id, fact_id AS recall_id, ts FROM ledger WHERE event_kind = 'repeat_recall'),
outc AS (SELECT fact_id AS recall_id, event_kind AS outcome, ts FROM ledger WHERE event_kind <> 'repeat_recall'),
j AS (SELECT r.event_id, r.recall_id, coalesce(o.outcome, 'no_op') AS outcome FROM rec r LEFT JOIN outc o
  ON o.recall_id = r.recall_id AND o.ts >= r.ts AND o.ts <= r.ts + INTERVAL 1 HOUR)"""


def _recalls_and_outcomes(t):
    kind = F.col("event_kind")
    rec = t.ledger.where(kind == "repeat_recall").select("event_id", F.col("fact_id").alias("recall_id"), "ts")
    out = t.ledger.where(kind != "repeat_recall").select(F.col("fact_id").alias("recall_id"), kind.alias("outcome"), "ts")
    return rec, out


@query("J12_recall_outcomes", _J12 + """
SELECT event_id, outcome, count(*) AS n, CASE outcome WHEN 'citation' THEN 0.4 WHEN 'tool_success' THEN 0.7 WHEN 'correction' THEN 1.0 ELSE -0.2 END::DOUBLE AS weight
FROM j GROUP BY event_id, outcome""")
def recall_outcomes(t):
    return outcomes.join_outcomes(*_recalls_and_outcomes(t)).groupBy("event_id", "outcome", "weight").agg(F.count("*").alias("n"))


@query("E8_training_gate", _J12 + """
SELECT round((SELECT avg(CASE WHEN source = 'src1' THEN 1.0 ELSE 0.0 END) FROM documents), 9) AS operator_share, count(*) AS labelled_pairs,
  count(*) >= 10000 AND (SELECT avg(CASE WHEN source = 'src1' THEN 1.0 ELSE 0.0 END) FROM documents) >= 0.2 AS open FROM j""")
def training_gate(t):
    pairs = outcomes.join_outcomes(*_recalls_and_outcomes(t))
    cases = t.table("documents").select(F.when(F.col("source") == "src1", "operator").otherwise("author").alias("source"))
    got = outcomes.training_gate(pairs, cases)
    return got.select(F.round("operator_share", 9).alias("operator_share"), "labelled_pairs", "open")


@query("R8_rolling_rate", with_views("ledger") + """
SELECT event_id, count(*) OVER (PARTITION BY tenant_id ORDER BY ts RANGE BETWEEN INTERVAL 599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n FROM ledger""")
def rolling_rate(t):
    """Requests of the tenant in the last ten minutes, at every request."""
    return outcomes.rolling_count(t.ledger, ("tenant_id",), "ts", 600).select("event_id", "n")


@query("R9_spikes", with_views("ledger") + """,
r AS (SELECT tenant_id, event_kind, count(*) OVER (PARTITION BY tenant_id, event_kind ORDER BY ts
  RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n FROM ledger)
SELECT tenant_id, event_kind, max(n) AS peak FROM r GROUP BY ALL HAVING max(n) > 2""")
def spikes(t):
    """Kinds of feedback with more than two events within a day."""
    return outcomes.spikes(t.ledger, ("tenant_id", "event_kind"), "ts", 86400, 2)


@query("P07_due_tenants", with_views("ledger") + f""",
s AS (SELECT fact_id AS tenant_id, max(ts) AS last FROM ledger GROUP BY 1)
SELECT tenant_id, epoch_us(TIMESTAMP '2024-01-30 18:00:00') - epoch_us(last) >= 900000000 AS due FROM s""")
def due_tenants(t):
    s = t.ledger.groupBy(F.col("fact_id").alias("tenant_id")).agg(F.max("ts").alias("last"))
    now = F.to_timestamp(F.lit("2024-01-30 18:00:00"))
    return s.select("tenant_id", outcomes.due(F.col("last"), now).alias("due"))


@query("P08_free_locks", with_views("ledger") + """,
s AS (SELECT fact_id AS tenant_id, max(ts) AS beat, max(CASE WHEN event_kind = 'no_op' THEN props END) AS token FROM ledger GROUP BY 1)
SELECT tenant_id, token IS NULL OR epoch_us(beat) < epoch_us(TIMESTAMP '2024-01-25') - 60000000 AS free FROM s""")
def free_locks(t):
    s = t.ledger.groupBy(F.col("fact_id").alias("tenant_id")).agg(
        F.max("ts").alias("beat"), F.max(F.when(F.col("event_kind") == "no_op", F.col("props"))).alias("token"))
    return s.select("tenant_id", outcomes.lock_free(F.col("token"), F.col("beat"), clock("2024-01-25")).alias("free"))


@query("E7_queue_gauges", """WITH q AS (
  SELECT 'tenant-' || CAST(o_custkey % 10 AS VARCHAR) AS tenant_id, CASE o_orderstatus WHEN 'O' THEN 'pending_review' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status,
    o_orderdate AS t0 FROM orders)
SELECT tenant_id, count(*) FILTER (status = 'pending_review') AS pending, count(*) FILTER (status = 'approved') AS approved,
  count(*) FILTER (status = 'rejected') AS rejected, 0::BIGINT AS expired,
  round((epoch_us(TIMESTAMP '2024-02-15') - epoch_us(min(t0) FILTER (status = 'pending_review'))) / 3.6e9, 6) AS oldest_hours, true AS alarm
FROM q GROUP BY 1""")
def queue_gauges(t):
    s = F.col("o_orderstatus")
    q = t.table("orders").select(
        F.concat(F.lit("tenant-"), (F.col("o_custkey") % 10).cast("string")).alias("tenant_id"),
        F.when(s == "O", "pending_review").when(s == "F", "approved").otherwise("rejected").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("staged_at"))
    return outcomes.queue_gauges(q, clock(T_NOW)).withColumn("oldest_hours", F.round("oldest_hours", 6))


@query("A24_repeat_recalls", sql_recall(_TWO, 10) + """
SELECT tenant_id, fact_id, count(*) AS recalls FROM (
  SELECT q.tenant_id, c.fact_id FROM cut c JOIN query_batch q USING (query_id) WHERE coalesce(c.episode_id, '') <> '') GROUP BY ALL""")
def repeat_recalls(t):
    """Ledger rows of a whole recall batch, then how often each fact was answered."""
    got = rc.recall(t.facts, t.query_batch, clock(T_NOW), t.fact_vectors, dim=DIM, k=10)
    ledger = rc.ledger_rows(got, rc.recall_ids(t.query_batch, clock(T_NOW), 10), clock(T_NOW)).withColumn("ts", clock(T_NOW))
    return outcomes.repeat_recalls(ledger, clock(T_NOW), clock("2024-02-16"))


@query("A25_contradiction_density", with_views("ledger") + """,
c AS (SELECT tenant_id, fact_id, count(DISTINCT props) AS n FROM ledger WHERE event_kind = 'correction' AND ts >= TIMESTAMP '2024-01-01'
  AND ts < TIMESTAMP '2024-01-31' GROUP BY ALL)
SELECT tenant_id, count(*) AS n, quantile_disc(n, 0.99) AS p99, quantile_disc(n, 0.99) >= 20 AS alarm FROM c GROUP BY 1""")
def contradiction_density(t):
    edges = t.ledger.where(F.col("event_kind") == "correction").withColumn("contradictor", F.col("props"))
    return outcomes.contradiction_density(edges, clock("2024-01-01"), clock("2024-01-31"))


@query("A26_utility_ramp", with_views("ledger") + """
SELECT tenant_id, count(*) AS n, round(CASE WHEN count(*) < 1000 THEN 0.0 ELSE 0.2 * least(1.0, (count(*) - 1000) / 9000.0) END, 9)::DOUBLE AS w
FROM ledger GROUP BY 1""")
def utility_ramp(t):
    n = t.ledger.groupBy("tenant_id").agg(F.count("*").alias("n"))
    return n.withColumn("w", F.round(scoring.utility_ramp(F.col("n")), 9))


@query("F24_rerank", _TWO + """,
fused AS (SELECT query_id, fact_id, coalesce(sum(CASE WHEN source = 'semantic' THEN 1.0::DOUBLE / (60 + rank) END), 0.0)
    + coalesce(sum(CASE WHEN source = 'lexical' THEN 1.0::DOUBLE / (60 + rank) END), 0.0) AS rrf FROM hits GROUP BY ALL),
m AS (SELECT fused.*, CASE WHEN intent = 'update_preference' THEN CASE kind WHEN 'prohibition' THEN 0.5 WHEN 'preference' THEN 1.0 WHEN 'user_fact' THEN 0.3 ELSE 0 END
    WHEN intent = 'state_fact' THEN CASE kind WHEN 'prohibition' THEN 0.3 WHEN 'preference' THEN 0.3 WHEN 'user_fact' THEN 1.0 ELSE 0 END
    WHEN intent = 'procedure_lookup' THEN CASE kind WHEN 'prohibition' THEN 0.5 WHEN 'procedure' THEN 1.0 ELSE 0 END
    ELSE CASE kind WHEN 'user_fact' THEN 0.3 WHEN 'narrative' THEN 1.0 ELSE 0 END END::DOUBLE AS match
  FROM fused JOIN query_batch USING (query_id) JOIN facts USING (fact_id)),
s AS (SELECT query_id, fact_id, round(rrf * (1 + 0.15 * match * 0.8), 9) AS rerank FROM m)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, fact_id) AS rank FROM s QUALIFY rank <= 10""")
def rerank(t):
    """Fused order with the intent bonus; the ledger is too short for a utility prior."""
    fused = fusion.rrf(rc.retrieve(t.facts, t.query_batch, t.fact_vectors, dim=DIM)).drop("rank", "source")
    rows = fused.join(t.facts.select("fact_id", "kind"), "fact_id").join(t.query_batch.select("query_id", "intent"), "query_id")
    zero = F.lit(0.0)
    score = scoring.rerank_score(F.col("rrf"), scoring.intent_match(F.col("intent"), F.col("kind")), F.lit(0.8), zero, zero)
    return fusion.top_k(rows.withColumn("rerank", F.round(score, 9)), 10, "rerank").select(
        "query_id", "fact_id", "rerank", F.col("rank").cast("bigint").alias("rank"))


# --- metrics -----------------------------------------------------------------------------------
_KNN10 = with_views("fact_vectors", "query_batch") + """,
d AS (SELECT q.query_id, v.fact_id, v.label, q.item_id, round(list_distance(q.vec, v.vec), 9) AS distance FROM query_batch q JOIN fact_vectors v USING (tenant_id) WHERE q.vec IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, fact_id) AS rank FROM d QUALIFY rank <= 10),
rel AS (SELECT query_id, 'f-' || lpad(CAST(item_id + d AS VARCHAR), 8, '0') AS fact_id, CASE WHEN d = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS relevance
  FROM query_batch, (VALUES (0), (1)) x(d))"""


def _knn_truth(t):
    """Nearest vectors; the truth of a query is its own item (grade 2) and the next one (grade 1)."""
    ans = knn.nearest(t.fact_vectors, t.query_batch, 10, dim=DIM, by="tenant_id")
    step = F.explode(F.array(F.lit(0), F.lit(1))).alias("d")
    rel = t.query_batch.select("query_id", "item_id", step).select(
        "query_id", F.concat(F.lit("f-"), F.lpad((F.col("item_id") + F.col("d")).cast("string"), 8, "0")).alias("fact_id"),
        F.when(F.col("d") == 0, 2.0).otherwise(1.0).alias("relevance"))
    return ans, rel


@query("A14_hit_rate", _KNN10 + """
SELECT count(*) AS n_queries, count(*) FILTER (h) AS n_hits, round(avg(CASE WHEN h THEN 1.0 ELSE 0.0 END), 9) AS recall_at_k FROM (
  SELECT query_id, bool_or(a.fact_id IS NOT NULL) AS h FROM rel LEFT JOIN a USING (query_id, fact_id) GROUP BY 1)""")
def hit_rate(t):
    ans, rel = _knn_truth(t)
    return metrics.hit_rate(ans, rel, 10).withColumn("recall_at_k", F.round("recall_at_k", 9))


@query("A17_ranking_quality", _KNN10 + """,
ideal AS (SELECT query_id, sum(relevance / log2(r + 1)) AS i FROM (SELECT query_id, relevance,
  row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, fact_id) AS r FROM rel) WHERE r <= 10 GROUP BY 1),
got AS (SELECT query_id, sum(relevance / log2(rank + 1)) AS g, count(*) AS h FROM a JOIN rel USING (query_id, fact_id) GROUP BY 1),
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1)
SELECT query_id, round(coalesce(h, 0) / 10, 9) AS precision, round(coalesce(h, 0) / n, 9) AS recall, round(coalesce(g, 0) / i, 9) AS ndcg
FROM n JOIN ideal USING (query_id) LEFT JOIN got USING (query_id)""")
def ranking_quality(t):
    q = metrics.ranking_quality(*_knn_truth(t), 10)
    return q.select("query_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "ndcg")])


@query("A18_latency_strata", """WITH s AS (SELECT event_type AS path, CASE WHEN user_id % 2 = 0 THEN 'warm' ELSE 'cold' END AS cache, value FROM events)
SELECT 'path' AS strata, 'path=' || path AS stratum, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM s GROUP BY path
UNION ALL SELECT 'path+cache', 'path=' || path || '|cache=' || cache, count(*), quantile_disc(value, 0.5), quantile_disc(value, 0.99) FROM s GROUP BY path, cache""")
def latency_strata(t):
    s = t.table("events").select(
        F.col("event_type").alias("path"), F.when(F.col("user_id") % 2 == 0, "warm").otherwise("cold").alias("cache"), "value")
    return metrics.stratified_percentiles(s, "value", (("path",), ("path", "cache")), {"p50": 0.5, "p99": 0.99})


@query("A19_macro_f1", """WITH r AS (SELECT quality AS truth, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id)),
c AS (SELECT k, count(*) FILTER (truth = k AND predicted = k) AS tp, count(*) FILTER (truth <> k AND predicted = k) AS fp,
  count(*) FILTER (truth = k AND predicted <> k) AS fn FROM r, (VALUES (0), (1)) x(k) GROUP BY k)
SELECT CAST(k AS VARCHAR) AS class, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM c""")
def macro_f1(t):
    """Per-class F1 of a length rule against the quality labels."""
    r = t.table("labels").join(t.table("documents").select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").cast("string").alias("truth"), F.when(F.col("n_chars") >= 1000, "1").otherwise("0").alias("predicted"))
    return metrics.class_f1(r, ("0", "1")).withColumn("f1", F.round("f1", 9))


_A20 = """WITH x AS (SELECT lang AS domain, doc_id AS item, source AS node FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
e AS (SELECT lang AS domain, doc_id AS item, CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE source END AS node FROM documents WHERE n_chars >= 500),
j AS (SELECT coalesce(x.domain, e.domain) AS domain, x.item AS xi, e.item AS ei, x.node = e.node AS same FROM x FULL JOIN e ON x.domain = e.domain AND x.item = e.item),
n AS (SELECT domain, count(xi) AS nx, count(ei) AS ne, count(*) FILTER (xi IS NOT NULL AND ei IS NOT NULL) AS ok,
  count(*) FILTER (xi IS NOT NULL AND ei IS NOT NULL AND same) AS b FROM j GROUP BY 1)"""


@query("A20_extraction_quality", _A20 + """
SELECT domain, round(CASE WHEN ne > 0 THEN ok / ne ELSE 0 END, 9) AS recall, round(CASE WHEN nx > 0 THEN ok / nx ELSE 0 END, 9) AS precision,
  round(2 * ok / (nx + ne), 9) AS f1, round(CASE WHEN ok > 0 THEN b / ok ELSE 0 END, 9) AS disambiguation FROM n""")
def extraction_quality(t):
    d = t.table("documents")
    good = d.join(t.table("labels").where(F.col("quality") == 1), "doc_id")
    x = good.select(F.col("lang").alias("domain"), F.col("doc_id").alias("item"), F.col("source").alias("node"))
    e = d.where(F.col("n_chars") >= 500).select(
        F.col("lang").alias("domain"), F.col("doc_id").alias("item"),
        F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("source")).alias("node"))
    q = metrics.extraction_quality(x, e)
    return q.select("domain", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "f1", "disambiguation")])


@query("A21_budget", """WITH s AS (SELECT lang, n_chars AS tokens FROM documents)
SELECT lang, count(*) FILTER (tokens > 2000) AS n_over, round(avg(CASE WHEN tokens <= 2000 THEN 1.0 ELSE 0.0 END), 9) AS fit_rate,
  quantile_disc(tokens - 2000, 0.95) FILTER (tokens > 2000) AS p95_over, quantile_disc(tokens - 2000, 0.99) FILTER (tokens > 2000) AS p99_over
FROM s GROUP BY lang""")
def budget(t):
    s = t.table("documents").select("lang", F.col("n_chars").alias("tokens"), F.lit(2000).cast("bigint").alias("budget"))
    tail = metrics.over_budget_tail(s, ("lang",)).withColumnRenamed("n", "n_over")
    return metrics.budget_fit(s, ("lang",)).drop("n").join(tail, "lang", "left").fillna(0, ["n_over"]).withColumn(
        "fit_rate", F.round("fit_rate", 9))


@query("A22_token_cost", """
SELECT 'path' AS strata, 'path=' || role AS stratum, count(*) AS n, quantile_disc(length(text), 0.5) AS p50, quantile_disc(length(text), 0.99) AS p99
FROM conversations GROUP BY role""")
def token_cost(t):
    s = t.table("conversations").select(F.col("role").alias("path"), F.length("text").cast("bigint").alias("tokens"))
    return metrics.stratified_percentiles(s, "tokens", (("path",),), {"p50": 0.5, "p99": 0.99})


_SRC = "CASE WHEN doc_id % 10 < 4 THEN 'adversarial' WHEN doc_id % 10 < 7 THEN 'ablation' WHEN doc_id % 10 < 8 THEN 'author' ELSE 'synthetic' END"


def _cases(t):
    m = F.col("doc_id") % 10
    src = F.when(m < 4, "adversarial").when(m < 7, "ablation").when(m < 8, "author").otherwise("synthetic")
    return t.table("labels").select(src.alias("source"), (F.col("quality") == 1).alias("positive"), "doc_id")


@query("A23_composition", f"""WITH c AS (SELECT {_SRC} AS source, quality = 1 AS pos FROM labels),
n AS (SELECT s AS source, count(c.source) AS n, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q
  FROM (VALUES ('operator'), ('adversarial'), ('ablation'), ('synthetic'), ('author')) x(s) LEFT JOIN c ON c.source = s GROUP BY s),
r AS (SELECT source, n, n / sum(n) OVER () AS share, CASE WHEN q > 0 THEN p / q END AS symmetry FROM n)
SELECT source, n, round(share, 9) AS share, round(symmetry, 9) AS symmetry,
  CASE WHEN share < CASE source WHEN 'adversarial' THEN 0.3 WHEN 'ablation' THEN 0.25 ELSE 0 END THEN 'below_floor'
    WHEN share > CASE source WHEN 'operator' THEN 0.0 WHEN 'synthetic' THEN 0.25 WHEN 'author' THEN 0.15 ELSE 1.0 END THEN 'above_cap'
    WHEN n > 0 AND NOT coalesce(symmetry BETWEEN 0.7 AND 1.3, false) THEN 'asymmetric' END AS violation FROM r""")
def composition(t):
    return metrics.composition(_cases(t)).withColumn("share", F.round("share", 9)).withColumn("symmetry", F.round("symmetry", 9))


@query("E9_two_strata", f"""WITH c AS (SELECT {_SRC} AS source, quality FROM labels)
SELECT 'all' AS stratum, count(*) AS n, round(avg(quality), 9) AS positive_share FROM c
UNION ALL SELECT 'strict', count(*), round(avg(quality), 9) FROM c WHERE source IN ('operator', 'adversarial', 'ablation', 'replay-only')""")
def two_strata(t):
    return metrics.two_strata(_cases(t)).groupBy("stratum").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("positive").cast("double")), 9).alias("positive_share"))


@query("E10_retirement", """SELECT count(*) AS n_prior, round(avg(CASE WHEN l.doc_id IS NULL THEN 1.0 ELSE 0.0 END), 9) AS retired_share,
  avg(CASE WHEN l.doc_id IS NULL THEN 1.0 ELSE 0.0 END) > 0.05 AS alarm FROM documents d LEFT JOIN labels l USING (doc_id)""")
def retirement(t):
    got = metrics.retirement(t.table("documents"), t.table("labels"), "doc_id")
    return got.withColumn("retired_share", F.round("retired_share", 9))


_M5 = sql_recall(_TWO, 10) + """,
shown AS (SELECT query_id, fact_id FROM cut WHERE coalesce(episode_id, '') <> ''),
expd AS (SELECT query_id, fact_id FROM lex WHERE rank <= 10),
b AS (SELECT coalesce(e.query_id, s.query_id) AS query_id, e.fact_id AS ef, s.fact_id AS sf FROM expd e FULL JOIN shown s ON e.query_id = s.query_id AND e.fact_id = s.fact_id)"""


@query("M5_probe_drift", _M5 + """
SELECT query_id, round(count(*) FILTER (ef IS NULL OR sf IS NULL) / count(ef), 9) AS drift FROM b GROUP BY 1 HAVING count(ef) > 0""")
def probe_drift(t):
    """Recall answers against the ten best text matches."""
    got = rc.recall(t.facts, t.query_batch, clock(T_NOW), t.fact_vectors, dim=DIM, k=10)
    d = metrics.set_drift(got.best("lexical", 10), got.facts)
    return d.select("query_id", F.round("drift", 9).alias("drift"))


@query("Q9_agreement", _M5 + """
SELECT query_id, round(count(*) FILTER (ef IS NOT NULL AND sf IS NOT NULL) / count(*), 9) AS agreement FROM b GROUP BY 1""")
def agreement(t):
    """Agreement of live answers with a shadow ranking that uses text only."""
    live = rc.recall(t.facts, t.query_batch, clock(T_NOW), t.fact_vectors, dim=DIM, k=10)
    got = metrics.agreement(live.best("lexical", 10), live.facts)
    return got.select("query_id", F.round("agreement", 9).alias("agreement"))


# --- contamination, safety -----------------------------------------------------------------------
@query("V9_contamination", r"""WITH g AS (SELECT doc_id AS doc, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM documents),
h AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM benchmark),
dg AS (SELECT DISTINCT doc, array_to_string(t[i:i + 4], ' ') AS s FROM (SELECT doc, t, unnest(range(1, greatest(2, len(t) - 3))) AS i FROM g WHERE len(t) > 0)),
ig AS (SELECT DISTINCT item_id, array_to_string(t[i:i + 4], ' ') AS s FROM (SELECT item_id, t, unnest(range(1, greatest(2, len(t) - 3))) AS i FROM h WHERE len(t) > 0)),
z AS (SELECT item_id, count(*) AS size FROM ig GROUP BY 1)
SELECT doc, item_id, round(count(*) / any_value(size), 9) AS share FROM dg JOIN ig USING (s) JOIN z USING (item_id)
GROUP BY doc, item_id HAVING count(*) >= ceil(0.8 * any_value(size) - 1e-9)""")
def contamination_guard(t):
    got = contamination.by_content(t.table("documents"), t.table("benchmark"), "doc_id", "text")
    return got.select("doc", "item_id", F.round("share", 9).alias("share"))


@query("E1_confidence_split", """SELECT lang, count(*) FILTER (coalesce(quality >= 1, false)) AS accepted,
  count(*) FILTER (NOT coalesce(quality >= 1, false)) AS quarantined FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def confidence_split(t):
    rows = t.table("documents").join(t.table("labels"), "doc_id", "left").withColumn("confidence", F.col("quality").cast("double"))
    ok, held = safety.split_by_confidence(rows, 1.0)
    both = ok.select("lang", F.lit(1).alias("a")).unionByName(held.select("lang", F.lit(0).alias("a")))
    return both.groupBy("lang").agg(F.sum("a").alias("accepted"), F.sum(1 - F.col("a")).alias("quarantined"))


@query("E2_merged_sources", with_views("ledger") + """
SELECT DISTINCT tenant_id AS merged_id, props AS episode_id FROM ledger""")
def merged_sources(t):
    """Facts merged per tenant keep every source episode of their parts."""
    merges = t.ledger.select("fact_id", F.col("tenant_id").alias("merged_id")).distinct()
    return safety.merged_sources(merges, t.ledger.select("fact_id", F.col("props").alias("episode_id")))


#: Facts are merged (or derived) twice over: number i into i // 2 and i // 3, which makes long chains and many diamonds.
_STEPS = """docs AS (SELECT doc_id AS i, 't-' || lang AS tenant_id, source AS episode_id FROM documents),
steps AS (SELECT DISTINCT tenant_id, i AS part, CASE k WHEN 2 THEN i // 2 ELSE i // 3 END AS whole FROM docs, (VALUES (2), (3)) x(k) WHERE i > 0)"""


def _merged_twice(t):
    d = t.table("documents").select(F.col("doc_id").alias("i"), F.concat(F.lit("t-"), "lang").alias("tenant_id"), F.col("source").alias("episode_id"))
    steps = d.where("i > 0").select("tenant_id", F.col("i").alias("part"), F.explode(F.array(F.floor(F.col("i") / 2), F.floor(F.col("i") / 3))).alias("whole"))
    return d, steps


@query("E2_lineage", f"""WITH RECURSIVE {_STEPS},
up(tenant_id, merged_id, fact_id) AS (
  SELECT tenant_id, whole, part FROM steps UNION SELECT u.tenant_id, u.merged_id, s.part FROM up u JOIN steps s ON s.tenant_id = u.tenant_id AND s.whole = u.fact_id),
every AS (SELECT * FROM up UNION SELECT DISTINCT tenant_id, whole, whole FROM steps)
SELECT e.tenant_id, e.merged_id, count(DISTINCT d.episode_id) AS n_episodes, count(DISTINCT e.fact_id) FILTER (e.fact_id <> e.merged_id) AS n_parts
FROM every e LEFT JOIN docs d ON d.tenant_id = e.tenant_id AND d.i = e.fact_id GROUP BY ALL""")
def lineage_of_merges(t):
    """Parts and source episodes of every merged fact through merges of merges."""
    d, steps = _merged_twice(t)
    merges = steps.select("tenant_id", F.col("part").alias("fact_id"), F.col("whole").alias("merged_id"))
    found = lineage.all_parts(merges)
    behind = lineage.lineage(merges, d.select("tenant_id", F.col("i").alias("fact_id"), "episode_id"), found)
    episodes = behind.groupBy("tenant_id", "merged_id").agg(F.countDistinct("episode_id").alias("n_episodes"))
    parts = found.groupBy("tenant_id", "merged_id").agg(F.count("*").alias("n_parts"))
    every = merges.select("tenant_id", "merged_id").distinct()
    return every.join(episodes, ["tenant_id", "merged_id"], "left").join(parts, ["tenant_id", "merged_id"], "left").fillna(0, ["n_episodes", "n_parts"])


@query("J14_cascade", f"""WITH RECURSIVE {_STEPS},
hit(tenant_id, episode_id, fact) AS (
  SELECT tenant_id, episode_id, i FROM docs UNION SELECT h.tenant_id, h.episode_id, s.whole FROM hit h JOIN steps s ON s.tenant_id = h.tenant_id AND s.part = h.fact)
SELECT tenant_id, episode_id, count(*) AS cascade_count, CASE WHEN count(*) > 40 THEN 'precondition_failed' ELSE 'intended_not_applied' END AS outcome FROM hit GROUP BY 1, 2""")
def quarantine_cascade(t):
    """All that falls with the facts of a source, over every step of derivation."""
    d, steps = _merged_twice(t)
    derived = steps.select("tenant_id", F.col("part").alias("src"), F.col("whole").alias("dst"))
    got = lineage.cascade(d.select("tenant_id", F.col("i").alias("fact_id"), "episode_id"), derived, d, 40)
    return got.select("tenant_id", "episode_id", "cascade_count", "outcome").distinct()


_E3 = """WITH ch AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 25),
pg AS (SELECT DISTINCT 'tenant-' || CAST(o_custkey % 10 AS VARCHAR) AS tenant_id, 'page-' || CAST(o_custkey AS VARCHAR) AS page_uri FROM orders SEMI JOIN ch ON o_orderkey = l_orderkey)"""


@query("E3_regeneration", _E3 + """
SELECT tenant_id, page_uri, CASE WHEN row_number() OVER (PARTITION BY tenant_id ORDER BY page_uri) <= 100 THEN 'regen' ELSE 'pending' END AS state FROM pg""")
def regeneration(t):
    """Customer pages touched by large order lines, one hundred per tenant and cycle."""
    idx = t.table("orders").select(
        F.concat(F.lit("tenant-"), (F.col("o_custkey") % 10).cast("string")).alias("tenant_id"), F.col("o_orderkey").alias("fact_id"),
        F.concat(F.lit("page-"), F.col("o_custkey").cast("string")).alias("page_uri"))
    big = t.table("lineitem").where(F.col("l_quantity") >= 25).select(F.col("l_orderkey").alias("fact_id")).distinct()
    changed = idx.join(big, "fact_id", "left_semi").select("tenant_id", "fact_id")
    return safety.regeneration_plan(changed, idx)


@query("E4_components", """SELECT o_orderkey AS node, -1 - o_custkey AS component FROM orders UNION ALL SELECT DISTINCT -1 - o_custkey, -1 - o_custkey FROM orders""")
def components(t):
    """Clusters of the order graph: a customer (negative id) with all its orders."""
    return safety.components(t.table("orders").select(F.col("o_orderkey").alias("a"), (-1 - F.col("o_custkey")).alias("b")))


_HUB = "CAST(substr(source, 4) AS BIGINT) * 1000000 + ascii(lang) * 1000 + ascii(substr(lang, 2, 1)) + 1"


@query("E4_minority_guard", f"""WITH m AS (SELECT doc_id, {_HUB} AS component, doc_id % 3 = 0 AS open FROM documents),
last AS (SELECT component, min(doc_id) AS only FROM m WHERE open GROUP BY 1 HAVING count(*) = 1)
SELECT m.doc_id AS fact_id, l.only IS NOT NULL AND m.doc_id % 2 = 0 AS protect_minority FROM m LEFT JOIN last l ON l.only = m.doc_id""")
def minority_guard(t):
    """Documents of one source and language dispute one topic; the last open one is kept."""
    d = t.table("documents").select("doc_id", "source", "lang")
    topic = (
        F.substring("source", 4, 10).cast("bigint") * 1000000 + F.ascii("lang") * 1000 + F.ascii(F.substring("lang", 2, 1)) + 1
    )
    i = F.col("doc_id")
    facts = d.select(
        i.alias("fact_id"), F.when(i % 3 != 0, clock("2024-01-05")).alias("valid_to"),
        F.when(i % 2 == 0, clock("2024-01-01")).otherwise(clock("2023-01-01")).alias("recorded_at"))
    return safety.minority_guard(safety.components(d.select(i.alias("a"), (-topic).alias("b"))), facts, clock(T_NOW))


@query("E6_feature_drift", """WITH u AS (SELECT doc_id, lang, source FROM documents),
p AS (SELECT doc_id IN (SELECT doc_id FROM labels) AS cur, 'lang' AS feature, lang AS value FROM u UNION ALL SELECT doc_id IN (SELECT doc_id FROM labels), 'source', source FROM u),
s AS (SELECT feature, value, count(*) / (SELECT count(*) FROM u) AS b, count(*) FILTER (cur) / (SELECT count(*) FROM labels) AS c FROM p GROUP BY ALL)
SELECT feature, round(sum(abs(b - c)) / 2, 9) AS drift, sum(abs(b - c)) / 2 > 0.1 AS alert FROM s GROUP BY 1""")
def feature_drift(t):
    """Labelled documents against all documents."""
    d = t.table("documents")
    got = safety.feature_drift(d, d.join(t.table("labels").select("doc_id"), "doc_id", "left_semi"), ("lang", "source"))
    return got.withColumn("drift", F.round("drift", 9))


@query("E6_hash_sample", """
SELECT doc_id FROM documents WHERE CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS UBIGINT) % 100 < 5""")
def hash_sample(t):
    return safety.sampled(t.table("documents"), "doc_id", 5).select("doc_id")


@query("E11_scrub", r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\p{Nd}{9,}', '[long_number]', 'g'),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g') AS x FROM documents)
SELECT doc_id, md5(regexp_replace(x, '\s', '', 'g')) AS digest FROM s
WHERE NOT regexp_matches(x, '(^|[^\p{L}\p{N}_])(?i:password|passwd|secret|api[_\- ]?key|private[_\- ]?key|ssn|social[_\- ]?security|credit[_\- ]?card)($|[^\p{L}\p{N}_])')
  AND NOT regexp_matches(x, '(sk-|ghp_|gho_|ghs_|xoxb-|xoxp-|AKIA)[A-Za-z0-9]{8,}')""")
def scrub(t):
    d = t.table("documents")
    kept = d.where(~d.text.rlike(r"(sk-|ghp_|gho_|ghs_|xoxb-|xoxp-|AKIA)[A-Za-z0-9]{8,}"))
    s = kept.select("doc_id", safety.scrub(F.col("text")).alias("x")).where(F.col("x").isNotNull())
    return s.select("doc_id", F.md5(F.regexp_replace("x", r"\s", "")).alias("digest"))


@query("R10_inbox", """WITH m AS (SELECT event_id AS msg_id, 'tenant-' || CAST(user_id % 10 AS VARCHAR) AS tenant_id, 'a-' || CAST(user_id % 7 AS VARCHAR) AS recipient,
    CASE event_type WHEN 'error' THEN 'query' WHEN 'view' THEN 'claim' ELSE 'info' END AS type, ts FROM events),
q AS (SELECT tenant_id, recipient, count(*) AS nq FROM m WHERE type = 'query' GROUP BY ALL),
o AS (SELECT m.*, row_number() OVER (PARTITION BY tenant_id, recipient ORDER BY ts DESC, msg_id DESC) AS n FROM m WHERE type <> 'query')
SELECT msg_id FROM m WHERE type = 'query' UNION ALL
SELECT msg_id FROM o LEFT JOIN q USING (tenant_id, recipient) WHERE n <= 100 - coalesce(nq, 0)""")
def inbox_cap(t):
    return inbox.capped(_messages(t)).select("msg_id")


def _messages(t):
    """Events as peer messages: some were acknowledged, some only delivered."""
    e = t.table("events")
    i, sent = F.col("event_id"), F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("msg_id"), F.concat(F.lit("tenant-"), (F.col("user_id") % 10).cast("string")).alias("tenant_id"),
        F.concat(F.lit("a-"), (F.col("user_id") % 7).cast("string")).alias("recipient"),
        F.when(F.col("event_type") == "error", "query").when(F.col("event_type") == "view", "claim").otherwise("info").alias("type"),
        sent.alias("sent_at"), F.when(i % 5 == 0, sent).alias("acked_at"), F.when(i % 3 == 0, sent).alias("delivered_at"))


@query("Q8_inbox_status", f"""WITH m AS (SELECT event_id AS msg_id, 'tenant-' || CAST(user_id % 10 AS VARCHAR) AS tenant_id, 'a-' || CAST(user_id % 7 AS VARCHAR) AS recipient,
    CASE event_type WHEN 'error' THEN 'query' WHEN 'view' THEN 'claim' ELSE 'info' END AS type, ts, event_id % 5 = 0 AS acked, event_id % 3 = 0 AS given,
    ts + INTERVAL 7 DAY > TIMESTAMP '{T_LEDGER}' AS live FROM events),
u AS (SELECT * FROM m WHERE NOT acked AND NOT given AND live),
q AS (SELECT tenant_id, recipient, count(*) AS nq FROM u WHERE type = 'query' GROUP BY ALL),
o AS (SELECT u.*, row_number() OVER (PARTITION BY tenant_id, recipient ORDER BY ts DESC, msg_id DESC) AS n FROM u WHERE type <> 'query'),
k AS (SELECT msg_id FROM u WHERE type = 'query' UNION ALL SELECT msg_id FROM o LEFT JOIN q USING (tenant_id, recipient) WHERE n <= 3 - coalesce(nq, 0))
SELECT msg_id, CASE WHEN acked THEN 'acked' WHEN given THEN 'delivered' WHEN NOT live THEN 'expired' WHEN k.msg_id IS NULL THEN 'dropped_cap' ELSE 'pending' END AS status
FROM m LEFT JOIN k USING (msg_id)""")
def inbox_status(t):
    """State of every message: unread ones that have not expired stay in a box up to its cap (three here)."""
    m, now = _messages(t), clock(T_LEDGER)
    unread = m.where(F.col("acked_at").isNull() & F.col("delivered_at").isNull())
    return inbox.status(m, inbox.capped(inbox.live(unread, now), 3), now)


# --- imports -----------------------------------------------------------------------------------
@query("M1_resume", with_views("ledger") + """
SELECT fact_id AS source_id, status FROM (SELECT fact_id, CASE event_kind WHEN 'citation' THEN 'done' WHEN 'tool_success' THEN 'in_flight' WHEN 'correction' THEN 'failed'
    WHEN 'repeat_recall' THEN 'pending' ELSE 'escalated' END AS status FROM ledger
  QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY event_id DESC) = 1) WHERE status NOT IN ('done', 'escalated', 'orphan_logged')""")
def resume(t):
    k = F.col("event_kind")
    st = F.when(k == "citation", "done").when(k == "tool_success", "in_flight").when(k == "correction", "failed").when(
        k == "repeat_recall", "pending").otherwise("escalated")
    rows = t.ledger.select(F.col("fact_id").alias("source_id"), st.alias("status"), F.col("event_id").alias("seq"))
    return imports.to_resume(rows).select("source_id", "status")


_UUID = """lpad(lower(hex(ms)), 12, '0')[1:8] || '-' || lpad(lower(hex(ms)), 12, '0')[9:12] || '-7' || substr(s, 1, 3) || '-'
  || substr(lower(hex(tail)), 1, 4) || '-' || substr(lower(hex(tail)), 5, 12)"""


@query("M2_import_ids", with_views("facts") + f""",
d AS (SELECT fact_id, k, epoch_ms(valid_from) AS ms, sha256(tenant_id || k || fact_id) AS s FROM facts, (VALUES ('idem'), ('epi'), ('forget'), ('rollback')) x(k)),
b AS (SELECT *, CAST('0x' || substr(s, 4, 16) AS UBIGINT) >> 2 | 9223372036854775808::UBIGINT AS tail FROM d),
u AS (SELECT fact_id, k, {_UUID} AS id FROM b)
SELECT fact_id AS source_id, max(id) FILTER (k = 'idem') AS idem_id, max(id) FILTER (k = 'epi') AS epi_id,
  max(id) FILTER (k = 'forget') AS forget_id, max(id) FILTER (k = 'rollback') AS rollback_id FROM u GROUP BY 1""")
def import_ids(t):
    rows = t.facts.select("tenant_id", F.col("fact_id").alias("source_id"), "valid_from")
    return imports.with_ids(rows, F.col("valid_from")).drop("tenant_id", "valid_from")


@query("M3_gate_sample", """WITH n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents), n
WHERE r <= greatest(ceil(0.01 * n), 50)""")
def gate_sample(t):
    return imports.fixed_sample(t.table("documents").select("doc_id"), "doc_id", 0.01, 50)


@query("M3_id_gate", "SELECT count(*) AS sample_size, count(*) FILTER (doc_id % 97 = 0) AS mismatches FROM documents")
def id_gate(t):
    i = F.col("doc_id")
    good = import_id(F.col("tenant_id"), F.col("valid_from"), "epi", F.col("fact_id"))
    rows = t.facts.withColumn("source_id", F.col("fact_id")).withColumn(
        "applied_episode_id", F.when(i % 97 == 0, F.lit("wrong")).otherwise(good))
    return imports.id_mismatches(rows, F.col("valid_from"))


@query("M4_round_trip", """SELECT source_uri, failure FROM (SELECT 'imp:' || CAST(doc_id AS VARCHAR) AS source_uri, CASE WHEN doc_id % 50 = 0 THEN 'lookup'
  WHEN doc_id % 41 = 0 THEN 'episode_id' WHEN doc_id % 37 = 0 THEN 'content' END AS failure FROM documents) WHERE failure IS NOT NULL""")
def round_trip(t):
    d, i = t.table("documents"), F.col("doc_id")
    uri = F.concat(F.lit("imp:"), i.cast("string"))
    man = d.select(uri.alias("source_uri"), F.concat(F.lit("ep-"), i.cast("string")).alias("applied_episode_id"), F.sha2("text", 256).alias("content_hash"))
    stored = d.where(i % 50 != 0).select(
        uri.alias("source_uri"), F.concat(F.when(i % 41 == 0, F.lit("x-")).otherwise(F.lit("ep-")), i.cast("string")).alias("episode_id"),
        F.when(i % 37 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return imports.round_trip_failures(man, stored)


@query("M6_sections", r"""WITH t AS (SELECT doc_id, string_split(chr(10) || replace(regexp_replace(text, '\r', '', 'g'), chr(10), chr(10) || '## '), chr(10) || '## ') AS p FROM documents),
s AS (SELECT doc_id, p, unnest(range(0, greatest(len(p) - 1, 1))) AS position FROM t)
SELECT doc_id, position, CASE WHEN len(p) = 1 THEN 'root' ELSE regexp_replace(regexp_replace(lower(p[position + 2]), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') END AS section_id FROM s""")
def sections(t):
    """Documents whose lines after the first are turned into headings."""
    text = F.regexp_replace(F.regexp_replace("text", "\r", ""), "\n", "\n## ")
    got = imports.split_sections(t.table("documents").select("doc_id", text.alias("text")))
    return got.select("doc_id", F.col("position").cast("bigint").alias("position"), "section_id")


@query("M7_document_kind", r"""WITH t AS (SELECT doc_id, lang, string_split(regexp_replace(text, '\r', '', 'g'), chr(10)) AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) >= 4 AND lang = 'en' THEN 'procedure' ELSE 'narrative' END AS kind FROM t""")
def document_kind(t):
    """Every line becomes a heading over a three-step list; English titles say guide."""
    text = F.regexp_replace("text", "\r", "")
    body = F.regexp_replace(text, "\n", "\n## step\n1. a\n2. b\n3. c\n")
    title = F.when(F.col("lang") == "en", F.lit("A Guide")).otherwise(F.lit("notes"))
    return t.table("documents").select("doc_id", imports.document_kind(body, title, F.lit(None).cast("array<string>")).alias("kind"))


@query("M8_reembed", "SELECT doc_id AS node_id FROM documents WHERE doc_id % 4 = 1 OR doc_id % 6 = 2")
def reembed(t):
    d, i = t.table("documents"), F.col("doc_id")
    nodes = d.select(i.alias("node_id"), F.col("text").alias("content"))
    vecs = d.where(i % 4 != 1).select(i.alias("node_id"), F.when(i % 6 == 2, F.lit("old")).otherwise(F.sha2("text", 256)).alias("content_hash"))
    return imports.to_reembed(nodes, vecs).select("node_id")


# --- streams -------------------------------------------------------------------------------------
def _event_stream(t):
    schema = t.table("events").schema
    s = t.spark.readStream.schema(schema).parquet(f"{t.dir}/events*.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(t, stream, mode: str = "append"):
    """Run a stream over what is there into a new folder of the shared directory, and read it back."""
    place = f"{shared_dir(t.spark)}/streams/{uuid.uuid4().hex}"
    q = windows.to_table(stream, f"{place}/out", f"{place}/checkpoint", mode)
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{place}/out")


@query("R4_stream_dedup", """SELECT user_id, event_type, count(DISTINCT event_type) AS n FROM events GROUP BY ALL""")
def stream_dedup(t):
    """First event of each user and type; the retention time covers the whole table."""
    s = _event_stream(t).select("user_id", "event_type", "ts")
    out = _finish(t, windows.without_replays(s, ("user_id", "event_type"), "ts", "100 days"))
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("R9_stream_windows", """SELECT event_type, epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS start_ms, count(*) AS n FROM events
WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT make_timestamp((epoch_us(max(ts)) // 1000) * 1000) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""")
def stream_windows(t):
    """Hourly counts whose hour is closed by the watermark."""
    s = _event_stream(t).select("event_type", "ts")
    out = _finish(t, windows.windowed_counts(s, ("event_type",), "ts", "1 hour"))
    return out.select("event_type", F.unix_millis("window_start").alias("start_ms"), "n")


@query("C02_stream_extract", with_views("episodes") + " SELECT episode_id, 32::BIGINT AS dim FROM episodes")
def stream_extract(t):
    """Conversation turns embedded by the incremental extraction stream."""
    from memspark.functions.vectors import hash_vector
    from memspark.sources import batches
    from memspark.streaming import extract

    raw = extract.read_stream(t.spark, f"{t.dir}/conversations*.parquet", t.table("conversations").schema)
    eps = raw.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("episode_id"),
        F.concat(F.lit("tenant-"), (F.col("conv_id") % 10).cast("string")).alias("tenant_id"), F.col("text").alias("body"))
    place = f"{shared_dir(t.spark)}/streams/{uuid.uuid4().hex}"
    extract.start(eps, f"{place}/store", f"{place}/checkpoint", hash_vector).awaitTermination()
    got = batches.read(t.spark, f"{place}/store", "episode_vectors")
    return got.select("episode_id", F.size("embedding").cast("bigint").alias("dim"))


@query("C02_batch_embed", with_views("episodes") + """,
b AS (SELECT episode_id, tenant_id, conv_id, list_transform(range(1, 33), lambda i: (CAST(CAST('0x' || substr(sha256(body), CAST(2 * i - 1 AS INTEGER), 2) AS UBIGINT) AS DOUBLE) - 127.5) / 127.5) AS v FROM episodes),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM b)
SELECT tenant_id, episode_id, CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS run, round(v[1] / s, 8) + 0.0 AS x1, round(v[32] / s, 8) + 0.0 AS x32,
  round(list_sum(list_transform(v, lambda x: round(x / s, 8))), 8) + 0.0 AS total FROM n""")
def batch_embed(t):
    """Two runs of a model over batches of texts; the second gets all episodes and embeds those the first did not have."""
    place = new_folder(t.spark, "stream-embed")
    rows = t.episodes.select("tenant_id", "episode_id", "body", "conv_id")
    for part in (rows.where("conv_id % 2 = 0"), rows):
        part.write.mode("append").parquet(f"{place}/arrived")
        raw = t.spark.readStream.schema(rows.schema).parquet(f"{place}/arrived")
        embed.start(raw, f"{place}/out", f"{place}/checkpoint", embed.hash_model, 32).awaitTermination()
    h = embed.stored(t.spark, f"{place}/out", rows.schema)
    eight = lambda c: (F.round(c, 8) + 0.0)
    return h.select(
        "tenant_id", "episode_id", F.col("batch").alias("run"), eight(F.col("embedding")[0]).alias("x1"), eight(F.col("embedding")[31]).alias("x32"),
        eight(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def _requests(raw):
    """Conversation turns as write requests; every third conversation writes under a key it shares."""
    return raw.select(
        F.concat(F.lit("tenant-"), (F.col("conv_id") % 10).cast("string")).alias("tenant_id"),
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("c"), F.floor(F.col("conv_id") / 10).cast("string")))
        .otherwise(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("key"),
        F.lit("remember").alias("verb"), F.sha2("text", 256).alias("body_hash"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("at"), F.col("turn").alias("seq"))


_PIECE = "CASE WHEN turn = 1 AND conv_id % 4 = 0 THEN 3 ELSE conv_id * 3 // (SELECT max(conv_id) + 1 FROM conversations) END"


@query("R4_stream_late", f"""WITH r AS (SELECT conv_id % 10 AS tenant_id, CASE WHEN conv_id % 3 = 0 THEN 'c' || CAST(conv_id // 10 AS VARCHAR)
    ELSE CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) END AS key, sha256(text) AS h, conv_id * 3600 + turn * 60 AS t, turn, {_PIECE} AS piece FROM conversations),
m AS (SELECT *, max(t) OVER (ORDER BY piece RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM r),
d AS (SELECT *, coalesce(t < high - 7200, false) AS late FROM m),
f AS (SELECT h, first_value(h) OVER w AS fh, row_number() OVER w AS i FROM d WHERE NOT late WINDOW w AS (PARTITION BY tenant_id, key ORDER BY piece, t, turn))
SELECT CASE WHEN i = 1 THEN 'fresh' WHEN h = fh THEN 'replay' ELSE 'conflict' END AS outcome, count(*) AS n FROM f GROUP BY 1
UNION ALL SELECT 'late', count(*) FROM d WHERE late""")
def stream_late(t):
    """Files that arrive out of order: rows two hours behind go to the table of late rows, every row is accounted for."""
    rows = t.table("conversations")
    last = rows.agg((F.max("conv_id") + 1).alias("n"))
    cut = F.when((F.col("turn") == 1) & (F.col("conv_id") % 4 == 0), 3).otherwise(F.floor(F.col("conv_id") * 3 / last.select("n").scalar()))
    place = new_folder(t.spark, "stream-late")
    pieces = rows.withColumn("piece", cut)
    for i in range(4):  # one file each, in this order of arrival
        pieces.where(F.col("piece") == i).drop("piece").coalesce(1).write.mode("append").parquet(f"{place}/arrived")
    raw = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/arrived")
    req = _requests(raw)
    requests.start_dividing(req, f"{place}/divided", f"{place}/c1", "2 hours").awaitTermination()
    out = requests.classified(requests.in_time(t.spark, f"{place}/divided", req.schema), "2 hours")
    windows.to_table(out, f"{place}/out", f"{place}/c2").awaitTermination()
    late = requests.late(t.spark, f"{place}/divided", req.schema)
    answered = t.spark.read.schema(out.schema).parquet(f"{place}/out").groupBy("outcome").agg(F.count("*").alias("n"))
    return answered.union(late.agg(F.lit("late").alias("outcome"), F.count("*").alias("n")))


@query("R6_forward_decay", with_views("ledger") + f""",
w AS (SELECT tenant_id, fact_id, epoch_us(TIMESTAMP '{T_NOW}') / 1e6 / 86400.0 - epoch_us(ts) / 1e6 / 86400.0 AS age,
  CASE event_kind WHEN 'citation' THEN 0.4 WHEN 'tool_success' THEN 0.7 WHEN 'correction' THEN 1.0 WHEN 'repeat_recall' THEN 0.1 WHEN 'no_op' THEN -0.2 END::DOUBLE AS w FROM ledger)
SELECT tenant_id, fact_id, round(sum(w * exp(-age / 30.0)), 9) AS utility_raw FROM w GROUP BY ALL""")
def stream_forward_decay(t):
    """Decayed sums of the feedback stream, one number of state per fact."""
    raw = t.spark.readStream.schema(t.table("events").schema).parquet(f"{t.dir}/events*.parquet")
    sums = windows.forward_decay(t.ledger_of(raw), "2024-01-01 00:00:00")
    place = new_folder(t.spark, "stream-decay")
    windows.latest_sums(sums, f"{place}/sums", f"{place}/checkpoint").awaitTermination()
    stored = t.spark.read.schema(sums.schema.add("batch", "long")).parquet(f"{place}/sums")
    now = windows.decayed_at(upsert.latest(stored, ("tenant_id", "fact_id"), "batch").drop("batch"), "2024-01-01 00:00:00", clock(T_NOW))
    return now.withColumn("utility_raw", F.round("utility_raw", 9))


@query("R4_stream_conflicts", """WITH r AS (SELECT conv_id % 10 AS tenant_id, CASE WHEN conv_id % 3 = 0 THEN 'c' || CAST(conv_id // 10 AS VARCHAR)
    ELSE CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) END AS key, sha256(text) AS h, conv_id * 3600 + turn * 60 AS t, turn FROM conversations),
f AS (SELECT h, first_value(h) OVER w AS fh, row_number() OVER w AS i FROM r WINDOW w AS (PARTITION BY tenant_id, key ORDER BY t, turn))
SELECT CASE WHEN i = 1 THEN 'fresh' WHEN h = fh THEN 'replay' ELSE 'conflict' END AS outcome, count(*) AS n FROM f GROUP BY 1""")
def stream_conflicts(t):
    """Write requests as a stream: fresh, replayed and conflicting keys with a one-day memory."""
    raw = t.spark.readStream.schema(t.table("conversations").schema).parquet(f"{t.dir}/conversations*.parquet")
    req = _requests(raw)
    out = _finish(t, windows.classified(req))
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


_CYCLE_SCORE = SQL_SCORE.replace("coalesce(c.n, 0) AS n", "0 AS n").replace("least(1.0, n_chars / 8009.0)::DOUBLE AS grav", "0.0 AS grav")


@query("C01_cycle", with_views("facts", "ledger", "flags") + ",\n" + _CYCLE_SCORE + """
SELECT tier, reason, count(*) AS n FROM (
  SELECT 'promoted' AS tier, 'score_above_theta_promote' AS reason FROM scored WHERE score >= 0.7 AND valid_to IS NULL
  UNION ALL SELECT 'demoted', 'score_below_theta_demote' FROM scored WHERE score < 0.2 AND valid_to IS NULL
  UNION ALL SELECT 'backfilled', 's1_state_diff' FROM facts f ANTI JOIN flags g ON f.fact_id = g.fact_id AND f.tenant_id = g.tenant_id
    WHERE f.valid_to IS NOT NULL) GROUP BY ALL""")
def cycle(t):
    """One consolidation cycle over all facts; the flags its committed phases appended."""
    place = f"{shared_dir(t.spark)}/cycles/{uuid.uuid4().hex}"
    u = F.concat(F.lit("u-"), F.col("doc_id").cast("string"))
    util = ut.utility(t.ledger, clock(T_LEDGER)).select(F.col("fact_id").alias("_u"), "utility")
    terms = t.facts.join(util, u == F.col("_u"), "left").select(
        "tenant_id", "fact_id", F.least(F.lit(1.0), F.col("n_chars") / 4001.0).alias("connectedness"),
        F.coalesce("utility", F.lit(0.0)).alias("utility"), F.lit(0).alias("contradiction_count"), F.lit(0.0).alias("gravity"))
    from memspark.functions.vectors import hash_vector
    from memspark.sources import batches

    c = consolidate.Cycle(t.spark, place, "run-1", 0, clock(T_NOW), t.facts, t.flags, terms, t.episodes, hash_vector)
    consolidate.run(c)
    got = batches.read(t.spark, place, "promotion_flags_new")
    return got.groupBy("tier", "reason").agg(F.count("*").alias("n"))
