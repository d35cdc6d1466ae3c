"""Registered queries: small operators on their own."""

import uuid

from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.catalog.ingest import envelopes
from memspark.catalog.registry import query
from memspark.catalog.retrieval import _TWO
from memspark.catalog.views import DIM, SUPPLY_KEYS, T_LEDGER, T_NOW, clock, with_views
from memspark.functions import ids, scoring, text
from memspark.functions.common import clamp01
from memspark.operators import contamination, events, fusion, graph, idempotency, knn, lints, outcomes, preferences, temporal, transitions
from memspark.operators import utility as ut
from memspark.plans import recall as rc
from memspark.plans import synthesis
from memspark.session import shared_dir
from memspark.sources import batches, documents, schemas


def _place(t, kind: str) -> str:
    return f"{shared_dir(t.spark)}/{kind}/{uuid.uuid4().hex}"


# --- sources and sinks -----------------------------------------------------------------------
@query("S01_json_lines", with_views("facts") + """
SELECT fact_id, kind, epoch_ms(valid_from) AS from_ms, length(content) AS n_chars, 'corpus://' || fact_id AS source_uri FROM facts""")
def json_lines(t):
    """All facts written as JSON lines and read back through the corpus reader."""
    place = _place(t, "corpus")
    t.facts.select("fact_id", "kind", "content", ids.iso_ms(F.col("valid_from")).alias("valid_from"), "episode_id").write.json(place)
    got = documents.read_corpus(t.spark, place)
    return got.select("fact_id", "kind", F.unix_millis("valid_from").alias("from_ms"), F.length("content").cast("bigint").alias("n_chars"), "source_uri")


@query("S05_mint_uri", with_views("facts") + """
SELECT fact_id, 's4a://' || tenant_id || '/' || kind || '/' || fact_id || '.md' AS uri FROM facts""")
def mint_uri(t):
    rel = F.concat(F.col("kind"), F.lit("/"), F.col("fact_id"), F.lit(".md"))
    return t.facts.select("fact_id", ids.mint_uri(F.col("tenant_id"), rel).alias("uri"))


@query("S06_S23_store_round_trip", with_views("facts", "flags") + """
SELECT 'facts' AS name, count(*) AS n FROM facts UNION ALL SELECT 'promotion_flags', count(*) FROM flags""")
def store_round_trip(t):
    """Two tables appended in one committed batch, next to one batch that never commits."""
    root = _place(t, "store")
    flags = schemas.upgrade(t.flags.drop("seq"), "promotion_flags")
    facts = schemas.upgrade(t.facts.select("tenant_id", "fact_id", "kind", "valid_from", "valid_to"), "facts")
    batches.append(t.spark, root, 1, {"facts": facts, "promotion_flags": flags})
    facts.write.parquet(f"{root}/facts/batch_id=2")
    n = [batches.read(t.spark, root, x).agg(F.lit(x).alias("name"), F.count("*").alias("n")) for x in ("facts", "promotion_flags")]
    return n[0].union(n[1])


@query("S08_J01_vector_rows", """
SELECT 'f-' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS fact_id, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings WHERE vec_id % 3 <> 1""")
def vector_rows(t):
    """Vectors and their keys checked, then joined; those keyed by an episode are no facts."""
    e = t.table("embeddings")
    node = F.concat(F.lit("f-"), F.lpad(F.col("vec_id").cast("string"), 8, "0"))
    keys = e.select(
        F.col("vec_id").alias("rowid"), F.when(F.col("vec_id") % 3 != 1, node).alias("node_id"), F.lit(None).cast("string").alias("edge_id"),
        F.when(F.col("vec_id") % 3 == 1, node).alias("episode_id"))
    rows = knn.checked_vectors(e.select(F.col("vec_id").alias("rowid"), "embedding").join(keys, "rowid"), DIM)
    got = knn.join_keys(rows.select("rowid", "embedding"), rows.select("rowid", "node_id"))
    return got.select("fact_id", F.size("vec").cast("bigint").alias("dim"))


@query("S18_fetch_many", with_views("facts", "fact_vectors") + """
SELECT f.fact_id, kind, lang FROM facts f SEMI JOIN fact_vectors v ON v.fact_id = f.fact_id""")
def fetch_many(t):
    return t.facts.join(t.fact_vectors.select("fact_id"), "fact_id", "left_semi").select("fact_id", "kind", "lang")


@query("S20_log_replay", with_views("ledger") + """
SELECT event_id AS seq, fact_id, event_kind FROM ledger""")
def log_replay(t):
    payload = F.to_json(F.struct("event_kind", "fact_id"))
    log = t.ledger.select(F.col("event_id").alias("seq"), payload.alias("payload_json"))
    return documents.replay(log, "event_kind string, fact_id string").select("seq", "payload.fact_id", "payload.event_kind")


@query("S22_event_sink", """SELECT count(*) AS n FROM events WHERE event_type = 'click' AND event_id % 47 <> 0 AND event_id % 53 <> 0
  AND event_id % 59 <> 0 AND event_id % 43 <> 0""")
def event_sink(t):
    """Valid phase envelopes after a trip through the partitioned JSON sink."""
    place = _place(t, "events")
    events.write_events(envelopes(t), place, rejects=_place(t, "rejects"))
    got = t.spark.read.text(place).where(F.get_json_object("value", "$.event_type") == "consolidate_phase")
    return got.agg(F.count("*").alias("n"))


@query("S22_rejects", """SELECT count(*) AS n FROM events WHERE (event_id % 47 = 0 OR event_id % 53 = 0 OR event_id % 59 = 0 OR event_id % 43 = 0)
  AND event_type = 'click'""")
def event_rejects(t):
    """Phase envelopes the sink turned away, from its reject table."""
    place = _place(t, "rejects")
    events.write_events(envelopes(t), _place(t, "events"), rejects=place)
    got = t.spark.read.parquet(place).where(F.get_json_object("envelope", "$.phase_name").isNotNull() | F.col("envelope").contains("phase"))
    return got.agg(F.count("*").alias("n"))


@query("S24_preference_source", with_views("pages_v") + " SELECT tenant_id, kind, count(*) AS n FROM pages_v GROUP BY ALL")
def preference_source(t):
    return preferences.preference_pages(t.pages).groupBy("tenant_id", "kind").agg(F.count("*").alias("n"))


@query("S26_bootstrap", "SELECT CAST(18 AS BIGINT) AS tables, true AS second_run_idle, count(*) AS n FROM documents")
def bootstrap(t):
    """A new store takes the facts after its tables were made; making them again changes nothing."""
    root = _place(t, "tenant")
    made = batches.bootstrap(t.spark, root)
    again = batches.bootstrap(t.spark, root)
    batches.append(t.spark, root, 0, {"facts": schemas.upgrade(t.facts.select("tenant_id", "fact_id"), "facts")})
    n = batches.read(t.spark, root, "facts").agg(F.count("*").alias("n"))
    return n.select(F.lit(sum(made.values())).cast("bigint").alias("tables"), F.lit(not any(again.values())).alias("second_run_idle"), "n")


# --- predicates -------------------------------------------------------------------------------
@query("P03_filter_then_rank", with_views("facts") + f"""
SELECT kind, fact_id, n_chars FROM facts WHERE valid_from <= TIMESTAMP '{T_NOW}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{T_NOW}')
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n_chars DESC, fact_id) <= 3""")
def filter_then_rank(t):
    alive = temporal.valid_at(t.facts, clock(T_NOW)).withColumn("query_id", F.col("kind"))
    return fusion.top_k(alive, 3, "n_chars").select("kind", "fact_id", "n_chars")


@query("P09_covering_tiers", with_views("ledger") + """
SELECT event_id, event_kind IN ('citation', 'no_op') AS covers FROM ledger""")
def covering_tiers(t):
    tier = F.when(F.col("event_kind") == "citation", v.COVERING_TIERS[0]).when(F.col("event_kind") == "no_op", v.COVERING_TIERS[2]).otherwise("promoted")
    return t.ledger.select("event_id", tier.isin(*v.COVERING_TIERS).alias("covers"))


@query("P15_type_priority", with_views("facts") + """
SELECT fact_id, CASE kind WHEN 'prohibition' THEN 1.0 WHEN 'preference' THEN 0.85 WHEN 'user_fact' THEN 0.7 WHEN 'feedback' THEN 0.55 WHEN 'procedure' THEN 0.55
  WHEN 'narrative' THEN 0.5 WHEN 'project_fact' THEN 0.4 WHEN 'reference' THEN 0.25 END::DOUBLE AS priority,
  CASE WHEN kind IN ('preference', 'prohibition', 'narrative') THEN 0.0 ELSE 0.3 END::DOUBLE AS beta FROM facts""")
def type_priority(t):
    k = F.col("kind")
    return t.facts.select("fact_id", scoring.type_priority(k).alias("priority"), scoring.kind_param(k, 1).alias("beta"))


@query("P18_P19_k_zero", with_views("query_batch") + " SELECT query_id, 0::BIGINT AS n_facts, true AS short_circuit FROM query_batch")
def k_zero(t):
    """k = 0 retrieves nothing and still accounts for every query."""
    got = rc.recall(t.facts, t.query_batch, clock(T_NOW), t.fact_vectors, dim=DIM, k=0)
    n = got.facts.groupBy("query_id").agg(F.count("*").alias("n_facts"))
    return got.filters.join(n, "query_id", "left").select(
        "query_id", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.col("k_zero_short_circuit").alias("short_circuit"))


@query("V3_V4_ranges", with_views("facts") + """
SELECT tenant_id, count(*) FILTER (valid_to IS NOT NULL AND valid_to < valid_from) AS bad_intervals, count(*) FILTER (n_chars / 5000.0 > 1) AS bad_terms FROM facts GROUP BY 1""")
def ranges(t):
    return t.facts.groupBy("tenant_id").agg(
        F.count_if(~temporal.sane_interval()).alias("bad_intervals"), F.count_if(~(F.col("n_chars") / 5000.0).between(0.0, 1.0)).alias("bad_terms"))


@query("V6_provenance_fields", with_views("episodes") + """
SELECT 'provenance-fields' AS lint, tenant_id, episode_id AS subject, CASE WHEN coalesce(source_uri, '') = '' THEN 'source_uri' ELSE 'agent_id' END AS detail
FROM episodes WHERE coalesce(source_uri, '') = '' OR role = 'system'""")
def provenance_fields(t):
    e = t.episodes.withColumn("agent_id", F.when(F.col("role") != "system", F.col("role"))).withColumn("recorded_at", F.col("ts_recorded"))
    return lints.provenance_fields(e)


# --- fusion and scoring terms -------------------------------------------------------------------
@query("A02_F06_rank_proxy", _TWO + """,
fused AS (SELECT query_id, fact_id, coalesce(sum(CASE WHEN source = 'semantic' THEN 1.0::DOUBLE / (60 + rank) END), 0.0)
    + coalesce(sum(CASE WHEN source = 'lexical' THEN 1.0::DOUBLE / (60 + rank) END), 0.0) AS rrf FROM hits GROUP BY ALL)
SELECT query_id, fact_id, round(rrf / max(rrf) OVER (PARTITION BY query_id), 9) AS proxy FROM fused""")
def rank_proxy(t):
    from pyspark.sql import Window

    fused = fusion.rrf(rc.retrieve(t.facts, t.query_batch, t.fact_vectors, dim=DIM))
    top = F.max("rrf").over(Window.partitionBy("query_id"))
    return fused.select("query_id", "fact_id", F.round(clamp01(F.col("rrf") / top), 9).alias("proxy"))


@query("F05_gravity_mult", with_views("facts") + """
SELECT fact_id, CASE WHEN valid_to IS NOT NULL THEN 0.0 WHEN n_chars / 10000.0 >= 0.2 THEN 1.0 ELSE greatest(1.0, 1.0 + 0.5 * (doc_id % 11) / 10.0) END::DOUBLE AS mult FROM facts""")
def gravity_mult(t):
    m = scoring.gravity_mult(F.col("n_chars") / 10000.0, (F.col("doc_id") % 11) / 10.0, F.col("valid_to").isNotNull())
    return t.facts.select("fact_id", m.alias("mult"))


@query("A09_degree", with_views("order_graph") + """,
deg AS (SELECT src, count(*) AS d FROM order_graph GROUP BY 1),
near AS (SELECT g.src, max(coalesce(d.d, 0)) AS m FROM order_graph g LEFT JOIN deg d ON d.src = g.dst GROUP BY 1)
SELECT deg.src AS fact_id, round(d / greatest(d, m), 9) AS degree_ratio FROM deg JOIN near USING (src)""")
def degree(t):
    got = graph.degree_ratio(t.order_graph, t.order_graph.select(F.col("src").alias("seed")))
    return got.select("fact_id", F.round("degree_ratio", 9).alias("degree_ratio"))


@query("J08_undirected_edges", with_views("supply_graph") + """
SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS weight FROM supply_graph WHERE src <> dst GROUP BY 1, 2""")
def undirected_edges(t):
    return ut.undirected(t.supply_graph, at=SUPPLY_KEYS)


# --- ids and JSON ---------------------------------------------------------------------------------
@query("F13_uuid_check", with_views("facts") + """
SELECT fact_id, doc_id % 4 = 0 OR doc_id % 4 = 3 AS ok FROM facts""")
def uuid_check(t):
    i = F.col("doc_id") % 4
    good = ids.uuid7_from_text(F.unix_millis("valid_from"), F.col("fact_id"))
    key = F.when(i == 0, good).when(i == 1, F.lit("nope")).when(i == 2, F.concat(good, F.lit("0"))).otherwise(F.upper(good))
    return t.facts.select("fact_id", ids.is_uuid7(key).alias("ok"))


@query("F15_body_hash", with_views("facts") + """
SELECT fact_id, sha256('{"episode_id":' || coalesce('"' || episode_id || '"', 'null') || ',"kind":"' || kind || '","lang":"' || lang || '"}') AS body_hash FROM facts""")
def body_hash(t):
    return t.facts.select("fact_id", idempotency.body_hash(F.col("episode_id"), F.col("kind"), F.col("lang")).alias("body_hash"))


@query("F20_response_blob", with_views("facts") + " SELECT fact_id, sha256(fact_id) AS body_hash, kind FROM facts")
def response_blob(t):
    blob = idempotency.pack(F.sha2("fact_id", 256), F.struct("kind"))
    got = t.facts.select("fact_id", idempotency.unpack(blob, "struct<kind:string>").alias("r"))
    return got.select("fact_id", "r.body_hash", "r.response.kind")


@query("F22_F23_peer_provenance", with_views("facts") + """
SELECT fact_id, '{"episode_id":"new-' || fact_id || '","source_uri":"self_observation:agent-2","agent_id":"agent-2","recorded_at":"2024-02-15T00:00:00Z"'
  || coalesce(',"derived_from":"' || episode_id || '"', '') || '}' AS provenance FROM facts""")
def peer_provenance(t):
    got = lints.from_peer(t.facts, F.concat(F.lit("new-"), F.col("fact_id")), F.lit("agent-2"), ids.iso_us(clock(T_NOW)))
    return got.select(F.substring("episode_id", 5, 100).alias("fact_id"), lints.provenance_json(F.struct(*got.columns)).alias("provenance"))


@query("Q2_synthesis_ids", with_views("query_batch") + f"""
SELECT query_id, substr(sha256('{{"intent":"synthesis_query","k":5,"query":' || to_json(text) || ',"scope":{{}}}}'), 1, 16) AS query_hash FROM query_batch""")
def synthesis_ids(t):
    return synthesis.request_ids(t.query_batch, clock(T_NOW), 5, "synthesis_query").select("query_id", "query_hash")


# --- lifecycle ----------------------------------------------------------------------------------------
@query("J13_audit", with_views("ledger", "facts") + f"""
SELECT l.event_id, f.source_uri FROM ledger l LEFT JOIN (SELECT 'u-' || CAST(doc_id AS VARCHAR) AS fact_id, tenant_id, source_uri FROM facts) f
  ON f.fact_id = l.fact_id AND f.tenant_id = l.tenant_id WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '{T_LEDGER}'""")
def audit(t):
    prov = t.facts.select("tenant_id", F.concat(F.lit("u-"), F.col("doc_id").cast("string")).alias("fact_id"), "source_uri")
    return outcomes.audit(t.ledger, prov, clock("2024-01-10"), clock(T_LEDGER)).select("event_id", "source_uri")


@query("C14_forget_modes", with_views("facts") + """
SELECT fact_id, CASE doc_id % 3 WHEN 0 THEN 'invalidate' WHEN 1 THEN 'quarantine' ELSE 'purge' END AS mode FROM facts""")
def forget_modes(t):
    m = F.col("doc_id") % 3
    return t.facts.select("fact_id", transitions.forget_mode(F.when(m == 0, "soft").when(m == 1, "deny").otherwise("purge")).alias("mode"))


@query("A25_density_share", with_views("ledger") + """
SELECT tenant_id, round(avg(CASE WHEN c THEN 1.0 ELSE 0.0 END), 9) AS share, avg(CASE WHEN c THEN 1.0 ELSE 0.0 END) > 0.05 AS alarm FROM (
  SELECT tenant_id, fact_id, bool_or(event_kind = 'correction' AND value > 100) AS c FROM ledger GROUP BY ALL) GROUP BY 1""")
def density_share(t):
    bad = t.ledger.where((F.col("event_kind") == "correction") & (F.col("value") > 100))
    got = outcomes.density_share(bad, t.ledger.select("tenant_id", "fact_id").distinct())
    return got.withColumn("share", F.round("share", 9))


@query("R9_stalled", with_views("ledger") + """
SELECT fact_id AS tenant_id, (epoch_us(TIMESTAMP '2024-01-31') // 1000000) - (epoch_us(max(ts)) // 1000000) AS age_seconds FROM ledger GROUP BY 1
HAVING (epoch_us(TIMESTAMP '2024-01-31') // 1000000) - (epoch_us(max(ts)) // 1000000) > 1800""")
def stalled(t):
    s = t.ledger.groupBy(F.col("fact_id").alias("tenant_id")).agg(F.max("ts").alias("last_run_at"))
    return outcomes.stalled(s, clock("2024-01-31")).select("tenant_id", "age_seconds")


@query("V9_protected_ids", with_views("facts", "query_batch") + """
SELECT fact_id FROM facts SEMI JOIN query_batch ON item_id = doc_id""")
def protected_ids(t):
    protected = t.query_batch.select(F.concat(F.lit("f-"), F.lpad(F.col("item_id").cast("string"), 8, "0")).alias("fact_id"))
    return contamination.by_id(t.facts, protected).select("fact_id")


@query("P11_named_turns", with_views("episodes") + r"""
SELECT episode_id, regexp_matches(body, '\p{Nd}') OR regexp_matches(body, '(^|[^\p{L}\p{N}_])[A-Z][a-z]+') AS named FROM episodes""")
def named_turns(t):
    return t.episodes.select("episode_id", text.digit_or_name(F.col("body")).alias("named"))
