"""Registered queries: validity, score terms, ledger aggregates, graph."""

from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.catalog.registry import query
from memspark.catalog.views import ORDER_KEYS, SUPPLY_KEYS, T_LEDGER, T_NOW, clock, with_views
from memspark.functions import ids, scoring
from memspark.functions.common import blank
from memspark.operators import adjacency, graph, percentiles, temporal
from memspark.operators import utility as ut
from memspark.session import dealt, new_folder

_VALID = f"valid_from <= TIMESTAMP '{T_NOW}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{T_NOW}')"
_MS = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"


@query("P01_valid_facts", with_views("facts") + f"""
SELECT fact_id, kind, epoch_ms(valid_from) AS from_ms, epoch_ms(valid_to) AS to_ms FROM facts WHERE {_VALID}""")
def valid_facts(t):
    return temporal.valid_at(t.facts, clock(T_NOW)).select(
        "fact_id", "kind", F.unix_millis("valid_from").alias("from_ms"), F.unix_millis("valid_to").alias("to_ms")
    )


@query("P01_time_travel", with_views("facts") + """
SELECT kind, count(*) AS n FROM facts
WHERE valid_from <= TIMESTAMP '2024-01-20' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-20') GROUP BY kind""")
def time_travel(t):
    return temporal.valid_at(t.facts, clock("2024-01-20")).groupBy("kind").agg(F.count("*").alias("n"))


@query("P02_purge_eligible", with_views("facts") + """
SELECT fact_id, coalesce(valid_to + to_days(90) <= TIMESTAMP '2024-05-20', false) AS purge FROM facts""")
def purge_eligible(t):
    return t.facts.select("fact_id", temporal.purge_eligible(clock("2024-05-20")).alias("purge"))


@query("P04_provenance_filter", with_views("facts") + """
SELECT tenant_id, count(*) FILTER (coalesce(episode_id, '') = '') AS dropped,
  count(*) FILTER (coalesce(episode_id, '') <> '') AS kept FROM facts GROUP BY 1""")
def provenance_filter(t):
    no = blank(F.col("episode_id"))
    return t.facts.groupBy("tenant_id").agg(F.count_if(no).alias("dropped"), F.count_if(~no).alias("kept"))


@query("S15_closed_facts", with_views("facts") + """
SELECT tenant_id, fact_id, epoch_ms(valid_to) AS to_ms FROM facts WHERE valid_to IS NOT NULL""")
def closed_facts(t):
    return temporal.closed(t.facts).select("tenant_id", "fact_id", F.unix_millis("valid_to").alias("to_ms"))


@query("S16_close_intervals", with_views("facts", "flags") + """
SELECT f.tenant_id, f.fact_id, epoch_ms(CASE WHEN g.fact_id IS NOT NULL THEN TIMESTAMP '2024-03-01' ELSE valid_to END) AS to_ms
FROM facts f LEFT JOIN flags g ON f.fact_id = g.fact_id AND f.tenant_id = g.tenant_id""")
def close_intervals(t):
    ends = t.flags.select("tenant_id", "fact_id", clock("2024-03-01").alias("valid_to"))
    done = temporal.close_intervals(t.facts.select("tenant_id", "fact_id", "valid_to"), ends)
    return done.select("tenant_id", "fact_id", F.unix_millis("valid_to").alias("to_ms"))


@query("F01_recency", with_views("facts") + f"""
SELECT fact_id, round(0.05 + 0.95 * exp(-greatest(0.0,
  (epoch_us(TIMESTAMP '{T_NOW}') - epoch_us(valid_from)) / 1e6 / 86400.0)::DOUBLE / 30.0), 9) AS recency FROM facts""")
def recency(t):
    return t.facts.select("fact_id", F.round(scoring.recency(clock(T_NOW), F.col("valid_from")), 9).alias("recency"))


SQL_UTILITY = f"""raw AS (
  SELECT tenant_id, fact_id, round(sum(CASE event_kind WHEN 'citation' THEN 0.4 WHEN 'tool_success' THEN 0.7
    WHEN 'correction' THEN 1.0 WHEN 'repeat_recall' THEN 0.1 ELSE -0.2 END::DOUBLE
    * exp(-((epoch_us(TIMESTAMP '{T_LEDGER}') - epoch_us(ts)) / 1e6 / 86400.0) / 30.0)), 9) AS utility_raw
  FROM ledger WHERE ts <= TIMESTAMP '{T_LEDGER}' AND ts >= TIMESTAMP '{T_LEDGER}' - to_days(30) GROUP BY ALL),
norm AS (SELECT tenant_id, quantile_disc(utility_raw, 0.95) AS p95 FROM raw GROUP BY 1),
util AS (
  SELECT raw.*, p95, CASE WHEN p95 <= 0 THEN 0.0 ELSE least(1.0, greatest(0.0, utility_raw) / p95) END AS utility
  FROM raw JOIN norm USING (tenant_id))"""


@query("A03_utility_raw", with_views("ledger") + ",\n" + SQL_UTILITY + "\nSELECT tenant_id, fact_id, utility_raw FROM raw")
def utility_raw(t):
    return ut.utility_raw(t.ledger, clock(T_LEDGER)).select("tenant_id", "fact_id", F.round("utility_raw", 9).alias("utility_raw"))


@query("A04_utility", with_views("ledger") + ",\n" + SQL_UTILITY + """
SELECT tenant_id, fact_id, utility_raw, p95, round(utility, 9) AS utility FROM util""")
def utility(t):
    return ut.utility(t.ledger, clock(T_LEDGER)).select(
        "tenant_id", "fact_id", "utility_raw", "p95", F.round("utility", 9).alias("utility")
    )


@query("A05_tenant_p95", with_views("ledger") + ",\n" + SQL_UTILITY + """
SELECT tenant_id, count(*) AS n, quantile_disc(utility_raw, 0.95) AS p95 FROM raw GROUP BY 1""")
def tenant_p95(t):
    raw = ut.utility_raw(t.ledger, clock(T_LEDGER)).withColumn("utility_raw", F.round("utility_raw", 9))
    return percentiles.percentile_disc(raw, "utility_raw", 0.95, ("tenant_id",), "p95")


_COST = """und AS (
  SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(weight) AS weight FROM {} WHERE src <> dst GROUP BY 1, 2),
cost AS (
  SELECT fact_id, round(sum(weight), {}) AS cascade_cost FROM (
    SELECT a AS fact_id, weight FROM und UNION ALL SELECT b, weight FROM und) GROUP BY 1)"""


@query("A06_cascade_cost", with_views("order_graph") + ",\n" + _COST.format("order_graph", 4) + "\nSELECT * FROM cost")
def cascade_cost(t):
    return ut.cascade_cost(t.dealt_order_graph, digits=4, at=ORDER_KEYS)


@query("A07_cascade_p99", with_views("order_graph") + ",\n" + _COST.format("order_graph", 4) + """
SELECT count(*) AS n, quantile_disc(cascade_cost, 0.99) AS p99 FROM cost""")
def cascade_p99(t):
    return percentiles.percentile_disc(ut.cascade_cost(t.dealt_order_graph, digits=4, at=ORDER_KEYS), "cascade_cost", 0.99, name="p99")


@query("F04_gravity", with_views("supply_graph") + ",\n" + _COST.format("supply_graph", 4) + """,
lim AS (SELECT quantile_disc(cascade_cost, 0.99) AS p99 FROM cost)
SELECT fact_id, p99, round(CASE WHEN p99 <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, cascade_cost / p99)) END, 9) AS gravity
FROM cost, lim""")
def gravity(t):
    return ut.with_gravity(ut.cascade_cost(t.supply_graph, digits=4, at=SUPPLY_KEYS)).select(
        "fact_id", "p99", F.round("gravity", 9).alias("gravity")
    )


@query("F04_gravity_by_tenant", """WITH e AS (
  SELECT 'tenant-' || CAST(o_custkey % 10 AS VARCHAR) AS tenant_id, 'c-' || CAST(o_custkey AS VARCHAR) AS a, 'o-' || CAST(o_orderkey AS VARCHAR) AS b,
    CAST(o_totalprice AS DOUBLE) AS w FROM orders),
cost AS (SELECT tenant_id, fact_id, round(sum(w), 4) AS cascade_cost FROM (
  SELECT tenant_id, a AS fact_id, w FROM e UNION ALL SELECT tenant_id, b, w FROM e) GROUP BY ALL),
lim AS (SELECT tenant_id, quantile_disc(cascade_cost, 0.99) AS p99 FROM cost GROUP BY 1)
SELECT tenant_id, fact_id, p99, round(CASE WHEN p99 <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, cascade_cost / p99)) END, 9) AS gravity
FROM cost JOIN lim USING (tenant_id)""")
def gravity_by_tenant(t):
    """Gravity of customers and orders against the 99th percentile of their own tenant."""
    o = dealt(t.table("orders").select(*ORDER_KEYS, "o_totalprice"), *ORDER_KEYS)
    edges = o.select(
        *ORDER_KEYS,
        F.concat(F.lit("tenant-"), (F.col("o_custkey") % 10).cast("string")).alias("tenant_id"),
        F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("dst"),
        F.col("o_totalprice").cast("double").alias("weight"))
    got = ut.with_gravity(ut.cascade_cost(edges, 4, ("tenant_id",), ORDER_KEYS), ("tenant_id",))
    return got.select("tenant_id", "fact_id", "p99", F.round("gravity", 9).alias("gravity"))


@query("A08_contradictions", with_views("ledger") + """
SELECT fact_id, count(DISTINCT props) FILTER (event_kind = 'correction') AS contradiction_count FROM ledger GROUP BY 1""")
def contradictions(t):
    edges = t.ledger.where(F.col("event_kind") == "correction").select("fact_id", F.col("props").alias("contradictor"))
    return ut.contradiction_count(edges, t.ledger.select("fact_id").distinct())


@query("F03_eps_effective", with_views("ledger") + """,
c AS (SELECT fact_id, count(DISTINCT props) FILTER (event_kind = 'correction') AS n FROM ledger GROUP BY 1)
SELECT fact_id, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS indicator, round(0.5 * (1 + ln(1 + n)), 9) AS eps FROM c""")
def eps_effective(t):
    edges = t.ledger.where(F.col("event_kind") == "correction").select("fact_id", F.col("props").alias("contradictor"))
    c = ut.contradiction_count(edges, t.ledger.select("fact_id").distinct())
    n = F.col("contradiction_count")
    return c.select("fact_id", scoring.contradicted(n).alias("indicator"), F.round(scoring.eps_effective(0.5, n), 9).alias("eps"))


# facts scored with ledger terms: the fact's utility and contradictions come from the user with the same number
SQL_SCORE = SQL_UTILITY + f""",
contra AS (SELECT fact_id, count(DISTINCT props) AS n FROM ledger WHERE event_kind = 'correction' GROUP BY 1),
terms AS (
  SELECT f.tenant_id, f.fact_id, f.kind, f.valid_from, f.valid_to, coalesce(u.utility, 0.0) AS util, coalesce(c.n, 0) AS n,
    CASE kind WHEN 'prohibition' THEN 1.0 WHEN 'preference' THEN 0.85 WHEN 'user_fact' THEN 0.7 WHEN 'feedback' THEN 0.55
      WHEN 'procedure' THEN 0.55 WHEN 'narrative' THEN 0.5 WHEN 'project_fact' THEN 0.4 WHEN 'reference' THEN 0.25 END::DOUBLE AS tp,
    CASE WHEN kind IN ('preference', 'prohibition', 'narrative') THEN 0.0 ELSE 0.3 END::DOUBLE AS beta,
    CASE WHEN kind = 'procedure' THEN 180.0 ELSE 30.0 END::DOUBLE AS tau,
    CASE WHEN kind IN ('preference', 'prohibition') THEN 0.3 ELSE 0.5 END::DOUBLE AS eps,
    greatest(0.0, (epoch_us(TIMESTAMP '{T_NOW}') - epoch_us(valid_from)) / 1e6 / 86400.0)::DOUBLE AS age,
    least(1.0, n_chars / 4001.0)::DOUBLE AS conn, least(1.0, n_chars / 8009.0)::DOUBLE AS grav,
    coalesce(valid_to <= TIMESTAMP '{T_NOW}', false) AS closed
  FROM facts f LEFT JOIN util u ON u.fact_id = 'u-' || CAST(f.doc_id AS VARCHAR)
  LEFT JOIN contra c ON c.fact_id = 'u-' || CAST(f.doc_id AS VARCHAR)),
sub AS (
  SELECT *, 0.2 * tp + beta * (0.05 + 0.95 * exp(-age / tau)) + 0.2 * conn + 0.4 * util
    - CASE WHEN n > 0 THEN eps * (1 + ln(1 + n)) ELSE 0 END AS pre FROM terms),
scored AS (
  SELECT tenant_id, fact_id, kind, valid_from, valid_to, round(CASE WHEN closed THEN 0.0 WHEN pre >= 0.2 THEN 1.0
    ELSE greatest(1.0, 1.0 + 0.5 * grav) END * pre, 9) + 0.0 AS score FROM sub)"""


def scored_facts(t):
    """Consolidation-time score of every fact; closed facts score zero."""
    edges = t.ledger.where(F.col("event_kind") == "correction").select("fact_id", F.col("props").alias("contradictor"))
    user = F.concat(F.lit("u-"), F.col("doc_id").cast("string"))
    u = ut.utility(t.ledger, clock(T_LEDGER)).select(F.col("fact_id").alias("_u"), "utility")
    c = ut.contradiction_count(edges).select(F.col("fact_id").alias("_c"), "contradiction_count")
    rows = t.facts.join(u, user == F.col("_u"), "left").join(c, user == F.col("_c"), "left")
    closed = F.coalesce(F.col("valid_to") <= clock(T_NOW), F.lit(False))
    score = scoring.composed_score(
        F.col("kind"), clock(T_NOW), F.col("valid_from"),
        F.least(F.lit(1.0), F.col("n_chars") / 4001.0), F.coalesce("utility", F.lit(0.0)),
        F.coalesce("contradiction_count", F.lit(0)), F.least(F.lit(1.0), F.col("n_chars") / 8009.0), closed,
    )
    return rows.select(
        "tenant_id", "fact_id", "kind", "valid_from", "valid_to", (F.round(score, v.RANK_DIGITS) + 0.0).alias("score")
    )


@query("C05_score_facts", with_views("facts", "ledger") + ",\n" + SQL_SCORE + "\nSELECT fact_id, kind, score FROM scored")
def score_facts(t):
    return scored_facts(t).select("fact_id", "kind", "score")


@query("C10_decisions", with_views("facts", "ledger") + ",\n" + SQL_SCORE + """
SELECT kind, CASE WHEN score >= 0.7 THEN 'promote' WHEN score < 0.2 THEN 'demote' ELSE 'keep' END AS decision, count(*) AS n
FROM scored GROUP BY ALL""")
def decisions(t):
    return scored_facts(t).groupBy("kind", scoring.decision(F.col("score")).alias("decision")).agg(F.count("*").alias("n"))


@query("P14_shapes", with_views("facts") + """
SELECT kind, CASE WHEN kind IN ('preference', 'prohibition') THEN 'preference' WHEN kind IN ('procedure', 'narrative') THEN kind
  ELSE 'episodic_fact' END AS shape, count(*) AS n FROM facts GROUP BY ALL""")
def shapes(t):
    return t.facts.groupBy("kind", scoring.shape_of(F.col("kind")).alias("shape")).agg(F.count("*").alias("n"))


# --- graph --------------------------------------------------------------------------------
@query("A11_out_degree", with_views("supply_graph") + """
SELECT src, round(sum(weight), 4) AS out_weight, count(*) AS out_degree FROM supply_graph GROUP BY 1""")
def out_degree(t):
    return graph.weighted_out_degree(t.supply_graph, 4)


@query("J07_symmetric_edges", with_views("supply_graph") + """,
half AS (SELECT * FROM supply_graph WHERE weight > 0 AND src < dst)
SELECT src, dst, weight FROM half UNION ALL
SELECT dst, src, weight FROM half h ANTI JOIN half r ON r.src = h.dst AND r.dst = h.src""")
def symmetric_edges(t):
    return graph.symmetric(t.supply_graph.where(F.col("src") < F.col("dst")))


_EGO = """adj AS (
  SELECT src, dst FROM {g} QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 500),
seeds AS (SELECT DISTINCT src AS seed FROM {g}),
d1 AS (
  SELECT seed, dst AS node, row_number() OVER (PARTITION BY seed ORDER BY dst) AS ord
  FROM seeds JOIN adj ON src = seed WHERE dst <> seed QUALIFY ord <= 499),
d2 AS (
  SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY ord, node) AS n FROM (
    SELECT d1.seed, a.dst AS node, min(d1.ord) AS ord FROM d1 JOIN adj a ON a.src = d1.node
    WHERE a.dst <> d1.seed GROUP BY ALL) x
  ANTI JOIN d1 ON d1.seed = x.seed AND d1.node = x.node),
taken AS (SELECT seed, count(*) AS c FROM d1 GROUP BY 1),
ego AS (
  SELECT seed, seed AS node, 0 AS depth FROM seeds UNION ALL SELECT seed, node, 1 FROM d1
  UNION ALL SELECT d2.seed, node, 2 FROM d2 JOIN taken USING (seed) WHERE n + c <= 499)"""


@query("G1_ego_sizes", with_views("supply_graph") + ",\n" + _EGO.format(g="supply_graph") + """
SELECT seed, count(*) AS n_nodes, count(*) FILTER (depth = 1) AS n_near, max(node) AS last_node FROM ego GROUP BY seed""")
def ego_sizes(t):
    """Two-hop neighbourhood of every node of a graph with hubs, cut at 500 nodes."""
    stored = adjacency.build(t.supply_graph, new_folder(t.spark, "graph"))
    return adjacency.ego_sizes(stored, t.supply_graph.select(F.col("src").alias("seed"))).drop("scope")


@query("G2_degree_ratio", with_views("supply_graph") + """,
deg AS (SELECT src, count(*) AS d FROM supply_graph GROUP BY 1),
near AS (SELECT g.src, max(coalesce(d.d, 0)) AS m FROM supply_graph g LEFT JOIN deg d ON d.src = g.dst GROUP BY 1)
SELECT deg.src AS fact_id, round(d / greatest(d, m), 9) AS degree_ratio FROM deg JOIN near USING (src)""")
def degree_ratio(t):
    got = graph.degree_ratio(t.supply_graph, t.supply_graph.select(F.col("src").alias("seed")))
    return got.select("fact_id", F.round("degree_ratio", 9).alias("degree_ratio"))


SQL_PPR = _EGO.format(g="order_graph") + """,
inner_e AS (
  SELECT a.seed, g.src, g.dst, g.weight AS w FROM ego a JOIN order_graph g ON g.src = a.node
  JOIN ego b ON b.seed = a.seed AND b.node = g.dst WHERE g.weight > 0),
share AS (SELECT *, w / sum(w) OVER (PARTITION BY seed, src) AS p FROM inner_e),
size AS (SELECT seed, count(*) AS n_nodes FROM ego GROUP BY 1),
walk(seed, it, node, mass, moved) AS (
  SELECT seed, 0, node, CASE WHEN node = seed THEN 1.0 ELSE 0.0 END::DOUBLE, 1.0::DOUBLE FROM ego
  JOIN size USING (seed) WHERE n_nodes >= 10
  UNION ALL
  SELECT seed, it + 1, node, mass, sum(abs(mass - old)) OVER (PARTITION BY seed) FROM (
    SELECT w.seed, w.it, w.node, any_value(w.mass) AS old,
      coalesce(sum(0.85::DOUBLE * s.mass * e.p), 0.0) + CASE WHEN w.node = w.seed THEN 0.15::DOUBLE ELSE 0.0 END AS mass
    FROM walk w LEFT JOIN share e ON e.seed = w.seed AND e.dst = w.node
    LEFT JOIN walk s ON s.seed = w.seed AND s.node = e.src
    WHERE w.it < 50 AND w.moved >= 1e-6 GROUP BY w.seed, w.it, w.node) x),
fin AS (SELECT seed, node, round(mass, 12) AS mass FROM walk QUALIFY it = max(it) OVER (PARTITION BY seed)),
pct AS (
  SELECT o.seed, count(*) FILTER (f.mass < o.mass) / count(*) AS c
  FROM fin o JOIN fin f ON f.seed = o.seed AND f.node <> o.seed WHERE o.node = o.seed GROUP BY 1),
deg AS (SELECT src, count(*) AS d FROM order_graph GROUP BY 1),
near AS (SELECT g.src, max(coalesce(d.d, 0)) AS m FROM order_graph g LEFT JOIN deg d ON d.src = g.dst GROUP BY 1)"""


@query("G4_connectedness", with_views("order_graph").replace("WITH", "WITH RECURSIVE", 1) + ",\n" + SQL_PPR + """
SELECT size.seed AS fact_id, n_nodes, round(CASE WHEN n_nodes < 10 THEN d / greatest(d, m) ELSE pct.c END, 9) AS connectedness
FROM size JOIN deg ON deg.src = size.seed JOIN near ON near.src = size.seed LEFT JOIN pct ON pct.seed = size.seed""")
def connectedness(t):
    """Personalised-PageRank percentile (or degree ratio) of every node of the order graph."""
    stored = adjacency.build(t.order_graph, new_folder(t.spark, "graph"))
    got = adjacency.connectedness(stored, t.order_graph.select(F.col("src").alias("seed")))
    return got.select("fact_id", "n_nodes", F.round("connectedness", 9).alias("connectedness"))


@query("A13_percentile_rank", with_views("order_graph") + """,
deg AS (SELECT src, count(*) AS d FROM order_graph GROUP BY 1),
p AS (SELECT g.src AS hub, g.dst AS node, g.weight AS w FROM order_graph g)
SELECT hub, node, round(CASE WHEN count(*) OVER h = 1 THEN 0.0 ELSE (rank() OVER (h ORDER BY w) - 1) / (count(*) OVER h - 1) END, 9) AS pct_rank
FROM p WINDOW h AS (PARTITION BY hub)""")
def percentile_rank(t):
    rows = t.order_graph.select(
        F.col("src").alias("hub"), F.col("dst").alias("node"), F.col("weight").alias("w"))
    got = percentiles.rank_among_others(rows, "w", ("hub",))
    return got.select("hub", "node", F.round("pct_rank", 9).alias("pct_rank"))


# --- ids ----------------------------------------------------------------------------------
@query("F10_F11_recall_ids", with_views("query_batch") + f""",
h AS (SELECT query_id, tenant_id, substr(sha256('{{"intent":' || to_json(intent) || ',"k":10,"query":' || to_json(text)
  || ',"scope":{{}}}}'), 1, 16) AS query_hash FROM query_batch),
d AS (SELECT *, sha256(tenant_id || query_hash) AS s FROM h),
b AS (SELECT *, CAST('0x' || substr(s, 4, 16) AS UBIGINT) >> 2 | 9223372036854775808::UBIGINT AS tail FROM d)
SELECT query_id, query_hash, lpad(lower(hex(epoch_ms(TIMESTAMP '{T_NOW}'))), 12, '0')[1:8] || '-'
  || lpad(lower(hex(epoch_ms(TIMESTAMP '{T_NOW}'))), 12, '0')[9:12] || '-7' || substr(s, 1, 3) || '-'
  || substr(lower(hex(tail)), 1, 4) || '-' || substr(lower(hex(tail)), 5, 12) AS recall_id FROM b""")
def recall_ids(t):
    from memspark.plans.recall import recall_ids as add_ids

    return add_ids(t.query_batch, clock(T_NOW), 10).select("query_id", "query_hash", "recall_id")


@query("F14_page_ids", with_views("pages_v") + """,
d AS (SELECT page_uri, sha256(page_uri) AS s FROM pages_v)
SELECT page_uri, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-' || substr(s, 13, 4) || '-' || substr(s, 17, 4) || '-'
  || substr(s, 21, 12) AS page_id FROM d""")
def page_ids(t):
    return t.pages.select("page_uri", ids.page_id(F.col("page_uri")).alias("page_id"))


@query("F16_iso_formats", with_views("ledger") + """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ms,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || 'Z' AS us,
  epoch_us(ts) // 1000 AS epoch_ms FROM ledger""")
def iso_formats(t):
    ts = F.col("ts")
    return t.ledger.select("event_id", ids.iso_ms(ts).alias("ms"), ids.iso_us(ts).alias("us"), F.unix_millis(ts).alias("epoch_ms"))
