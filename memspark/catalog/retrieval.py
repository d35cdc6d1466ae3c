"""Registered queries: ranked lists, fusion, recall."""

from pyspark.sql import functions as F

from memspark.catalog.registry import query
from memspark.catalog.views import DIM, T_NOW, clock, with_views
from memspark.operators import bm25, fusion, knn, temporal, vector_cells
from memspark.operators import text_index as stored_text
from memspark.plans import evaluate
from memspark.plans import recall as rc
from memspark.session import new_folder

_VALID = f"valid_from <= TIMESTAMP '{T_NOW}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{T_NOW}')"

SQL_SEM = """dist AS (
  SELECT q.query_id, v.fact_id, round(list_distance(q.vec, v.vec), 9) AS distance
  FROM query_batch q JOIN fact_vectors v USING (tenant_id) WHERE q.vec IS NOT NULL),
sem AS (
  SELECT query_id, fact_id, distance, 1.0 / (1.0 + distance) AS score, 'semantic' AS source,
    row_number() OVER (PARTITION BY query_id ORDER BY distance, fact_id) AS rank
  FROM dist QUALIFY rank <= 50)"""

SQL_LEX = """toks AS (
  SELECT tenant_id, fact_id, regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+') AS t FROM facts),
doclen AS (SELECT tenant_id, fact_id, CAST(len(t) AS DOUBLE) AS doc_len FROM toks),
stats AS (SELECT tenant_id, CAST(count(*) AS DOUBLE) AS n_docs, avg(doc_len) AS avg_len FROM doclen GROUP BY tenant_id),
tf AS (SELECT tenant_id, fact_id, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT tenant_id, fact_id, unnest(t) AS term FROM toks) GROUP BY ALL),
df AS (SELECT tenant_id, term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY ALL),
qt AS (
  SELECT tenant_id, query_id, term, CAST(count(*) AS DOUBLE) AS weight FROM (
    SELECT tenant_id, query_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS term FROM query_batch)
  GROUP BY ALL),
qw AS (
  SELECT tenant_id, query_id, term, avg_len, weight * CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6
    ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END AS w
  FROM qt JOIN df USING (tenant_id, term) JOIN stats USING (tenant_id)),
lexs AS (
  SELECT query_id, fact_id, round(sum(w * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 9) AS score
  FROM tf JOIN qw USING (tenant_id, term) JOIN doclen USING (tenant_id, fact_id) GROUP BY ALL),
lex AS (
  SELECT query_id, fact_id, score, 'lexical' AS source,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS rank
  FROM lexs QUALIFY rank <= 50)"""

SQL_GRAPH = """near AS (
  SELECT tenant_id, source_uri, fact_id, row_number() OVER (PARTITION BY tenant_id, source_uri ORDER BY fact_id) AS rank
  FROM facts QUALIFY rank <= 50),
gra AS (
  SELECT q.query_id, near.fact_id, 1.0 / near.rank AS score, 'graph' AS source, near.rank
  FROM query_batch q JOIN facts f ON f.doc_id = q.item_id JOIN near ON near.source_uri = f.source_uri AND near.tenant_id = q.tenant_id)"""

_ALL = with_views("facts", "fact_vectors", "query_batch") + ",\n" + ",\n".join([SQL_SEM, SQL_LEX, SQL_GRAPH]) + """,
hits AS (
  SELECT query_id, fact_id, score, source, rank FROM sem UNION ALL SELECT query_id, fact_id, score, source, rank FROM lex
  UNION ALL SELECT query_id, fact_id, score, source, rank FROM gra)"""


def sql_recall(lists: str, k: int) -> str:
    """CTE chain from ``hits`` to ``answers``/``filters``; ``lists`` defines ``hits``."""
    return lists + f""",
wanted AS (SELECT DISTINCT query_id, fact_id FROM hits),
alive AS (SELECT query_id, f.* FROM wanted JOIN facts f USING (fact_id) WHERE {_VALID}),
kept AS (
  SELECT h.query_id, h.fact_id, h.source,
    row_number() OVER (PARTITION BY h.query_id, h.source ORDER BY h.rank) AS rank
  FROM hits h SEMI JOIN alive a ON h.query_id = a.query_id AND h.fact_id = a.fact_id),
fused AS (
  SELECT query_id, fact_id,
    coalesce(sum(CASE WHEN source = 'semantic' THEN 1.0::DOUBLE / (60 + rank) END), 0.0)
    + coalesce(sum(CASE WHEN source = 'lexical' THEN 1.0::DOUBLE / (60 + rank) END), 0.0)
    + coalesce(sum(CASE WHEN source = 'graph' THEN 1.0::DOUBLE / (60 + rank) END), 0.0) AS rrf,
    min(CASE source WHEN 'semantic' THEN 0 WHEN 'lexical' THEN 1 ELSE 2 END) AS prio
  FROM kept GROUP BY ALL),
priced AS (
  SELECT f.query_id, a.*, f.rrf, f.prio, f.rrf / max(f.rrf) OVER (PARTITION BY f.query_id) AS conn,
    CASE kind WHEN 'prohibition' THEN 1.0 WHEN 'preference' THEN 0.85 WHEN 'user_fact' THEN 0.7 WHEN 'feedback' THEN 0.55
      WHEN 'procedure' THEN 0.55 WHEN 'narrative' THEN 0.5 WHEN 'project_fact' THEN 0.4 WHEN 'reference' THEN 0.25
      ELSE 0.3 END::DOUBLE AS tp,
    CASE WHEN kind IN ('preference', 'prohibition', 'narrative') THEN 0.0 ELSE 0.3 END::DOUBLE AS beta,
    CASE WHEN kind = 'procedure' THEN 180.0 ELSE 30.0 END::DOUBLE AS tau,
    greatest(0.0, epoch_us(TIMESTAMP '{T_NOW}') / 1e6 / 86400.0 - epoch_us(valid_from) / 1e6 / 86400.0)::DOUBLE AS age
  FROM fused f JOIN alive a ON f.query_id = a.query_id AND f.fact_id = a.fact_id),
scored AS (
  SELECT *, round(0.2::DOUBLE * tp + beta * (0.05::DOUBLE + 0.95::DOUBLE * exp(-age / tau)) + 0.2::DOUBLE * conn, 9) AS sub
  FROM priced),
cut AS (
  SELECT query_id, fact_id, kind, episode_id, sub AS score, round(conn, 9) AS connectedness_value,
    row_number() OVER (PARTITION BY query_id ORDER BY sub DESC, fact_id) AS rank
  FROM scored QUALIFY rank <= {k})"""


_TWO = with_views("facts", "fact_vectors", "query_batch") + ",\n" + SQL_SEM + ",\n" + SQL_LEX + """,
hits AS (
  SELECT query_id, fact_id, score, source, rank FROM sem UNION ALL SELECT query_id, fact_id, score, source, rank FROM lex)"""


@query("S09_vector_knn", with_views("fact_vectors", "query_batch") + ",\n" + SQL_SEM + """
SELECT query_id, fact_id, distance, round(score, 9) AS score, rank FROM sem""")
def vector_knn(t):
    hits = knn.nearest(t.fact_vectors, t.query_batch, dim=DIM, by="tenant_id")
    return hits.select("query_id", "fact_id", "distance", F.round("score", 9).alias("score"), F.col("rank").cast("bigint"))


@query("S09_cells", with_views("fact_vectors", "query_batch") + ",\n" + SQL_SEM.replace("rank <= 50", "rank <= 10") + """
SELECT query_id, fact_id, distance, round(score, 9) AS score, rank FROM sem""")
def vector_cells_search(t):
    """Ten nearest vectors by cells that the triangle inequality cannot rule out."""
    stored = vector_cells.build(t.fact_vectors, new_folder(t.spark, "vector-cells"), dim=DIM, by="tenant_id")
    hits = vector_cells.nearest(stored, t.query_batch, 10, by="tenant_id").hits
    return hits.select("query_id", "fact_id", "distance", F.round("score", 9).alias("score"), F.col("rank").cast("bigint"))


@query("S10_text_index", with_views("facts") + """,
toks AS (SELECT fact_id, regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+') AS t FROM facts),
tf AS (SELECT fact_id, len(t) AS doc_len, unnest(t) AS term FROM toks)
SELECT term, count(DISTINCT fact_id) AS df, count(*) AS occurrences, max(doc_len) AS longest FROM tf GROUP BY term""")
def text_index(t):
    idx = bm25.postings(t.facts).where(F.col("term") != "")
    return idx.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("occurrences"),
        F.max("doc_len").cast("bigint").alias("longest"),
    )


@query("A10_bm25", with_views("facts", "query_batch") + ",\n" + SQL_LEX + "\nSELECT query_id, fact_id, score, rank FROM lex")
def bm25_search(t):
    hits = bm25.search_documents(t.facts, t.query_batch, by=("tenant_id",))
    return hits.select("query_id", "fact_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _stored(t, facts=None) -> stored_text.TextIndex:
    return stored_text.build(t.facts if facts is None else facts, new_folder(t.spark, "text-index"), by=("tenant_id",), buckets=16)


@query("S10_stored_index", with_views("facts") + """,
toks AS (SELECT tenant_id, fact_id, regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+') AS t FROM facts),
placed AS (SELECT *, (row_number() OVER (PARTITION BY tenant_id ORDER BY len(t), fact_id) - 1) // 64 AS range FROM toks),
tf AS (SELECT tenant_id, fact_id, range, len(t) AS doc_len, unnest(t) AS term FROM placed)
SELECT term, count(DISTINCT fact_id) AS df, count(*) AS occurrences, count(DISTINCT tenant_id || ':' || range) AS blocks, max(doc_len) AS longest FROM tf GROUP BY term""")
def stored_index(t):
    """Words of the stored index, read from its blocks."""
    postings = _stored(t).blocks.select("term", F.posexplode("postings").alias("place", "p"))
    return postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("p.tf").cast("bigint").alias("occurrences"), F.count_if(F.col("place") == 0).alias("blocks"), F.max("p.doc_len").cast("bigint").alias("longest")
    )


@query("A10_block_max", with_views("facts", "query_batch") + ",\n" + SQL_LEX + "\nSELECT query_id, fact_id, score, rank FROM lex")
def block_max(t):
    """The search over the stored index skips blocks and finds the same."""
    hits = stored_text.search(_stored(t), t.query_batch).hits
    return hits.select("query_id", "fact_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("S12_query_tokens", with_views("query_batch") + r"""
SELECT query_id, term, count(*) AS n FROM (
  SELECT query_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM query_batch)
GROUP BY ALL""")
def query_tokens(t):
    return bm25.query_terms(t.query_batch).select("query_id", "term", F.col("weight").cast("bigint").alias("n"))


def _same_source(t):
    """Facts of the query's tenant that come from the same source as the query's item."""
    edges = t.facts.select("tenant_id", F.col("source_uri").alias("src"), F.col("fact_id").alias("dst"))
    seeds = t.query_batch.join(
        t.facts.select(F.col("doc_id").alias("item_id"), F.col("source_uri").alias("src")), "item_id"
    ).select("tenant_id", "query_id", "src")
    return fusion.neighbour_hits(seeds, edges, by=("tenant_id",))


def _three_lists(t):
    return rc.retrieve(t.facts, t.query_batch, t.fact_vectors, dim=DIM, graph_hits=_same_source(t))


@query("A01_rank_fusion", _ALL + """,
fused AS (
  SELECT query_id, fact_id,
    coalesce(sum(CASE WHEN source = 'semantic' THEN 1.0::DOUBLE / (60 + rank) END), 0.0)
    + coalesce(sum(CASE WHEN source = 'lexical' THEN 1.0::DOUBLE / (60 + rank) END), 0.0)
    + coalesce(sum(CASE WHEN source = 'graph' THEN 1.0::DOUBLE / (60 + rank) END), 0.0) AS rrf,
    min(CASE source WHEN 'semantic' THEN 0 WHEN 'lexical' THEN 1 ELSE 2 END) AS prio
  FROM hits GROUP BY ALL)
SELECT query_id, fact_id, round(rrf, 12) AS rrf, (['semantic', 'lexical', 'graph'])[prio + 1] AS source,
  row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, prio, fact_id) AS rank FROM fused""")
def rank_fusion(t):
    return fusion.rrf(_three_lists(t)).select(
        "query_id", "fact_id", F.round("rrf", 12).alias("rrf"), "source", F.col("rank").cast("bigint").alias("rank")
    )


@query("P05_keep_and_renumber", _ALL + f""",
alive AS (SELECT fact_id FROM facts WHERE {_VALID})
SELECT query_id, h.fact_id, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS rank
FROM hits h SEMI JOIN alive a ON h.fact_id = a.fact_id""")
def keep_and_renumber(t):
    hits = _three_lists(t)
    alive = fusion.candidates(hits).join(temporal.valid_at(t.facts, clock(T_NOW)).select("fact_id"), "fact_id", "left_semi")
    return fusion.keep_only(hits, alive).select("query_id", "fact_id", "source", F.col("rank").cast("bigint").alias("rank"))


@query("U01_candidate_union", _ALL + " SELECT DISTINCT query_id, fact_id FROM hits")
def candidate_union(t):
    return fusion.candidates(_three_lists(t))


@query("Q1_recall", sql_recall(_TWO, 10) + """
SELECT query_id, fact_id, kind, score, connectedness_value, rank FROM cut WHERE coalesce(episode_id, '') <> ''""")
def recall_query(t):
    """Hybrid recall of the whole query batch, ten answers each."""
    got = rc.recall(t.facts, t.query_batch, clock(T_NOW), t.fact_vectors, dim=DIM, k=10)
    return got.facts.select(
        "query_id", "fact_id", "kind", "score", F.round("connectedness_value", 9).alias("connectedness_value"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query("Q1_recall_indexed", sql_recall(_TWO, 10) + """
SELECT query_id, fact_id, kind, score, connectedness_value, rank FROM cut WHERE coalesce(episode_id, '') <> ''""")
def recall_indexed(t):
    """Recall over a stored text index; no text is read while a query is answered."""
    got = rc.recall(t.facts.drop("content"), t.query_batch, clock(T_NOW), t.fact_vectors, dim=DIM, k=10, index=_stored(t))
    return got.facts.select(
        "query_id", "fact_id", "kind", "score", F.round("connectedness_value", 9).alias("connectedness_value"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query("Q6_replay", sql_recall(_TWO, 5) + """,
truth AS (
  SELECT q.query_id, v.fact_id FROM query_batch q JOIN fact_vectors o ON o.vec_id = q.item_id JOIN fact_vectors v ON v.tenant_id = q.tenant_id AND v.label = o.label),
hit AS (SELECT DISTINCT query_id FROM cut SEMI JOIN truth ON cut.query_id = truth.query_id AND cut.fact_id = truth.fact_id WHERE coalesce(episode_id, '') <> '')
SELECT count(*) AS n_queries, count(h.query_id) AS n_hits, round(count(h.query_id) / count(*), 9) AS recall_at_k, count(h.query_id) / count(*) >= 0.6 AS passed
FROM (SELECT DISTINCT query_id FROM truth) q LEFT JOIN hit h USING (query_id)""")
def replay(t):
    """Relevant for a query are the facts of its tenant in the vector class of its item."""
    own = t.fact_vectors.select(F.col("vec_id").alias("item_id"), "label")
    members = t.fact_vectors.groupBy("tenant_id", "label").agg(F.collect_set("fact_id").alias("relevant_fact_ids"))
    asked = t.query_batch.join(own, "item_id").join(members, ["tenant_id", "label"])
    got = evaluate.replay(t.facts, t.fact_vectors, t.query_batch.join(asked.select("query_id", "relevant_fact_ids"), "query_id", "left"), clock(T_NOW), DIM)
    return got.withColumn("recall_at_k", F.round("recall_at_k", 9))


@query("Q1_recall_three_lists", sql_recall(_ALL, 10) + """
SELECT query_id, fact_id, kind, score, rank FROM cut WHERE coalesce(episode_id, '') <> ''""")
def recall_three(t):
    got = rc.recall(t.facts, t.query_batch, clock(T_NOW), t.fact_vectors, dim=DIM, k=10, graph_hits=_same_source(t))
    return got.facts.select("query_id", "fact_id", "kind", "score", F.col("rank").cast("bigint").alias("rank"))


@query("Q1_recall_pre_filter", with_views("facts", "fact_vectors", "query_batch").replace("facts AS (", "facts0 AS (", 1).replace("fact_vectors AS (", "vectors0 AS (", 1)
       + f",\nfacts AS (SELECT * FROM facts0 WHERE {_VALID}),\nfact_vectors AS (SELECT v.* FROM vectors0 v SEMI JOIN facts USING (tenant_id, fact_id)),\n" + SQL_SEM + ",\n" + SQL_LEX + """,
hits AS (
  SELECT query_id, fact_id, score, source, rank FROM sem UNION ALL SELECT query_id, fact_id, score, source, rank FROM lex)"""
       + sql_recall("", 10) + """
SELECT query_id, fact_id, score, rank FROM cut WHERE coalesce(episode_id, '') <> ''""")
def recall_pre_filter(t):
    """Only valid facts compete, in the text list and in the vector list."""
    got = rc.recall(
        t.facts, t.query_batch, clock(T_NOW), t.fact_vectors, dim=DIM, k=10, filter_stage="pre_retrieval"
    )
    return got.facts.select("query_id", "fact_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("Q1_recall_envelope", with_views("query_batch", "pages_v") + """,
asking AS (SELECT tenant_id, count(*) AS queries FROM query_batch GROUP BY 1),
run AS (SELECT *, sum(bytes) OVER (PARTITION BY tenant_id ORDER BY revised_at DESC, page_uri DESC) AS s FROM pages_v),
kept AS (SELECT tenant_id, count(*) AS n_pages, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM run WHERE s <= 10240 GROUP BY 1)
SELECT tenant_id, queries, coalesce(n_pages, 0) AS n_pages, coalesce(total_bytes, 0) AS total_bytes, 0::BIGINT AS facts FROM asking LEFT JOIN kept USING (tenant_id)""")
def recall_envelope(t):
    """With k = 0 an answer is the preference pages of the tenant and nothing else."""
    got = rc.recall(t.facts, t.query_batch, clock(T_NOW), t.fact_vectors, dim=DIM, k=0, pages=t.pages)
    asking = t.query_batch.groupBy("tenant_id").agg(F.count("*").alias("queries"))
    kept = got.preferences.groupBy("tenant_id").agg(F.count("*").alias("n_pages"), F.sum("bytes").alias("total_bytes"))
    facts = got.facts.groupBy("tenant_id").agg(F.count("*").alias("facts"))
    return asking.join(kept, "tenant_id", "left").join(facts, "tenant_id", "left").fillna(0, ["n_pages", "total_bytes", "facts"])


@query("Q1_recall_filters", sql_recall(_TWO, 10) + """
SELECT q.query_id, coalesce(s.n, 0) - coalesce(a.n, 0) AS pre_filter_excluded, coalesce(d.n, 0) AS provenance_dropped,
  false AS k_zero_short_circuit
FROM query_batch q LEFT JOIN (SELECT query_id, count(*) AS n FROM wanted GROUP BY 1) s USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM alive GROUP BY 1) a USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM cut WHERE coalesce(episode_id, '') = '' GROUP BY 1) d USING (query_id)""")
def recall_filters(t):
    return rc.recall(t.facts, t.query_batch, clock(T_NOW), t.fact_vectors, dim=DIM, k=10).filters
