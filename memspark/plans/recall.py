"""Hybrid recall for a batch of queries of many tenants.

A query is answered from the facts of its own tenant only; word statistics, vector neighbours and
rank lists never mix tenants, also where tenants use the same fact ids.  Building the plan runs two
small counts (query words, queries) that choose between a broadcast and a shuffle.

rank lists -> validity filter -> renumber -> fuse -> score -> top-k -> provenance filter.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions import ids
from memspark.functions.common import blank, clamp01
from memspark.functions.scoring import composed_score
from memspark.operators import bm25, fusion, knn, preferences, temporal, text_index
from memspark.session import checkpointed, has_at_most

TENANT = "tenant_id"
VERSIONS = ("p3-recall-v0", "p3-gap03-5a-v0")  # fixed values stamped on rows of this verb


@dataclass(frozen=True)
class Recalled:
    """``facts`` are the answers, ``filters`` one accounting row per query.  ``preferences`` are the pages every
    answer of a tenant carries, one row per asking tenant and page, also when no fact is asked for.
    ``hits`` are the stored ranked lists the answers were made from."""

    facts: DataFrame
    filters: DataFrame
    preferences: DataFrame | None = None
    hits: DataFrame | None = None

    def best(self, source: str, k: int) -> DataFrame:
        """The first ``k`` of one ranked list, at most as many as it was made with; the search is not run again."""
        return self.hits.where((F.col("source") == source) & (F.col("rank") <= k))


def retrieve(
    facts: DataFrame,
    queries: DataFrame,
    vectors: DataFrame | None = None,
    *,
    dim: int | None = None,
    graph_hits: DataFrame | None = None,
    fanout: int = v.FANOUT,
    index: text_index.TextIndex | None = None,
) -> DataFrame:
    """The stacked ranked lists.  ``facts(tenant_id, fact_id, content)``, ``vectors(tenant_id, fact_id, vec)``,
    ``queries(tenant_id, query_id, text[, vec])``; without vectors the search is lexical only.
    A stored ``index`` of the facts, by tenant, takes the place of their texts."""
    if index is not None:
        lists = [text_index.search(index, queries, fanout).hits]
    else:
        lists = [bm25.search_documents(facts, queries, fanout, by=(TENANT,))]
    if vectors is not None:
        with_vec = queries.where(F.col("vec").isNotNull())
        lists.insert(0, knn.nearest(vectors, with_vec, fanout, dim=dim, by=TENANT))
    if graph_hits is not None:
        lists.append(graph_hits.where(F.col("rank") <= fanout))
    return fusion.stack(*lists)


def recall(
    facts: DataFrame,
    queries: DataFrame,
    t_now: Column,
    vectors: DataFrame | None = None,
    *,
    dim: int | None = None,
    k: int = 10,
    graph_hits: DataFrame | None = None,
    connectedness: DataFrame | None = None,
    filter_stage: str = "post_retrieval",
    pages: DataFrame | None = None,
    index: text_index.TextIndex | None = None,
) -> Recalled:
    """``filter_stage="post_retrieval"`` lets expired facts use up list slots;
    ``"pre_retrieval"`` removes them from every list before ranking.  ``graph_hits`` are lists of facts of
    the query's tenant.  With ``connectedness(tenant_id, fact_id, connectedness)`` the graph term replaces the fused-rank proxy.  Fewer than k rows may come
    back: rows without an episode are dropped after the cut and not replaced.  With ``pages`` the preference
    pages of the asking tenants come along under their byte cap, for ``k = 0`` they are the whole answer.
    With a stored ``index`` of all facts no text is read; it counts expired facts too, so it cannot serve ``"pre_retrieval"``."""
    if index is not None and filter_stage == "pre_retrieval":
        raise ValueError("a stored index holds all facts; pre_retrieval needs one of the valid ones")
    if k < 0:
        raise ValueError("k must not be negative")
    if filter_stage not in ("post_retrieval", "pre_retrieval"):
        raise ValueError(filter_stage)
    pool = facts
    tenant_of = queries.select(TENANT, "query_id")
    if filter_stage == "pre_retrieval":
        pool = temporal.valid_at(facts, t_now)
        alive_ids = pool.select(TENANT, "fact_id")
        if vectors is not None:
            vectors = vectors.join(alive_ids, [TENANT, "fact_id"], "left_semi")
        if graph_hits is not None:
            graph_hits = fusion.renumber(
                graph_hits.join(tenant_of, "query_id").join(alive_ids, [TENANT, "fact_id"], "left_semi").drop(TENANT)
            )
    asked = queries if k > 0 else queries.where(F.lit(False))
    hits = checkpointed(retrieve(pool, asked, vectors, dim=dim, graph_hits=graph_hits, index=index))

    # one row per candidate with its rank in each list; at most three lists of FANOUT rows per
    # query, so for a batch of checked size the candidates are broadcast and the facts, the big
    # side, are read but never shuffled
    wanted = hits.groupBy("query_id", "fact_id").agg(
        *[F.min(F.when(F.col("source") == s, F.col("rank"))).alias(f"_{s}") for s in v.SOURCE_PRIORITY]
    )
    small = has_at_most(queries.select("query_id"), knn.QUERY_BLOCK)
    placed = wanted.join(F.broadcast(tenant_of) if small else tenant_of, "query_id")
    alive = temporal.valid_at(facts.join(F.broadcast(placed) if small else placed, [TENANT, "fact_id"]), t_now)
    cut = fusion.top_k(_score(_fuse(alive), t_now, connectedness), k)

    filters = (
        queries.select("query_id")
        .join(wanted.groupBy("query_id").agg(F.count("*").alias("_seen")), "query_id", "left")
        .join(alive.groupBy("query_id").agg(F.count("*").alias("_kept")), "query_id", "left")
        .join(
            cut.where(blank(F.col("episode_id"))).groupBy("query_id").agg(F.count("*").alias("_noprov")),
            "query_id", "left",
        )
        .select(
            "query_id",
            (F.coalesce("_seen", F.lit(0)) - F.coalesce("_kept", F.lit(0))).alias("pre_filter_excluded"),
            F.coalesce("_noprov", F.lit(0)).alias("provenance_dropped"),
            F.lit(k == 0).alias("k_zero_short_circuit"),
        )
    )
    always = None
    if pages is not None:
        asking = tenant_of.select(TENANT).distinct()
        always = preferences.pack(preferences.preference_pages(pages).join(asking, TENANT, "left_semi"))
    return Recalled(cut.where(~blank(F.col("episode_id"))), filters, always, hits)


def _fuse(alive: DataFrame) -> DataFrame:
    """Close the gaps of every list and add up the reciprocal ranks, all in one shuffle by query."""
    total = None
    for s in v.SOURCE_PRIORITY:
        closed_up = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(f"_{s}").asc_nulls_last()))
        part = F.when(F.col(f"_{s}").isNotNull(), F.lit(1.0) / (F.lit(v.RRF_K) + closed_up)).otherwise(F.lit(0.0))
        total = part if total is None else total + part
    return alive.withColumn("rrf", total).drop(*[f"_{s}" for s in v.SOURCE_PRIORITY])


def _score(rows: DataFrame, t_now: Column, connectedness: DataFrame | None) -> DataFrame:
    if connectedness is None:
        top = F.max("rrf").over(Window.partitionBy("query_id"))
        rows = rows.withColumn("connectedness_value", clamp01(F.when(top > 0, F.col("rrf") / top).otherwise(F.lit(0.0))))
    else:
        rows = rows.join(
            connectedness.select(TENANT, "fact_id", F.col("connectedness").alias("connectedness_value")), [TENANT, "fact_id"], "left"
        ).fillna(0.0, ["connectedness_value"])
    zero = F.lit(0.0)
    score = composed_score(
        F.col("kind"), t_now, F.col("valid_from"), F.col("connectedness_value"), zero, F.lit(0), zero, F.lit(False)
    )
    return rows.withColumn("score", F.round(score, v.RANK_DIGITS))


def recall_ids(queries: DataFrame, ts: Column, k: int, scope_json: str = "{}") -> DataFrame:
    """Adds query_hash and the deterministic recall_id to ``queries(query_id, tenant_id, text, intent)``."""
    payload = ids.query_json(F.col("text"), F.col("intent"), F.lit(k), F.lit(scope_json))
    return queries.withColumn("query_hash", ids.query_hash(payload)).withColumn(
        "recall_id", ids.recall_id(F.col("tenant_id"), ts, F.col("query_hash"))
    )


def ledger_rows(answers: Recalled, requests: DataFrame, ts: Column, weights_version: str = VERSIONS[1]) -> DataFrame:
    """One ledger row per request, also for requests that found nothing."""
    per_query = answers.facts.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "fact_id"))), lambda r: r["fact_id"]
        ).alias("top_k_fact_ids"),
        F.to_json(F.array_sort(F.collect_list(F.struct("rank", "fact_id", "version", "kind", "score")))).alias("_facts"),
    )
    intent = F.when(blank(F.col("intent")), F.lit("unspecified")).otherwise(F.col("intent"))
    return (
        requests.join(per_query, "query_id", "left").join(answers.filters, "query_id", "left")
        .select(
            "recall_id", "tenant_id", "query_hash", ids.iso_ms(ts).alias("ts_recorded"),
            intent.alias("classified_intent"), F.lit(weights_version).alias("weights_version"),
            F.coalesce("top_k_fact_ids", F.array().cast("array<string>")).alias("top_k_fact_ids"),
            F.to_json(F.struct(
                "recall_id", F.coalesce("_facts", F.lit("[]")).alias("facts"),
                "pre_filter_excluded", "provenance_dropped", "k_zero_short_circuit",
            )).alias("response_envelope_blob"),
        )
    )


def recall_events(answers: Recalled, requests: DataFrame, ts: Column, path: str = "recall") -> DataFrame:
    """One event per returned fact; a request without facts emits none."""
    stamp = ids.iso_ms(ts)
    return answers.facts.select("query_id", "fact_id").join(
        requests.select("query_id", "tenant_id", "recall_id"), "query_id"
    ).select(
        ids.random_uuid7(ts).alias("event_id"), F.lit("recall").alias("event_type"), "tenant_id",
        stamp.alias("ts_recorded"), stamp.alias("ts_valid"),
        F.lit(VERSIONS[0]).alias("model_version"), F.lit(VERSIONS[1]).alias("weights_version"),
        F.lit(True).alias("contamination_protected"), "recall_id",
        F.array("fact_id").alias("fact_ids"), F.lit(path).alias("path"),
    )
