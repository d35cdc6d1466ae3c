"""Replay of an evaluation corpus through recall."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.operators.metrics import hit_rate
from memspark.plans.recall import recall

FLOOR = 0.60  # fixed value: least recall a replay must reach


def replay(
    facts: DataFrame, vectors: DataFrame, queries: DataFrame, t_now: Column, dim: int, k: int = 5, floor: float = FLOOR
) -> DataFrame:
    """One row: n_queries, n_hits, recall_at_k, passed.

    ``facts(tenant_id, fact_id, ...)``, ``vectors(tenant_id, fact_id, vec)`` and ``queries(tenant_id, query_id, text, vec,
    relevant_fact_ids)``: a query is replayed within its tenant.  It hits when any relevant fact is among the
    first ``k`` answers; a query without relevant facts is not counted.
    """
    got = recall(facts, queries, t_now, vectors, dim=dim, k=k)
    truth = queries.select("query_id", F.explode("relevant_fact_ids").alias("fact_id"))
    return hit_rate(got.facts, truth, k).withColumn("passed", F.col("recall_at_k") >= floor)
