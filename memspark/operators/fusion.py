"""Ranked lists: filtering, renumbering, reciprocal-rank fusion, top-k.

A ranked list is (query_id, fact_id, score, source, rank) with at most ``FANOUT`` rows per
query and source, so the windows below never see a large group.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions.common import lookup
from memspark.session import union_all

_COLS = ("query_id", "fact_id", "score", "source", "rank")


def stack(*lists: DataFrame) -> DataFrame:
    return union_all(*[part.select(*_COLS) for part in lists])


def candidates(hits: DataFrame) -> DataFrame:
    """Distinct (query_id, fact_id) over all lists."""
    return hits.select("query_id", "fact_id").distinct()


def renumber(hits: DataFrame) -> DataFrame:
    """Close the gaps a filter left in each list; order is kept."""
    w = Window.partitionBy("query_id", "source").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(w))


def keep_only(hits: DataFrame, kept: DataFrame) -> DataFrame:
    """Hits whose (query_id, fact_id) is in ``kept``, renumbered."""
    return renumber(hits.join(kept, ["query_id", "fact_id"], "left_semi"))


def rrf(hits: DataFrame, k_constant: int = v.RRF_K, top_k: int | None = None) -> DataFrame:
    """(query_id, fact_id, rrf, source, rank); the per-source terms are added in a fixed order."""
    if k_constant <= 0 or (top_k is not None and top_k <= 0):
        raise ValueError("k_constant and top_k must be positive")
    term = F.lit(1.0) / (F.lit(k_constant) + F.col("rank"))

    def part(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, term)), F.lit(0.0))

    known = [part(F.col("source") == s) for s in v.SOURCE_PRIORITY]
    other = part(~F.col("source").isin(*v.SOURCE_PRIORITY))
    total = known[0]
    for nxt in [*known[1:], other]:
        total = total + nxt
    prio = F.coalesce(lookup(F.col("source"), v.SOURCE_PRIORITY), F.lit(len(v.SOURCE_PRIORITY)))
    fused = hits.groupBy("query_id", "fact_id").agg(
        total.alias("rrf"), F.min(prio).alias("_prio"), F.min_by("source", prio).alias("source")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "_prio", "fact_id")
    out = fused.withColumn("rank", F.row_number().over(w))
    if top_k is not None:
        out = out.where(F.col("rank") <= top_k)
    return out.select("query_id", "fact_id", "rrf", "source", "rank")


def top_k(scored: DataFrame, k: int | Column, score: str = "score") -> DataFrame:
    """Best k per query by score, then fact_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "fact_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbour_hits(seeds: DataFrame, edges: DataFrame, k: int = v.FANOUT, by: tuple[str, ...] = ()) -> DataFrame:
    """Third ranked list: the first k out-neighbours, by id, of each query's seed node.

    ``seeds(by…, query_id, src)``, ``edges(by…, src, dst)``.  Neighbour lists are cut to k before the
    join, which is exact because a query never reads further than its k-th neighbour.
    """
    w = Window.partitionBy(*by, "src").orderBy("dst")
    first = edges.select(*by, "src", "dst").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return seeds.join(first, [*by, "src"]).select(
        "query_id", F.col("dst").alias("fact_id"),
        (F.lit(1.0) / F.col("rank")).alias("score"), F.lit("graph").alias("source"), "rank",
    )
