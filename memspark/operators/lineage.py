"""Provenance over several steps: merges of merges, and facts derived from derived facts.

Semi-naive closure: a round follows the edges of the pairs found in the round before and keeps what is new, so
an edge is followed once for every start that reaches it, chains take as many rounds as they are long, and
cycles end because nothing new comes out of them.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.operators.safety import merged_sources
from memspark.session import checkpointed, union_all


def reach(starts: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(tenant_id, start, node, depth): every node reached from ``starts(tenant_id, start, node)`` over ``edges(tenant_id, src, dst)``.

    Starting nodes have depth 0; depth is the least number of steps.  Repeated and null edges do no harm; tenants never meet.
    Every round is a reliable checkpoint of what it added.
    """
    pair = ["tenant_id", "start", "node"]
    steps = checkpointed(edges.select("tenant_id", "src", "dst").where("src <> dst").distinct())
    found = [checkpointed(starts.select(*pair).dropna().distinct().withColumn("depth", F.lit(0)))]
    for depth in range(1, max_rounds + 1):
        ahead = found[-1].join(steps, [F.col("node") == F.col("src"), found[-1]["tenant_id"] == steps["tenant_id"]])
        ahead = ahead.select(found[-1]["tenant_id"], "start", F.col("dst").alias("node")).distinct()
        new = ahead
        for old in _settled(found):
            new = new.join(old.select(*pair), pair, "left_anti")
        new = checkpointed(new.withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return union_all(*found)
        found.append(new)
    raise RuntimeError("the closure did not end")


def _settled(found: list[DataFrame]) -> list[DataFrame]:
    """Earlier rounds as at most two tables: from time to time they are written as one."""
    if len(found) > 8:
        found[:] = [checkpointed(union_all(*found[:-1])), found[-1]]
    return [union_all(*found)]


def all_parts(merges: DataFrame) -> DataFrame:
    """(tenant_id, merged_id, fact_id, depth): the facts a merged fact was made of, through any number of merges.

    ``merges(tenant_id, fact_id, merged_id)``.  The merged fact itself is not among them, also where merges run in a circle.
    """
    starts = merges.select("tenant_id", F.col("merged_id").alias("start"), F.col("merged_id").alias("node"))
    edges = merges.select("tenant_id", F.col("merged_id").alias("src"), F.col("fact_id").alias("dst"))
    return reach(starts, edges).where("depth > 0").select("tenant_id", F.col("start").alias("merged_id"), F.col("node").alias("fact_id"), "depth")


def lineage(merges: DataFrame, provenance: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(tenant_id, merged_id, episode_id): all episodes behind a merged fact, its own and those of all its parts.

    ``provenance(tenant_id, fact_id, episode_id)``.  The sets stay in rows, as in ``safety.merged_sources``.
    ``parts`` are those of ``all_parts(merges)`` where they are there already.
    """
    parts = (all_parts(merges) if parts is None else parts).drop("depth")
    own = merges.select("tenant_id", "merged_id", F.col("merged_id").alias("fact_id")).distinct()
    scoped = lambda df, *c: df.select(F.struct("tenant_id", "fact_id").alias("fact_id"), *c)
    found = merged_sources(
        scoped(union_all(parts, own), F.struct("tenant_id", "merged_id").alias("merged_id")), scoped(provenance, "episode_id")
    )
    return found.select("merged_id.*", "episode_id")


def cascade(facts: DataFrame, derived: DataFrame, episodes: DataFrame, budget: int) -> DataFrame:
    """Facts that fall with quarantined ``episodes(tenant_id, episode_id)``: those taken from them and all derived from these.

    ``facts(tenant_id, fact_id, episode_id)``, ``derived(tenant_id, src, dst)``: the fact ``dst`` was derived from ``src``.
    (tenant_id, episode_id, fact_id, depth, cascade_count, outcome); cascades above ``budget`` are refused as a whole.
    """
    k = ["tenant_id", "episode_id"]
    first = facts.join(episodes.select(*k).distinct(), k, "left_semi")
    hit = reach(first.select("tenant_id", F.col("episode_id").alias("start"), F.col("fact_id").alias("node")), derived)
    hit = hit.select("tenant_id", F.col("start").alias("episode_id"), F.col("node").alias("fact_id"), "depth")
    size = checkpointed(hit.groupBy(*k).agg(F.count("*").alias("cascade_count")))
    return hit.join(size, k).withColumn("outcome", F.when(F.col("cascade_count") > budget, "precondition_failed").otherwise("intended_not_applied"))
