"""Quarantine, merged provenance, page regeneration, minority guard, scrubbing, drift."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions.text import sensitive
from memspark.functions.vectors import cosine
from memspark.session import checkpointed, union_all


def split_by_confidence(extracted: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined); a missing confidence is quarantined."""
    ok = F.coalesce(F.col("confidence") >= threshold, F.lit(False))
    return extracted.where(ok), extracted.where(~ok)


def merged_sources(merges: DataFrame, provenance: DataFrame) -> DataFrame:
    """(merged_id, episode_id) rows: a merged fact keeps every episode of its parts.

    ``merges(fact_id, merged_id)``, ``provenance(fact_id, episode_id)``.  The set stays in rows,
    so a fact merged from very many parts never becomes one huge value.
    """
    return provenance.join(merges, "fact_id").select("merged_id", "episode_id").distinct()


def regeneration_plan(changed: DataFrame, page_index: DataFrame, budget: int = v.REGEN_PAGES_PER_CYCLE) -> DataFrame:
    """(tenant_id, page_uri, state): pages of changed facts, ``regen`` within the budget, else ``pending``."""
    touched = page_index.join(changed.select("tenant_id", "fact_id"), ["tenant_id", "fact_id"], "left_semi").select(
        "tenant_id", "page_uri"
    ).distinct()
    w = Window.partitionBy("tenant_id").orderBy("page_uri")
    now = touched.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= budget).select("tenant_id", "page_uri")
    later = touched.join(now, ["tenant_id", "page_uri"], "left_anti")
    return union_all(now.withColumn("state", F.lit("regen")), later.withColumn("state", F.lit("pending")))


def components(pairs: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of an undirected graph ``pairs(a, b)``; the component is its smallest node.

    Alternating large-star and small-star rounds: stars shrink to their smallest member in a
    logarithmic number of rounds and no neighbour list is ever collected.  Each round's edges
    are checkpointed, so the plan does not grow and a lost executor costs one round.
    """
    a, b = F.col("a"), F.col("b")
    edges = checkpointed(
        pairs.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    )
    previous = None
    for _ in range(max_rounds):
        edges = checkpointed(_small_star(_large_star(edges)))
        state = edges.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.sum(F.hash("a", "b").cast("long")).alias("s")
        ).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    leaves = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return union_all(roots.join(leaves.select("node"), "node", "left_anti"), leaves)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("w")), F.struct(F.col("b").alias("u"), F.col("a").alias("w"))
    )).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the smallest of u and its neighbours."""
    both = _both_ways(edges)
    low = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("w") > F.col("u")).join(low, "u").select(F.col("m").alias("a"), F.col("w").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("w"))
    low = down.groupBy("u").agg(F.min("w").alias("m"))
    linked = down.join(low, "u").select(F.col("m").alias("a"), F.col("w").alias("b")).where(F.col("a") != F.col("b"))
    return union_all(linked, low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def minority_guard(clusters: DataFrame, facts: DataFrame, now: Column, days: int = v.MINORITY_RETENTION_DAYS) -> DataFrame:
    """(fact_id, protect_minority) for the members of contradiction clusters.

    The only open member of a cluster, the last surviving counter-evidence, must not be demoted
    until ``days`` after it was recorded.  ``clusters(node, component)``, ``facts(fact_id, valid_to, recorded_at)``.
    """
    members = clusters.select(F.col("node").alias("fact_id"), "component").join(facts, "fact_id")
    alive = members.where(F.col("valid_to").isNull())
    last = alive.groupBy("component").agg(F.count("*").alias("_n"), F.min("fact_id").alias("_only")).where(F.col("_n") == 1)
    fresh = F.col("recorded_at") + F.make_dt_interval(F.lit(days)) > now
    return members.join(last.select(F.col("_only").alias("fact_id"), F.lit(True).alias("_p")), "fact_id", "left").select(
        "fact_id", (F.coalesce("_p", F.lit(False)) & fresh).alias("protect_minority")
    )


def cited(pairs: DataFrame, response_vec: str, fact_vec: str, cutoff: float = v.CITATION_COSINE) -> DataFrame:
    """Adds ``cosine`` and ``cited`` to pairs of a response and a fact it was shown."""
    return pairs.withColumn("cosine", cosine(F.col(response_vec), F.col(fact_vec))).withColumn(
        "cited", F.col("cosine") >= cutoff
    )


# fixed values: class -> (pattern, action)
SCRUB = {
    "long_number": (r"(?U)\d{9,}", "redact"),
    "credential": (v.SENSITIVE_KEYS, "redact"),
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "hash"),
}


def scrub(text: Column, drop_sensitive_words: bool = True) -> Column:
    """Text with classes of personal data replaced; NULL where the turn must be dropped."""
    out = text
    for name, (pattern, _) in SCRUB.items():
        out = F.regexp_replace(out, pattern, f"[{name}]")
    return F.when(text.rlike(v.SENSITIVE_WORDS), F.lit(None)).otherwise(out) if drop_sensitive_words else out


def scrub_action(text: Column) -> Column:
    """What the scrub does with a turn: keep, replace or drop."""
    hit = sensitive(text)
    for pattern, _ in SCRUB.values():
        hit = hit | text.rlike(pattern)
    return F.when(text.rlike(v.SENSITIVE_WORDS), "drop").when(hit, "replace").otherwise("keep")


def sampled(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """The fixed hash sample of the drift detector: a key is always in or always out."""
    bucket = F.pmod(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(100))
    return rows.where(bucket < percent)


def feature_drift(baseline: DataFrame, current: DataFrame, features: tuple[str, ...], limit: float = 0.10) -> DataFrame:
    """(feature, drift, alert): half the absolute difference of the value shares."""

    def shares(rows: DataFrame, name: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features]))
        counts = rows.select(pairs.alias("p")).select("p.*").groupBy("feature", "value").agg(F.count("*").alias("_c"))
        total = counts.groupBy("feature").agg(F.sum("_c").alias("_t"))
        return counts.join(total, "feature").select("feature", "value", (F.col("_c") / F.col("_t")).alias(name))

    both = shares(baseline, "_b").join(shares(current, "_c2"), ["feature", "value"], "full_outer").fillna(0.0, ["_b", "_c2"])
    drift = F.sum(F.abs(F.col("_b") - F.col("_c2"))) / 2
    return both.groupBy("feature").agg(drift.alias("drift"), (drift > limit).alias("alert"))
