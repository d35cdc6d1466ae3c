"""One consolidation cycle over all due tenants, as ordered DataFrame phases.

Each phase is one batch of tables that commits as a whole.  A failed phase stops the cycle; the
committed ones stay, and a second run with the same batch ids skips them.  There is one owner of
the cycle (the job), so the lock of a long-lived daemon reduces to two predicates.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions import scoring
from memspark.functions.ids import iso_us, random_uuid7
from memspark.operators import transitions
from memspark.operators.outcomes import due, lock_free
from memspark.session import union_all
from memspark.sources import batches

EXTRACTOR = "p4-c5-stub-v0"  # fixed value
Embed = Callable[[Column], Column]


@dataclass
class Cycle:
    """State handed from phase to phase."""

    spark: SparkSession
    root: str
    run_id: str
    first_batch: int
    now: Column
    facts: DataFrame
    flags: DataFrame
    terms: DataFrame  # (tenant_id, fact_id, connectedness, utility, contradiction_count, gravity)
    episodes: DataFrame
    embed: Embed
    scored: DataFrame | None = None
    results: list[tuple[str, str, str | None]] = field(default_factory=list)


def due_tenants(state: DataFrame, now: Column) -> DataFrame:
    """Tenants whose gate has elapsed and whose lock is free or abandoned."""
    ready = due(F.col("last_run_at"), now) & lock_free(F.col("lock_token"), F.col("lock_heartbeat_at"), now)
    return state.where(ready).select("tenant_id")


def score_all(facts: DataFrame, terms: DataFrame, t_now: Column) -> DataFrame:
    """(tenant_id, fact_id, score_output, verdict); facts without a term row get zero terms."""
    rows = facts.join(terms, ["tenant_id", "fact_id"], "left").fillna(
        0.0, ["connectedness", "utility", "gravity"]
    ).fillna(0, ["contradiction_count"])
    closed = F.coalesce(F.col("valid_to") <= t_now, F.lit(False))
    score = scoring.composed_score(
        F.col("kind"), t_now, F.col("valid_from"), F.col("connectedness"), F.col("utility"), F.col("contradiction_count"),
        F.col("gravity"), closed,
    )
    return rows.select("tenant_id", "fact_id", "valid_to", F.round(score, v.RANK_DIGITS).alias("score_output")).withColumn(
        "verdict", scoring.decision(F.col("score_output"))
    )


def extract(episodes: DataFrame, embed: Embed, now: Column) -> dict[str, DataFrame]:
    """Vector and log rows of new episodes."""
    return {
        "episode_vectors": episodes.select("tenant_id", "episode_id", embed(F.col("body")).alias("embedding")),
        "extraction_log": episodes.select(
            "tenant_id", "episode_id", now.alias("extracted_at"), F.lit(EXTRACTOR).alias("extractor_version"),
            F.lit(1.0).alias("confidence"),
        ),
    }


def _phase_tables(c: Cycle, name: str) -> dict[str, DataFrame]:
    open_facts = c.facts.where(F.col("valid_to").isNull())
    if name == "extract":
        return extract(c.episodes, c.embed, c.now)
    if name == "score":
        c.scored = score_all(c.facts, c.terms, c.now)
        return {"scores": c.scored.withColumn("run_id", F.lit(c.run_id))}
    picked = batches.read(c.spark, c.root, "scores").where(F.col("run_id") == c.run_id)
    keys = ["tenant_id", "fact_id"]
    if name == "promote":
        rows = picked.where((F.col("verdict") == "promote") & F.col("valid_to").isNull()).select(
            *keys, "score_output", F.lit(v.PROMOTE_DECISIONS[0]).alias("decision")
        )
        t = transitions.promote(c.facts, rows, c.run_id, c.now)
        return {"promotion_flags_new": t.flags, "log": t.log, "events": t.events.withColumn("fact_ids", F.to_json("fact_ids"))}
    if name == "demote":
        rows = picked.where((F.col("verdict") == "demote") & F.col("valid_to").isNull()).select(
            *keys, "score_output", F.lit(v.DEMOTE_DECISIONS[0]).alias("decision")
        )
        t = transitions.demote(open_facts.join(rows.select(*keys), keys, "left_semi"), rows, c.run_id, c.now, c.now)
        return {
            "promotion_flags_new": t.flags, "log": t.log, "events": t.events.withColumn("fact_ids", F.to_json("fact_ids")),
            "fact_ends": t.facts.select(*keys, "valid_to"),
        }
    if name == "invalidate":
        flags = c.flags.select(*keys, "tier")
        made = batches.read(c.spark, c.root, "promotion_flags_new").select(*keys, "tier")
        t = transitions.reconcile(c.facts, union_all(flags, made), c.now)
        return {"promotion_flags_new": t.flags, "log": t.log}
    return {}


def run(cycle: Cycle, phases: tuple[str, ...] = v.PHASES, tables_of=_phase_tables) -> list[tuple[str, str, str | None]]:
    """Run the phases in order: [(phase, succeeded | failed | skipped, error)]."""
    broken = False
    for i, name in enumerate(phases):
        if broken:
            cycle.results.append((name, "skipped", None))
            continue
        try:
            tables = tables_of(cycle, name)
            tables["phase_events"] = _phase_event(cycle, name)
            batches.append(cycle.spark, cycle.root, cycle.first_batch + i, tables)
            cycle.results.append((name, "succeeded", None))
        except Exception as err:
            broken = True
            cycle.results.append((name, "failed", f"{type(err).__name__}: {str(err).splitlines()[0]}"))
    return cycle.results


def _phase_event(c: Cycle, name: str) -> DataFrame:
    tenants = c.facts.select("tenant_id").distinct()
    return tenants.select(
        random_uuid7(c.now).alias("event_id"), F.lit("consolidate_phase").alias("event_type"), "tenant_id",
        iso_us(c.now).alias("ts_recorded"), iso_us(c.now).alias("ts_valid"),
        F.lit(v.TRANSITION_VERSIONS[0]).alias("model_version"), F.lit(v.TRANSITION_VERSIONS[1]).alias("weights_version"),
        F.lit(True).alias("contamination_protected"), F.lit(name).alias("phase_name"), F.lit(c.run_id).alias("consolidate_run_id"),
    )


def facts_after(cycle: Cycle) -> DataFrame:
    """The facts with every end of validity the committed phases set."""
    keys = ["tenant_id", "fact_id"]
    if not batches.exists(cycle.spark, f"{cycle.root}/fact_ends"):
        return cycle.facts
    ends = batches.read(cycle.spark, cycle.root, "fact_ends").groupBy(*keys).agg(F.max("valid_to").alias("_end"))
    cols = [F.coalesce("_end", "valid_to").alias(c) if c == "valid_to" else F.col(c) for c in cycle.facts.columns]
    return cycle.facts.join(ends, keys, "left").select(*cols)


def mark_success(state: DataFrame, tenants: DataFrame, now: Column) -> DataFrame:
    """State rows after a successful cycle: run time set, lock cleared."""
    t = tenants.select("tenant_id").withColumn("_ok", F.lit(True))
    changed = {"last_run_at": now, "updated_at": now}
    cleared = ("lock_token", "lock_acquired_at", "lock_heartbeat_at")
    cols = [
        F.when(F.col("_ok"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed
        else F.when(F.col("_ok").isNull(), F.col(c)).alias(c) if c in cleared else F.col(c)
        for c in state.columns
    ]
    return state.join(t, "tenant_id", "left").select(*cols)
