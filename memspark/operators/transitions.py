"""State transitions of facts: promote, demote, invalidate, reconcile, forget, revalidate.

Nothing is updated in place.  A transition returns the rows to append (flags, log, events) and
the facts with their new end of validity; the caller commits them together.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions.common import blank, fail_when
from memspark.functions.ids import iso_us, random_uuid7
from memspark.operators import temporal

KEY = ["tenant_id", "fact_id"]


@dataclass(frozen=True)
class Transition:
    flags: DataFrame
    log: DataFrame
    events: DataFrame
    facts: DataFrame


def _checked(decisions: DataFrame, verb: str, legal: tuple[str, ...], with_score: bool, with_successor: bool) -> DataFrame:
    """Decisions fit for ``verb``; the first bad row fails the job before anything is written."""
    name = F.col("fact_id")
    bad = ~F.coalesce(F.col("decision").isin(*legal), F.lit(False))
    rows = decisions.withColumn(
        "decision", fail_when(bad, F.concat(F.lit(f"{verb}: illegal decision for "), name), F.col("decision"))
    )
    if with_score:
        rows = rows.withColumn(
            "score_output",
            fail_when(F.col("score_output").isNull(), F.concat(F.lit(f"{verb}: no score for "), name), F.col("score_output")),
        )
    if with_successor:
        if "superseded_by" not in decisions.columns:
            raise ValueError(f"{verb}: the column superseded_by is required, its values may be null")
        s = F.col("superseded_by")
        rows = rows.withColumn(
            "superseded_by", fail_when(s == "", F.concat(F.lit(f"{verb}: empty successor for "), name), s)
        )
    return rows


def _records(rows: DataFrame, verb: str, tier: str, run_id: str, now: Column, valid_at: Column, extra: list[str]):
    flags = rows.select(
        *KEY, F.lit(tier).alias("tier"), iso_us(now).alias("flag_set_at"), F.lit(run_id).alias("flag_set_by"),
        F.col("decision").alias("reason"),
    )
    events = rows.select(
        random_uuid7(now).alias("event_id"), F.lit(verb).alias("event_type"), "tenant_id",
        iso_us(now).alias("ts_recorded"), valid_at.alias("ts_valid"),
        F.lit(v.TRANSITION_VERSIONS[0]).alias("model_version"), F.lit(v.TRANSITION_VERSIONS[1]).alias("weights_version"),
        F.lit(True).alias("contamination_protected"), F.array("fact_id").alias("fact_ids"), "decision",
        *extra, F.lit(run_id).alias("consolidate_run_id"),
    )
    log = rows.select(
        "tenant_id", F.lit(verb).alias("kind"),
        F.to_json(
            F.struct(*sorted(["decision", "fact_id", "tenant_id", *extra]), F.lit(run_id).alias("run_id")),
            {"ignoreNullFields": "false"},
        ).alias("payload_json"),
        iso_us(now).alias("appended_at"),
    )
    return flags, log, events


def promote(facts: DataFrame, decisions: DataFrame, run_id: str, now: Column) -> Transition:
    """``decisions(tenant_id, fact_id, score_output, decision)``; facts keep their validity."""
    if not run_id:
        raise ValueError("run_id must not be empty")
    rows = _checked(decisions, "promote", v.PROMOTE_DECISIONS, True, False)
    return Transition(*_records(rows, "promote", "promoted", run_id, now, iso_us(now), ["score_output"]), facts)


def demote(facts: DataFrame, decisions: DataFrame, run_id: str, now: Column, valid_to: Column) -> Transition:
    if not run_id:
        raise ValueError("run_id must not be empty")
    rows = _checked(decisions, "demote", v.DEMOTE_DECISIONS, True, False)
    closed = temporal.close_intervals(facts, rows.select(*KEY, valid_to.alias("valid_to")))
    return Transition(*_records(rows, "demote", "demoted", run_id, now, iso_us(valid_to), ["score_output"]), closed)


def invalidate(facts: DataFrame, decisions: DataFrame, run_id: str, now: Column, valid_to: Column) -> Transition:
    """``decisions(tenant_id, fact_id, decision, superseded_by)``; the successor may be null."""
    if not run_id:
        raise ValueError("run_id must not be empty")
    rows = _checked(decisions, "invalidate", v.INVALIDATE_REASONS, False, True)
    closed = temporal.close_intervals(facts, rows.select(*KEY, valid_to.alias("valid_to")))
    return Transition(*_records(rows, "invalidate", "invalidated", run_id, now, iso_us(valid_to), ["superseded_by"]), closed)


def orphans(facts: DataFrame, flags: DataFrame) -> DataFrame:
    """Closed facts that no covering flag explains."""
    covered = flags.where(F.col("tier").isin(*v.COVERING_TIERS)).select(*KEY)
    return temporal.closed(facts).select(*KEY).distinct().join(covered, KEY, "left_anti")


def reconcile(facts: DataFrame, flags: DataFrame, now: Column) -> Transition:
    """Back-fill a flag for every orphan; a second run finds none."""
    lost = orphans(facts, flags)
    new_flags = lost.select(
        *KEY, F.lit("backfilled").alias("tier"), iso_us(now).alias("flag_set_at"),
        F.lit("reconciler").alias("flag_set_by"), F.lit("s1_state_diff").alias("reason"),
    )
    log = lost.select(
        "tenant_id", F.lit("reconciler").alias("kind"),
        F.to_json(F.struct(
            "fact_id", F.lit("s1_state_diff").alias("reason"), "tenant_id", F.lit("backfilled").alias("tier")
        )).alias("payload_json"),
        iso_us(now).alias("appended_at"),
    )
    return Transition(new_flags, log, log.where(F.lit(False)), facts)


def check_versions(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Compare-and-swap of forget and promote requests: adds ``outcome``.

    ``requests(tenant_id, fact_id, expected_version)``, ``facts(…, version)``.
    """
    known = facts.select(*KEY, F.col("version").alias("_v"))
    outcome = (
        F.when(F.col("_v").isNull(), "not_found").when(F.col("_v") != F.col("expected_version"), "version_conflict")
        .otherwise("intended_not_applied")
    )
    return requests.join(known, KEY, "left").withColumn("outcome", outcome).drop("_v")


def quarantine(facts: DataFrame, episodes: DataFrame, budget: int) -> DataFrame:
    """Facts derived from quarantined ``episodes(tenant_id, episode_id)`` with the size of each
    cascade; cascades above ``budget`` are returned as refused."""
    k = ["tenant_id", "episode_id"]
    hit = facts.join(episodes.select(*k).distinct(), k, "left_semi")
    size = hit.groupBy(*k).agg(F.count("*").alias("cascade_count"))
    return hit.select(*k, "fact_id").join(size, k).withColumn(
        "outcome", F.when(F.col("cascade_count") > budget, "precondition_failed").otherwise("intended_not_applied")
    )


def purge(facts: DataFrame, targets: DataFrame, requested_by: str, reason: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(retention proofs, surviving facts).  The proofs are written before the survivors."""
    gone = facts.join(targets.select(*KEY).distinct(), KEY, "left_semi")
    proofs = gone.select(
        *KEY, F.lit(requested_by).alias("requested_by"), F.lit(reason).alias("reason"), iso_us(now).alias("deleted_at"),
        F.sha2("content", 256).alias("content_hash"),
        F.sha2(F.concat_ws("|", *KEY, iso_us(now)), 256).alias("retention_proof_id"),
    )
    return proofs, facts.join(targets.select(*KEY).distinct(), KEY, "left_anti")


def revalidate(facts: DataFrame, thawed: DataFrame) -> DataFrame:
    """Clear the end of validity and the contradiction count of ``thawed(tenant_id, fact_id)``.

    The utility of such a fact needs no replay: it is always computed from the whole ledger, and
    an open fact freezes none of it.
    """
    mark = thawed.select(*KEY).distinct().withColumn("_thaw", F.lit(True))
    cols = []
    for c in facts.columns:
        if c == "valid_to":
            cols.append(F.when(F.col("_thaw").isNull(), F.col(c)).alias(c))
        elif c == "contradiction_count":
            cols.append(F.when(F.col("_thaw").isNull(), F.col(c)).otherwise(0).alias(c))
        else:
            cols.append(F.col(c))
    return facts.join(mark, KEY, "left").select(*cols)


def forget_mode(mode: Column) -> Column:
    """Canonical mode; the two aliases are accepted."""
    return F.when(mode == "soft", "invalidate").when(mode == "deny", "quarantine").when(
        mode.isin("invalidate", "quarantine", "purge"), mode
    ).otherwise(fail_when(F.lit(True), F.concat(F.lit("unknown mode: "), F.coalesce(mode, F.lit("NULL"))), mode))


def with_provenance(facts: DataFrame) -> DataFrame:
    return facts.where(~blank(F.col("episode_id")))
