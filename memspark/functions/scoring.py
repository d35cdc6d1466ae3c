"""The per-fact score and its terms."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions.common import clamp01, days_between, fail_when, lookup


def shape_of(kind: Column, strict: bool = True) -> Column:
    """Scoring shape of a kind; ``strict`` fails on kinds that are never stored."""
    shape = lookup(kind, v.SHAPE_OF_KIND)
    if not strict:
        return shape
    reason = F.when(kind.isin(*v.NON_PERSISTENT), F.lit("non-persistent kind: ")).otherwise(F.lit("unknown kind: "))
    return fail_when(shape.isNull(), F.concat(reason, F.coalesce(kind, F.lit("NULL"))), shape)


def type_priority(kind: Column) -> Column:
    return F.coalesce(lookup(kind, v.TYPE_PRIORITY), F.lit(v.DEFAULT_TYPE_PRIORITY))


def kind_param(kind: Column, position: int) -> Column:
    """Shape parameter looked up by the kind itself, which keeps the expression small."""
    return lookup(kind, {k: v.SHAPE_PARAMS[s][position] for k, s in v.SHAPE_OF_KIND.items()})


def recency(t_now: Column, t_access: Column, tau_days: Column | float = 30.0, r_inf: float = v.R_INF) -> Column:
    tau = F.lit(tau_days) if isinstance(tau_days, float) else tau_days
    age = F.greatest(F.lit(0.0), days_between(t_now, t_access))
    return F.lit(r_inf) + F.lit(1.0 - r_inf) * F.exp(-age / tau)


def contradicted(count: Column) -> Column:
    return (count > 0).cast("double")


def eps_effective(eps: Column | float, count: Column) -> Column:
    base = F.lit(eps) if isinstance(eps, float) else eps
    return base * (F.lit(1.0) + F.log1p(count.cast("double")))


def gravity(cost: Column, p99: Column) -> Column:
    ratio = F.when(p99 <= 0.0, F.lit(0.0)).otherwise(clamp01(cost / p99))
    return fail_when(cost < 0.0, "negative cascade cost", ratio)


def gravity_mult(
    sub_score: Column,
    gravity_value: Column,
    invalidated: Column,
    theta_demote: float = v.THETA_DEMOTE,
    g_floor: float = v.G_FLOOR,
) -> Column:
    """Multiplier of the additive score.  A negative score becomes more negative."""
    return (
        F.when(invalidated, F.lit(0.0))
        .when(sub_score >= theta_demote, F.lit(1.0))
        .otherwise(F.greatest(F.lit(1.0), F.lit(1.0) + F.lit(g_floor) * gravity_value))
    )


def additive_score(
    kind: Column,
    t_now: Column,
    t_access: Column,
    connectedness: Column,
    utility: Column,
    contradictions: Column,
    *,
    alpha: float = v.ALPHA,
    gamma: float = v.GAMMA,
    delta: float = v.DELTA,
    eps: float = v.EPS,
    strict: bool = True,
) -> Column:
    """Score before gravity.  The recency weight always comes from the shape, never from the caller."""
    fresh_kinds = [k for k, s in v.SHAPE_OF_KIND.items() if v.SHAPE_PARAMS[s][1] > 0.0]
    fresh = F.when(
        kind.isin(*fresh_kinds), kind_param(kind, 1) * recency(t_now, t_access, kind_param(kind, 0))
    ).otherwise(F.lit(0.0))
    eps_used = F.least(F.lit(eps), kind_param(kind, 2))
    total = (
        F.lit(alpha) * type_priority(kind)
        + fresh
        + F.lit(gamma) * connectedness
        + F.lit(delta) * utility
        - eps_effective(eps_used, contradictions) * contradicted(contradictions)
    )
    if not strict:
        return F.when(kind.isin(*v.SHAPE_OF_KIND), total)
    out_of_range = ~connectedness.between(0.0, 1.0) | ~utility.between(0.0, 1.0) | (contradictions < 0)
    reason = F.concat(F.lit("kind never scored or term out of range: "), F.coalesce(kind, F.lit("NULL")))
    return fail_when(~F.coalesce(kind.isin(*v.SHAPE_OF_KIND), F.lit(False)) | out_of_range, reason, total)


def composed_score(
    kind: Column,
    t_now: Column,
    t_access: Column,
    connectedness: Column,
    utility: Column,
    contradictions: Column,
    gravity_value: Column,
    invalidated: Column,
    *,
    theta_demote: float = v.THETA_DEMOTE,
    **weights,
) -> Column:
    sub = additive_score(kind, t_now, t_access, connectedness, utility, contradictions, **weights)
    return gravity_mult(sub, gravity_value, invalidated, theta_demote) * sub


def intent_match(intent: Column, kind: Column) -> Column:
    """Agreement of a query intent with a stored kind; 0 outside the table."""
    cells = {f"{i}|{k}": m for i, row in v.INTENT_MATCH.items() for k, m in row.items()}
    return F.coalesce(lookup(F.concat_ws("|", intent, kind), cells), F.lit(0.0))


def utility_ramp(n_ledger: Column) -> Column:
    """Weight of the utility prior: silent below 1 000 ledger rows, full from 10 000."""
    ramp = F.lit(v.W_UTILITY_MAX) * F.least(
        F.lit(1.0), (n_ledger - F.lit(v.W_UTILITY_FROM)) / F.lit(float(v.W_UTILITY_SPAN))
    )
    return F.when(n_ledger < v.W_UTILITY_FROM, F.lit(0.0)).otherwise(ramp)


def rerank_score(rrf: Column, match: Column, confidence: Column, w_utility: Column, utility: Column) -> Column:
    return rrf * (F.lit(1.0) + F.lit(v.W_INTENT) * match * confidence) + w_utility * utility


def decision(score: Column, theta_promote: float = v.THETA_PROMOTE, theta_demote: float = v.THETA_DEMOTE) -> Column:
    """``promote`` at or above the upper threshold, ``demote`` below the lower one."""
    return (
        F.when(score >= theta_promote, F.lit("promote"))
        .when(score < theta_demote, F.lit("demote"))
        .otherwise(F.lit("keep"))
    )
