"""Utility ledger, contradictions, cascade cost."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions.common import days_between, fail_when, lookup
from memspark.functions.scoring import gravity
from memspark.operators.percentiles import percentile_disc


def event_weight(kind: Column) -> Column:
    w = lookup(kind, v.UTILITY_WEIGHTS)
    return fail_when(w.isNull(), F.concat(F.lit("unknown utility event: "), F.coalesce(kind, F.lit("NULL"))), w)


def in_window(t_now: Column, ts: Column, tau_days: float = v.UTILITY_TAU_DAYS) -> Column:
    """Both ends belong to the window.  Written on the bare column so that it reaches the scan."""
    return (ts <= t_now) & (ts >= t_now - F.make_dt_interval(F.lit(int(tau_days))))


def utility_raw(
    events: DataFrame, t_now: Column, keys: tuple[str, ...] = ("tenant_id", "fact_id"), tau_days: float = v.UTILITY_TAU_DAYS
) -> DataFrame:
    """(keys…, utility_raw): decayed weights of ``events(event_kind, ts)`` inside the window."""
    term = event_weight(F.col("event_kind")) * F.exp(-days_between(t_now, F.col("ts")) / F.lit(tau_days))
    return events.where(in_window(t_now, F.col("ts"), tau_days)).groupBy(*keys).agg(F.sum(term).alias("utility_raw"))


def live_events(events: DataFrame, facts: DataFrame) -> DataFrame:
    """Events that count: those recorded before their fact was closed, and not frozen.

    ``facts(tenant_id, fact_id, valid_to)``; events of unknown facts count.
    """
    ends = facts.select("tenant_id", "fact_id", F.col("valid_to").alias("_end"))
    rows = events if "frozen" not in events.columns else events.where(~F.col("frozen"))
    return (
        rows.join(ends, ["tenant_id", "fact_id"], "left")
        .where(F.col("_end").isNull() | (F.col("ts") < F.col("_end"))).drop("_end")
    )


def normalise(raw: Column, p95: Column) -> Column:
    return F.when(p95 <= 0.0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw) / p95))


def utility(events: DataFrame, t_now: Column, tau_days: float = v.UTILITY_TAU_DAYS, digits: int = v.RANK_DIGITS) -> DataFrame:
    """(tenant_id, fact_id, utility_raw, p95, utility), normalised by the tenant's 95th percentile.

    The percentile is the discrete form, the same as the one of the cascade costs.  Sums are
    rounded first, so that the percentile does not depend on the order of addition.
    """
    raw = utility_raw(events, t_now, tau_days=tau_days).withColumn("utility_raw", F.round("utility_raw", digits))
    p95 = percentile_disc(raw, "utility_raw", 0.95, ("tenant_id",), "p95").drop("n")
    return raw.join(p95, "tenant_id").withColumn("utility", normalise(F.col("utility_raw"), F.col("p95")))


def contradiction_count(edges: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Distinct active contradictors per fact from ``edges(fact_id, contradictor)``."""
    counts = edges.groupBy("fact_id").agg(F.countDistinct("contradictor").alias("contradiction_count"))
    if facts is None:
        return counts
    return facts.select("fact_id").join(counts, "fact_id", "left").fillna(0, ["contradiction_count"])


def undirected(edges: DataFrame, by: tuple[str, ...] = (), at: tuple[str, ...] = ()) -> DataFrame:
    """(by…, a, b, weight) once per pair, a < b; loops dropped, bad weights fail the job.

    ``at`` names columns in which all rows of a pair agree, such as its numeric keys.  Edges that are dealt by them
    (``session.dealt``) are grouped where they lie, without a shuffle.
    """
    w = fail_when(F.col("weight") < 0.0, "negative edge weight", F.col("weight"))
    pairs = edges.where(F.col("src") != F.col("dst")).groupBy(
        *by, *at, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).agg(F.min(w).alias("_lo"), F.max(w).alias("_hi"))
    agreed = fail_when(F.col("_lo") != F.col("_hi"), "edge weights of the two directions differ", F.col("_lo"))
    return pairs.select(*by, "a", "b", agreed.alias("weight"))


def cascade_cost(edges: DataFrame, digits: int = v.RANK_DIGITS, by: tuple[str, ...] = (), at: tuple[str, ...] = ()) -> DataFrame:
    """(by…, fact_id, cascade_cost): weight of all edges that break when the node goes; ``at`` as for ``undirected``."""
    ends = undirected(edges, by, at).select(*by, F.explode(F.array("a", "b")).alias("fact_id"), "weight")
    return ends.groupBy(*by, "fact_id").agg(F.round(F.sum("weight"), digits).alias("cascade_cost"))


def with_gravity(costs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds p99 (of the rows that agree in ``by``, such as a tenant; 0 when there are none) and the clipped ratio."""
    if by:
        p99 = percentile_disc(costs, "cascade_cost", 0.99, by, "p99").drop("n")
        rows = costs.join(p99, list(by), "left").fillna(0.0, ["p99"])
        return rows.withColumn("gravity", gravity(F.col("cascade_cost"), F.col("p99")))
    p99 = percentile_disc(costs, "cascade_cost", 0.99, name="p99")
    one = F.coalesce(p99.select("p99").scalar(), F.lit(0.0))
    return costs.withColumn("p99", one).withColumn("gravity", gravity(F.col("cascade_cost"), F.col("p99")))
