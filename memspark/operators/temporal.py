"""Bi-temporal validity: half-open intervals ``[valid_from, valid_to)``."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions.common import fail_when
from memspark.session import union_all


def is_valid(t: Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    start = fail_when(F.col(valid_from).isNull(), "fact without valid_from", F.col(valid_from))
    return (start <= t) & (F.col(valid_to).isNull() | (F.col(valid_to) > t))


def valid_at(facts: DataFrame, t: Column) -> DataFrame:
    """Facts whose validity contains ``t``; with a past ``t`` this is time travel.

    The plain comparison comes first so that it reaches the scan; the NULL check only
    sees rows the scan could not decide.
    """
    vf, vt = F.col("valid_from"), F.col("valid_to")
    return facts.where((vf.isNull() | (vf <= t)) & (vt.isNull() | (vt > t))).where(is_valid(t))


def purge_eligible(t: Column, grace_days: int = v.PURGE_GRACE_DAYS, valid_to: str = "valid_to") -> Column:
    return F.coalesce(F.col(valid_to) + F.make_dt_interval(F.lit(grace_days)) <= t, F.lit(False))


def closed(facts: DataFrame) -> DataFrame:
    """Facts with an end of validity, the ones a transition must have flagged."""
    return facts.where(F.col("valid_to").isNotNull())


def close_intervals(facts: DataFrame, ends: DataFrame, keys: tuple[str, ...] = ("tenant_id", "fact_id")) -> DataFrame:
    """Overwrite ``valid_to`` from ``ends(keys…, valid_to)``; ids without a fact fail the job.

    Facts meet the ends in a left join, so a short list of ends is broadcast and the facts are not
    shuffled; unknown ids are found from the keys alone.
    """
    keys = list(keys)
    stamped = ends.groupBy(*keys).agg(F.max("valid_to").alias("_end"))
    cols = [F.coalesce("_end", "valid_to").alias("valid_to") if c == "valid_to" else F.col(c) for c in facts.columns]
    closed_ = facts.join(stamped, keys, "left").select(*cols)
    unknown = stamped.join(facts.select(*keys), keys, "left_anti")
    message = F.concat(F.lit("no such fact: "), F.col(keys[-1]).cast("string"))
    lost = unknown.select(*[
        (F.when(F.lit(True), F.raise_error(message)) if f.name == keys[-1] else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in closed_.schema.fields
    ])
    return union_all(closed_, lost)


def sane_interval(valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    return F.col(valid_to).isNull() | (F.col(valid_to) >= F.col(valid_from))
