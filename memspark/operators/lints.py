"""Integrity findings as DataFrames (lint, tenant_id, subject, detail)."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.common import blank
from memspark.operators.temporal import sane_interval
from memspark.session import union_all


def _finding(rows: DataFrame, lint: str, subject: str, detail: Column) -> DataFrame:
    return rows.select(F.lit(lint).alias("lint"), "tenant_id", F.col(subject).alias("subject"), detail.alias("detail"))


def provenance_required(episodes: DataFrame) -> DataFrame:
    return _finding(episodes.where(blank(F.col("source_uri"))), "provenance-required", "episode_id", F.lit("no source_uri"))


def provenance_resolvable(
    episodes: DataFrame, files: DataFrame, accepting_tenants: DataFrame, strip_minted: bool = False
) -> DataFrame:
    """Sources that lead nowhere.

    ``files(tenant_id, path)`` lists the stored pages as ``s4a/…`` and ``s4b/…``;
    ``accepting_tenants(tenant_id)`` are those that accept other schemes.  By default the whole
    text behind the scheme is the path, so minted ``s4a://tenant/…`` addresses do not resolve;
    ``strip_minted`` removes the authority part first.  Empty sources belong to the other lint.
    """
    rows = episodes.where(~blank(F.col("source_uri")))
    uri = F.col("source_uri")
    own = uri.startswith("s4a:") | uri.startswith("s4b:")
    rel = F.substring(uri, 5, 1 << 30)
    if strip_minted:
        rel = F.regexp_replace(rel, "^//[^/]*/", "")
    path = F.when(own & (rel != ""), F.concat(F.substring(uri, 1, 3), F.lit("/"), rel))
    gone = rows.where(own).withColumn("path", path).join(files.select("tenant_id", "path"), ["tenant_id", "path"], "left_anti")
    foreign = rows.where(~own).join(accepting_tenants.select("tenant_id"), "tenant_id", "left_anti")
    return union_all(
        _finding(gone, "provenance-resolvable", "episode_id", F.lit("missing page")),
        _finding(foreign, "provenance-resolvable", "episode_id", F.lit("scheme not accepted")),
    )


def interval_sanity(facts: DataFrame) -> DataFrame:
    return _finding(facts.where(~sane_interval()), "interval-sanity", "fact_id", F.lit("ends before it starts"))


def provenance_fields(rows: DataFrame, subject: str = "episode_id") -> DataFrame:
    """Records without one of the mandatory provenance fields; ``source_uri`` is reported first."""
    reason = None
    for c in ("source_uri", "episode_id", "agent_id", "recorded_at"):
        cond = blank(F.col(c).cast("string"))
        reason = F.when(cond, F.lit(c)) if reason is None else reason.when(cond, F.lit(c))
    return _finding(rows.withColumn("_why", reason).where(F.col("_why").isNotNull()), "provenance-fields", subject, F.col("_why"))


def run(lints: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """All findings of the named lints in one table."""
    out = None
    for make in lints.values():
        found = make()
        out = found if out is None else union_all(out, found)
    return out


def exit_code(findings: DataFrame) -> int:
    """0 without findings, 1 with; 2 is left to the caller for errors."""
    return 0 if findings.isEmpty() else 1


def provenance_json(envelope: Column) -> Column:
    """JSON of a provenance struct; fields without a value are left out."""
    return F.to_json(envelope)


def from_peer(peer: DataFrame, new_episode: Column, recipient: Column, recorded_at: Column) -> DataFrame:
    """Provenance of a fact taken over from a peer's message."""
    return peer.select(
        new_episode.alias("episode_id"), F.concat(F.lit("self_observation:"), recipient).alias("source_uri"),
        recipient.alias("agent_id"), recorded_at.alias("recorded_at"), F.col("episode_id").alias("derived_from"),
        F.lit(None).cast("string").alias("edit_history_id"),
    )
