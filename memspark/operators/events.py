"""Event envelopes: validation rules over JSON text, and the sink."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions.common import fail_when


_MEMBERS = (
    "contamination_protected", "fact_ids", "path", "recall_id", "decision", "score_output", "superseded_by", "phase_name",
    "consolidate_run_id",
)


def _read(events: DataFrame, column: str) -> DataFrame:
    """Adds ``_e``: the keys of the envelope and kind and text of each member a rule looks at.

    A kind is the type name (VOID for JSON null), empty for an absent member.  The one-element
    explode keeps the optimizer from copying the parsing into every rule and filter.
    """
    var = F.col("_var")

    def member(name: str) -> Column:
        value = F.variant_get(var, f"$.{name}", "variant")
        return F.struct(
            F.coalesce(F.schema_of_variant(value), F.lit("")).alias("kind"),
            F.try_variant_get(var, f"$.{name}", "string").alias("text"),
        ).alias(name)

    parsed = events.withColumn("_var", F.try_parse_json(F.col(column)))
    members = F.struct(
        F.coalesce(F.schema_of_variant(var), F.lit("")).startswith("OBJECT").alias("is_object"),
        F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")).alias("keys"),
        F.try_variant_get(var, "$.event_type", "string").alias("event_type"),
        F.variant_get(var, "$.fact_ids[0]", "variant").isNotNull().alias("has_id"),
        *[member(m) for m in _MEMBERS],
    )
    return parsed.withColumn("_e", F.explode(F.array(members))).drop("_var")


def with_reason(events: DataFrame, column: str = "envelope") -> DataFrame:
    """Adds ``reason``: the first broken rule, or NULL for a valid envelope."""
    e = F.col("_e")
    t = e["event_type"]

    def lacks(required) -> Column:
        return F.size(F.array_except(F.array(*[F.lit(k) for k in required]), e["keys"])) > 0

    def is_text(name: str) -> Column:
        return (e[name]["kind"] == "STRING") & (F.length(e[name]["text"]) > 0)

    ids_kind = e["fact_ids"]["kind"]
    full_list = ids_kind.startswith("ARRAY<") & e["has_id"]
    text_list = full_list & (ids_kind == "ARRAY<STRING>")
    number = e["score_output"]["kind"].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    is_true = (e["contamination_protected"]["kind"] == "BOOLEAN") & (e["contamination_protected"]["text"] == "true")

    rules = [
        (~e["is_object"], "not a JSON object"),
        (lacks(v.EVENT_COMMON), "missing common field"),
        (~F.coalesce(t.isin(*v.EVENT_REQUIRED), F.lit(False)), "unknown event_type"),
        (~F.coalesce(is_true, F.lit(False)), "not contamination_protected"),
        *[((t == name) & lacks(req), "missing field of its type") for name, req in v.EVENT_REQUIRED.items() if req],
        ((t == "remember") & ~full_list, "fact_ids"),
        (t.isin("recall", "promote", "demote", "invalidate") & ~text_list, "fact_ids"),
        ((t == "recall") & ~(is_text("path") & e["path"]["text"].isin(*v.RECALL_PATHS)), "path"),
        ((t == "recall") & ~is_text("recall_id"), "recall_id"),
        (t.isin("promote", "demote", "invalidate") & ~is_text("decision"), "decision"),
        (t.isin("promote", "demote") & ~number, "score_output"),
        ((t == "invalidate") & ~((e["superseded_by"]["kind"] == "VOID") | is_text("superseded_by")), "superseded_by"),
        ((t == "consolidate_phase") & ~(is_text("phase_name") & e["phase_name"]["text"].isin(*v.PHASES)), "phase_name"),
        ((t == "consolidate_phase") & ~is_text("consolidate_run_id"), "consolidate_run_id"),
    ]
    out = None
    for cond, reason in rules:
        out = F.when(cond, F.lit(reason)) if out is None else out.when(cond, F.lit(reason))
    return _read(events, column).withColumn("reason", out).drop("_e")


def split(events: DataFrame, column: str = "envelope") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reason``)."""
    judged = with_reason(events, column)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def write_events(events: DataFrame, path: str, column: str = "envelope", rejects: str | None = None, files: int = 8) -> None:
    """Append valid envelopes as JSON lines under tenant/yyyy/mm/dd.

    Rejected ones are appended with their ``reason`` as Parquet at ``rejects``; without that path one of
    them fails the job.  A day of a tenant goes to at most ``files`` files of each call.
    """
    if rejects is None:
        reason = F.concat(F.lit("rejected envelope: "), F.col("reason"))
        good = with_reason(events, column)
        good = good.withColumn(column, fail_when(F.col("reason").isNotNull(), reason, F.col(column)))
    else:
        good, bad = split(events, column)
        bad.select(column, "reason").write.mode("append").parquet(rejects)
    ts = F.to_timestamp(F.get_json_object(column, "$.ts_recorded"))
    (
        good.select(
            F.get_json_object(column, "$.tenant_id").alias("tenant_id"), F.date_format(ts, "yyyy").alias("yyyy"),
            F.date_format(ts, "MM").alias("mm"), F.date_format(ts, "dd").alias("dd"), F.col(column).alias("value"),
        ).repartition("tenant_id", "yyyy", "mm", "dd", F.pmod(F.xxhash64("value"), F.lit(files))).write.mode("append").partitionBy("tenant_id", "yyyy", "mm", "dd").text(path)
    )
