"""Recall outcomes, rolling windows, alarms and gauges."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.operators.percentiles import percentile_disc
from memspark.operators.utility import event_weight


def join_outcomes(recalls: DataFrame, outcomes: DataFrame, within_seconds: int = 3600) -> DataFrame:
    """Every recall with its outcomes of the next hour; a recall without any counts as ``no_op``.

    ``recalls(recall_id, ts, …)``, ``outcomes(recall_id, outcome, ts)``.
    """
    span = within_seconds * 1_000_000

    def slot(ts):
        return F.floor(F.unix_micros(ts) / F.lit(span))

    # both sides also meet on a time slot of the window's length, so that a busy id does not
    # pair all of its recalls with all of its outcomes; an outcome serves its own slot and the
    # one before, which is where its recall must lie
    o = outcomes.select(
        F.col("recall_id").alias("_id"), "outcome", F.col("ts").alias("_ts"),
        F.explode(F.array(slot("ts"), slot("ts") - 1)).alias("_slot_o"),
    )
    near = (
        (F.col("recall_id") == F.col("_id")) & (F.col("_slot") == F.col("_slot_o")) & (F.col("_ts") >= F.col("ts"))
        & (F.unix_micros("_ts") <= F.unix_micros("ts") + F.lit(span))
    )
    rows = recalls.withColumn("_slot", slot("ts")).join(o, near, "left").withColumn("outcome", F.coalesce("outcome", F.lit("no_op")))
    rows = rows.drop("_slot", "_slot_o", "_id", "_ts")
    return rows.withColumn("weight", event_weight(F.col("outcome")))


def repeat_recalls(ledger: DataFrame, since: Column, until: Column) -> DataFrame:
    """How often each fact was among the answers recorded in the window."""
    inside = ledger.where((F.col("ts") >= since) & (F.col("ts") < until))
    return inside.select("tenant_id", F.explode("top_k_fact_ids").alias("fact_id")).groupBy("tenant_id", "fact_id").agg(
        F.count("*").alias("recalls")
    )


def rolling_count(rows: DataFrame, keys: tuple[str, ...], ts: str, span_seconds: int, bucket_seconds: int | None = None) -> DataFrame:
    """Adds ``n``: rows of the same key in ``(ts - span, ts]``, this one included.  Rows without a time count each other.

    Each key's time line is cut into buckets, so one busy key spreads over many tasks.  A row
    within ``span`` of the end of its bucket is also handed to the next one as context.  A row adds one
    at its time and takes it away when the span is over, so a running sum in order of time is the
    count: the work per row does not grow with the rows in the span, as that of a moving frame does.
    """
    width = bucket_seconds or max(span_seconds * 10, 60)
    if width < span_seconds:
        raise ValueError("a bucket must cover the span")
    us, w_us, s_us = F.unix_micros(ts), width * 1_000_000, span_seconds * 1_000_000
    own = F.floor(us / F.lit(w_us))
    late = (us - own * w_us) >= w_us - s_us
    copies = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    spread = rows.withColumn("_us", us).withColumn("_own", own).withColumn("_b", F.explode(copies)).repartition(*keys, "_b")
    marks = spread.withColumn("_by", F.explode(F.when(F.col("_us").isNull(), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(-1)))))
    timed = marks.withColumn("_at", F.when(F.col("_by") > 0, F.col("_us")).otherwise(F.col("_us") + s_us)).drop("_us")
    w = Window.partitionBy(*keys, "_b").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = timed.withColumn("n", F.sum("_by").over(w))
    return counted.where((F.col("_by") > 0) & F.col("_b").eqNullSafe(F.col("_own"))).drop("_at", "_by", "_own", "_b")


def rate_violations(requests: DataFrame, burst: int, sustained: float, keys=("tenant_id", "principal"), ts: str = "ts") -> DataFrame:
    """Requests above the burst cap in their second or above the sustained rate over ten seconds."""
    fast = rolling_count(requests, tuple(keys), ts, 1).withColumnRenamed("n", "in_1s")
    both = rolling_count(fast, tuple(keys), ts, 10).withColumnRenamed("n", "in_10s")
    return both.where((F.col("in_1s") > burst) | (F.col("in_10s") > sustained * 10))


def spikes(events: DataFrame, keys: tuple[str, ...], ts: str, span_seconds: int, limit: int) -> DataFrame:
    """(keys…, peak): keys with more than ``limit`` events inside some window of the span."""
    return rolling_count(events, keys, ts, span_seconds).groupBy(*keys).agg(F.max("n").alias("peak")).where(F.col("peak") > limit)


def stalled(state: DataFrame, now: Column, gate_seconds: int = v.GATE_SECONDS, factor: float = 2.0) -> DataFrame:
    """Tenants whose last successful cycle is too long ago."""
    age = F.unix_seconds(now) - F.unix_seconds("last_run_at")
    return state.withColumn("age_seconds", age).where(F.col("age_seconds") > gate_seconds * factor)


def due(last_run_at: Column, now: Column, gate_seconds: int = v.GATE_SECONDS) -> Column:
    """Whether the gate has elapsed; a tenant that never ran is due."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(last_run_at) >= gate_seconds * 1_000_000, F.lit(True))


def lock_free(token: Column, heartbeat_at: Column, now: Column, break_seconds: int = v.LOCK_BREAK_SECONDS) -> Column:
    """No holder, or one whose heartbeat is too old."""
    stale = F.unix_micros(heartbeat_at) < F.unix_micros(now) - break_seconds * 1_000_000
    return token.isNull() | F.coalesce(stale, F.lit(False))


def queue_gauges(queue: DataFrame, now: Column, depth_limit: int = 50, age_limit_hours: float = 24.0) -> DataFrame:
    """Per tenant: rows by state, depth and age of the review queue, and its alarm."""
    pending = F.col("status") == "pending_review"
    oldest = F.min(F.when(pending, F.col("staged_at")))
    age = (F.unix_micros(now) - F.unix_micros(oldest)) / F.lit(3.6e9)
    depth = F.count_if(pending)
    return queue.groupBy("tenant_id").agg(
        depth.alias("pending"), F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("status") == "expired").alias("expired"),
        F.coalesce(age, F.lit(0.0)).alias("oldest_hours"),
        ((depth > depth_limit) | (F.coalesce(age, F.lit(0.0)) > age_limit_hours)).alias("alarm"),
    )


def contradiction_density(edges: DataFrame, since: Column, until: Column, p99_limit: int = 20) -> DataFrame:
    """Per tenant: p99 of contradictions per fact in the window, and the alarm.

    ``edges(tenant_id, fact_id, contradictor, ts)``.
    """
    inside = edges.where((F.col("ts") >= since) & (F.col("ts") < until))
    per_fact = inside.groupBy("tenant_id", "fact_id").agg(F.countDistinct("contradictor").alias("n_contra"))
    return percentile_disc(per_fact, "n_contra", 0.99, ("tenant_id",), "p99").withColumn("alarm", F.col("p99") >= p99_limit)


def density_share(contradicted: DataFrame, facts: DataFrame, limit: float = 0.05) -> DataFrame:
    """Per tenant: share of its facts that are contradicted, and the alarm."""
    c = contradicted.select("tenant_id", "fact_id").distinct().withColumn("_c", F.lit(1))
    share = F.avg(F.col("_c").isNotNull().cast("double"))
    return facts.select("tenant_id", "fact_id").join(c, ["tenant_id", "fact_id"], "left").groupBy("tenant_id").agg(
        share.alias("share"), (share > limit).alias("alarm")
    )


def training_gate(pairs: DataFrame, cases: DataFrame, min_pairs: int = 10_000, min_share: float = 0.20) -> DataFrame:
    """One row: labelled pairs, operator share of the cases, and whether training may start."""
    n_pairs = pairs.agg(F.count("*").alias("n")).scalar()
    share = F.coalesce(F.avg((F.col("source") == "operator").cast("double")), F.lit(0.0))
    return cases.agg(share.alias("operator_share")).withColumn("labelled_pairs", n_pairs).withColumn(
        "open", (F.col("labelled_pairs") >= min_pairs) & (F.col("operator_share") >= min_share)
    )


def audit(log: DataFrame, provenance: DataFrame, since: Column, until: Column) -> DataFrame:
    """Log entries of a time range with the provenance of their facts."""
    inside = log.where((F.col("ts") >= since) & (F.col("ts") < until))
    return inside.join(provenance, ["tenant_id", "fact_id"], "left")
